"""Language identification by the nearest of several centroids per language.

A text becomes the normalised TF-IDF vector of its letter n-grams (1 to LONGEST letters of the lower-cased text, where
everything but letters counts as one blank), hashed into DIMENSIONS places. Labelled documents train: document
frequencies first, then spherical k-means inside each language (CLUSTERS centroids; several, since a language's
sources write differently). A document gets the language of the centroid with the largest cosine, and that cosine as
its score. It is rejected where the distance 1 - cosine is above the radius of that language, a quantile of the
distances of the training documents; `rejected` tells so, beside the prediction.

Bounds, as documented parameters: about `max_rows` documents of each language train, picked by a hash of id and text
when there are more; at most MOST_LANGUAGES languages (more are an error), so the model has a proven size (LARGEST
bytes at most). Whole texts are read, in training and in prediction.

Defined results: null texts and texts without a letter are `und` with score 0, and never rejected; so is everything
if nothing can train; rows with null languages or without letters don't train; ties go to the language first in code
point order; a prediction depends on the text and the model alone, so repeated rows agree; empty tables give empty
tables; extra columns are kept by `annotate` (those with the names of its results are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volatide.llm.common import add_columns, cut, slices

DIMENSIONS, LONGEST = 1 << 13, 3
CLUSTERS, ROUNDS = 4, 12
MOST_LANGUAGES = 500
LARGEST = MOST_LANGUAGES * CLUSTERS * DIMENSIONS * 4
#: The share of a language's training documents inside its radius, which is widened by SLACK.
INSIDE, SLACK = 0.995, 0.05
#: Texts whose vectors are held at once, and letters of a text whose n-grams are.
TOGETHER, STRETCH = 128, 1 << 18
UNKNOWN = "und"
#: What has a letter, in Spark's regular expressions.
HAS_LETTER = r"\p{L}"

_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint32(2654435761)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    total = np.zeros(DIMENSIONS, np.int64)
    # Stretches overlap by LONGEST - 1 letters; an n-gram belongs to the stretch in which it begins.
    letters = np.frombuffer(_OTHER.sub(" ", f" {text} ".lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(letters), STRETCH):
        part = letters[at : at + STRETCH + LONGEST - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _MIX
            h ^= h >> np.uint32(15)
            first = h[:STRETCH]
            total += np.bincount((first[part[: len(first)] != 32] if n == 1 else first) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
    return total


def vectors(texts: list[str | None]) -> np.ndarray:
    """A row of term frequencies (logarithmic) a text."""
    return np.array([np.log1p(counts(t or "")) for t in texts], np.float32).reshape(len(texts), DIMENSIONS)


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most k clusters: spherical k-means from far-apart rows."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        of = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        moved = np.where(np.bincount(of, minlength=len(centroids))[:, None] > 0, normalised(sums), centroids)
        if np.allclose(moved, centroids, atol=1e-5):
            break
        centroids = moved
    return centroids


class Model:
    """Inverse document frequencies, centroids with their languages, and a radius a language."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, owner: np.ndarray, radius: np.ndarray):
        self.idf, self.languages, self.centroids, self.owner, self.radius = idf, languages, centroids, owner, radius

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the nearest centroid's language, the cosine, and whether it is too far."""
        near = normalised(vectors(texts) * self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        cosine = np.clip(near[np.arange(len(near)), best], 0, 1).astype(np.float64)
        of = self.owner[best]
        return of, cosine, 1 - cosine > self.radius[of]


def _sample(docs: DataFrame, max_rows: int) -> DataFrame:
    """Distinct (lang, text) of about `max_rows` documents a language, picked by a hash of id and text."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    some = {lang: int(max_rows / n * 2**32) for lang, n in sizes.items() if n > max_rows}
    if not some:
        return docs.select("lang", "text").distinct()
    share = F.create_map(*[F.lit(x) for pair in sorted(some.items()) for x in pair])[F.col("lang")]
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**32)) < F.coalesce(share, F.lit(2**32))).select("lang", "text").distinct()


def _frequencies(sample: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each place of the vectors occurs, and the number of documents."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches, TOGETHER):
            for text in batch.column(0).to_pylist():
                total += counts(text) > 0
            n += batch.num_rows
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([there, [-1]])), pa.array(np.concatenate([total[there], [n]]))], ["place", "n"])

    found = sample.select("text").mapInArrow(summed, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # DIMENSIONS + 1 rows at most
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(sample: DataFrame, clusters: int = CLUSTERS) -> Model | None:
    """From (lang, text) of few rows a language; one task clusters a language."""
    seen, n = _frequencies(sample)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)

    def cluster(key, table):
        # In the order of their texts' vectors, so that the result doesn't depend on the order of rows.
        rows = normalised(np.concatenate([vectors(b.column("text").to_pylist()) for b in table.to_batches(TOGETHER)]) * idf)
        rows = rows[np.lexsort(rows[:, :8].T)]
        found = clustered(rows, clusters)
        far = 1 - (rows @ found.T).max(axis=1)
        radius = float(np.quantile(far, INSIDE)) + SLACK
        return pa.table({"lang": [key[0].as_py()] * len(found), "radius": [radius] * len(found), "centroid": [c.astype(np.float32).tobytes() for c in found]})

    rows = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, radius double, centroid binary").toLocalIterator(), key=lambda r: (r["lang"], r["centroid"]))
    languages = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    owner = np.array([number[r["lang"]] for r in rows])
    radius = np.array([next(r["radius"] for r in rows if r["lang"] == lang) for lang in languages])
    return Model(idf, languages, np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]), owner, radius)


def learn(docs: DataFrame, max_rows: int = 1000, clusters: int = CLUSTERS) -> Model | None:
    """The model of (doc_id, lang, text); None if nothing can train."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER))
    return fit(cut(_sample(rows, max_rows)), clusters)


def annotate(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", rejected: str = "rejected", text: str = "text") -> DataFrame:
    """Add the predicted language, its cosine and whether it is rejected to every row, in one pass over the whole texts."""
    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())]
    letters = re.compile(r"[^\W\d_]")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        names, near, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        there = [i for i, t in enumerate(texts) if t and has_letter(t, letters)]
        if model is not None and there:
            of, near[there], far[there] = model.predict([texts[i] for i in there])
            for i, k in zip(there, of.tolist(), strict=True):
                names[i] = model.languages[k]
        return [pa.array(names, pa.string()), pa.array(near), pa.array(far)]

    return add_columns(docs, fields, make, TOGETHER)


def has_letter(text: str, likely: re.Pattern) -> bool:
    """Whether a character's general category is L; `likely` also finds some numbers."""
    return any(c.isalpha() for c in map(re.Match.group, likely.finditer(text)))


def held_out(doc_id: str = "doc_id"):
    """True for ids that never train."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def identify(docs: DataFrame, max_rows: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; held-out rows don't train (null ids do)."""
    trains = docs.select("doc_id", "lang", "text").where(~F.coalesce(held_out(), F.lit(False)))
    done = annotate(docs.select("doc_id", "text"), learn(trains, max_rows))
    return done.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
