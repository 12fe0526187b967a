"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document's whole text makes a vector of statistics (STATISTICS); nothing else of it enters its score. Two of them
describe how the text ends (its last TAIL_WORDS words) beside the same measure of all of it, for junk that follows
prose. Labelled rows train the model: their standardised statistics are mapped to random Fourier features (an
approximate Gaussian kernel), each partition sums its normal equations for each of FOLDS folds, and the sums of the
few partitions are solved on the driver. Scores of the folds' rows under models without their fold are calibrated by
isotonic regression (pool adjacent violators).

Bounds, as documented parameters: at most `max_rows` labelled rows are used, picked by a hash of the id when there
are more; they are summed in FIT_PARTITIONS partitions. Statistics and scores cover all documents.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other; a
document's score depends on its text alone, so repeated rows tie; a document that is labelled twice trains with the
mean label; an id that has several texts trains with the one whose hash is least, in whatever order rows come; labels that are null are ignored; without labels of both classes every score is the mean label (0.5
without labels); an empty table gives an empty table; extra columns are ignored (`annotate` keeps them, but replaces
one with the name of its score).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volatide.llm.common import add_columns, checked_broadcast, cut, slices

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "pipes", "upper", "digits", "exclamations",
    "symbols", "stops", "commas", "lines", "repeated_lines", "wide_bytes", "controls", "brackets", "quotes", "at_signs", "slashes",
    "short_words", "long_words", "distinct_tail", "symbols_tail",
)
FEATURES = 384
RIDGE = 1e-3
WIDTH = 0.9
FOLDS = 4
FIT_PARTITIONS = 8
TAIL_WORDS = 400
#: Rows that a worker turns into matrices at once; texts are parsed one by one.
TOGETHER = 256

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"&%$#*~^=+_", b".?", b",;:", b"\n", b"()[]{}<>", b"\"'`", b"@", b"/\\", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 14
_CLASS[[c for c in range(32) if c not in (9, 10, 13)] + [127]] = 15


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=16)
    lines = [x for x in raw.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tail = words[-TAIL_WORDS:]
    tail_bytes = b" ".join(tail)
    letters = max(1.0, kinds[2] + kinds[13])
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(30.0, (len(raw) - kinds[8]) / w), len(set(words)) / w if words else 0.0,
        sum(map(eq, words, words[1:])) / w, kinds[1] / w, kinds[2] / letters, kinds[3] / n, kinds[4] / w,
        kinds[5] / w, kinds[6] / w, kinds[7] / w, kinds[8] / w, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        kinds[14] / n, kinds[15] / n, kinds[9] / w, kinds[10] / w, kinds[11] / w, kinds[12] / w,
        float((lengths <= 2).sum()) / w, float((lengths >= 15).sum()) / w, len(set(tail)) / max(1, len(tail)) if tail else 0.0,
        (len(tail_bytes) - len(tail_bytes.translate(None, b"&%$#*!|"))) / max(1, len(tail)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, label, order, stats) of every row of (doc_id, label, text); `order` is a hash of the text."""

    def run(batches):
        for batch in slices(batches, TOGETHER):
            found = pa.array([statistics(t.as_py()) for t in batch.column(3)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], ["doc_id", "label", "order", "stats"])

    return docs.select("doc_id", "label", F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, label double, order long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Standardisation, random features, weights and calibration knots; a few hundred KB, sent with the tasks."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, WIDTH / np.sqrt(len(mean)), (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + len(mean) + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z / 8, np.ones((len(z), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        level = np.interp(raw, *self.knots)
        # A thousandth of the raw order keeps documents of one step apart.
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50))), 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrated(self.features(stats) @ self.weights)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing least-squares fit: means of the pooled blocks."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # count, sum of x, sum of y
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 1] / found[:, 0], found[:, 2] / found[:, 0]


def fit(labelled: DataFrame) -> Model:
    """From (doc_id, stats, label) with label in [0, 1]."""
    d = len(STATISTICS)
    sums = labelled.agg(
        F.count("*").alias("n"),
        F.avg("label").alias("label"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.array(*[F.avg(F.col("stats")[i]) for i in range(d)]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_pop(F.col("stats")[i]), F.lit(0.0)) for i in range(d)]).alias("scale"),
    ).first()
    if not sums["n"] or (sums["low"] >= 0.5) == (sums["high"] >= 0.5):
        model = Model(np.zeros(d), np.ones(d))
        level = 0.5 if sums["label"] is None else float(sums["label"])
        model.knots = (np.array([0.0, 1.0]), np.array([level, level]))
        return model
    model = Model(np.array(sums["mean"]), np.array(sums["scale"]))
    size = FEATURES + d + 1
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    # By id, so that copies of one text spread over all tasks.
    dealt = labelled.select("stats", "label", fold.alias("fold"), "doc_id").repartition(FIT_PARTITIONS, F.xxhash64("doc_id")).drop("doc_id")

    def summed(batches):
        total = np.zeros((FOLDS, size, size + 1))
        for batch in slices(batches, TOGETHER):
            x, y, f = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                part = x[f == k]
                total[k] += part.T @ np.column_stack([part, y[f == k]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros((FOLDS, size, size + 1))
    for row in dealt.mapInArrow(summed, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(total.shape)

    def solve(t: np.ndarray) -> np.ndarray:
        return np.linalg.solve(t[:, :-1] + RIDGE * max(1.0, t[-1, -2]) * np.eye(size) * 0.01, t[:, -1])

    model.weights = solve(total.sum(0))
    without = [solve(total.sum(0) - total[k]) for k in range(FOLDS)]

    def left_out(batches):
        for batch in slices(batches, TOGETHER):
            x, f = model.features(_matrix(batch.column(0))), batch.column(2).to_numpy()
            raw = np.choose(f, [x @ w for w in without]) if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], ["raw", "label"])

    held = dealt.mapInArrow(left_out, "raw double, label double").toArrow()  # at most max_rows rows of two numbers
    model.knots = isotonic(held.column("raw").to_numpy(), held.column("label").to_numpy())
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Model:
    """The model of at most about `max_rows` labelled documents; `labels` are the rows that may train."""
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = clean.count()
    if n > max_rows:  # the hash picks documents and labels alike, so other texts aren't looked at
        picked = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**32)) < int(max_rows / n * 2**32)
        clean, rows = clean.where(picked), rows.where(picked)
    # Only labelled texts are parsed; of an id's texts the one with the least hash trains.
    parsed = with_statistics(rows.join(checked_broadcast(clean), "doc_id"))
    return fit(cut(parsed.groupBy("doc_id").agg(F.min_by(F.struct("stats", "label"), "order").alias("r")).select("doc_id", "r.stats", "r.label")))


def annotate(docs: DataFrame, model: Model, score: str = "score", text: str = "text") -> DataFrame:
    """Add `score` to every row, in one pass over the whole texts."""

    def make(batch):
        found = np.array([statistics(t.as_py()) for t in batch.column(text)]).reshape(-1, len(STATISTICS))
        return [pa.array(model.score(found))]

    return add_columns(docs, [T.StructField(score, T.DoubleType())], make, TOGETHER)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`."""
    scored = annotate(docs.select("doc_id", "text"), learn(docs, labels, label, max_rows)).select("doc_id", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """True for ids that never train."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1
