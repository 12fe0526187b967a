"""A sentiment classifier with learned sub-word embeddings and one attention layer, in numpy, trained by parallel tasks.

A word's vector is the mean of the embeddings of itself and its letter trigrams, hashed into `buckets`; attention weighs
the words of a text's first `max_length` and sums their vectors; a linear layer tells the three labels apart. Rows are
dealt by their hash into shards of a bounded size, a task each. In an epoch every shard passes over its rows in batches,
from the weights that all begin with, and the shards' weights and moments are averaged by their numbers of rows, on the
executors; so an epoch is a job, however many rows there are. Training stops when the validation rows get no better.

Defined results: empty and null texts have one word of their own; labels that aren't known are left out of training; ties
of probabilities go to the first label, as elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.operators.classify import score_rows
from volatide.operators.network import Network, in_parts, summed_parts
from volatide.schemas import LABELS
from volatide.storage import cut

_WORD = re.compile(r"\w+")
#: Rows of a shard, and rows whose pieces are laid out at once.
SHARD_ROWS, TOGETHER = 4096, 256


@functools.lru_cache(1 << 16)
def _word_pieces(word: str, buckets: int) -> tuple[int, ...]:
    marked = f"<{word}>"
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in (marked, *(marked[i : i + 3] for i in range(len(marked) - 2))))


def pieces(text: str | None, buckets: int, max_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pieces of the first words, and where each word's begin."""
    found = [_word_pieces(word, buckets) for word in _WORD.findall((text or "").lower())[:max_length] or [""]]
    sizes = np.fromiter(map(len, found), np.int32, len(found))
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(ends[-1])), ends - sizes


class Encoder(Network):
    def __init__(self, buckets: int = 2048, width: int = 16, max_length: int = 220, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.buckets, self.max_length, self.labels = buckets, max_length, list(LABELS)
        self.w = {"e": rng.normal(0, 0.3, (buckets, width)), "a": rng.normal(0, 1 / np.sqrt(width), (width, width)), "q": rng.normal(0, 1, width), "o": rng.normal(0, 1 / np.sqrt(width), (width, len(LABELS))), "b": np.zeros(len(LABELS))}

    def prepared(self, texts) -> np.ndarray:
        out = np.empty(len(texts), object)
        for i, text in enumerate(texts):
            out[i] = pieces(text, self.buckets, self.max_length)
        return out

    def _forward(self, items):
        """Probabilities of a batch, and what the derivatives need: all pieces and words of its texts in a row."""
        many = np.array([len(starts) for _, starts in items])
        lengths = np.array([len(ids) for ids, _ in items])
        ids = np.concatenate([ids for ids, _ in items])
        starts = np.concatenate([starts for _, starts in items]) + np.repeat(np.cumsum(lengths) - lengths, many)
        sizes = np.diff(np.append(starts, len(ids)))
        first, owner = np.cumsum(many) - many, np.repeat(np.arange(len(items)), many)
        words = np.add.reduceat(self.w["e"].take(ids, axis=0), starts) / sizes[:, None]
        mixed = np.tanh(words @ self.w["a"])
        weight = mixed @ self.w["q"]
        weight = np.exp(weight - np.maximum.reduceat(weight, first)[owner])
        weight /= np.add.reduceat(weight, first)[owner]
        whole = np.add.reduceat(weight[:, None] * words, first)
        logits = whole @ self.w["o"] + self.w["b"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), (ids, sizes, first, owner, words, mixed, weight, whole)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        found = [self._forward(x[at : at + TOGETHER])[0] for at in range(0, len(x), TOGETHER)]
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)))

    def loss(self, x, y) -> float:
        return float(-np.log(np.maximum(1e-300, self.probabilities(x)[np.arange(len(x)), y])).sum())

    def gradient(self, x, y) -> tuple[float, dict[str, np.ndarray]]:
        p, (ids, sizes, first, owner, words, mixed, weight, whole) = self._forward(x)
        rows, g = np.arange(len(x)), {}
        loss = -np.log(np.maximum(1e-300, p[rows, y])).sum()
        d = p
        d[rows, y] -= 1
        g["b"], g["o"] = d.sum(0), whole.T @ d
        dwhole = (d @ self.w["o"].T)[owner]
        dweight = (words * dwhole).sum(1)
        dscore = weight * (dweight - np.add.reduceat(weight * dweight, first)[owner])
        g["q"] = mixed.T @ dscore
        dmixed = np.outer(dscore, self.w["q"]) * (1 - mixed * mixed)
        g["a"] = words.T @ dmixed
        dwords = (weight[:, None] * dwhole + dmixed @ self.w["a"].T) / sizes[:, None]
        # A column at a time: the pieces' shares, added up by bucket.
        of_word = np.repeat(np.arange(len(sizes)), sizes)
        g["e"] = np.stack([np.bincount(ids, column[of_word], self.buckets) for column in np.ascontiguousarray(dwords.T)], axis=1)
        return float(loss / len(x)), {k: g[k] / len(x) for k in self.w}


def train(df: DataFrame, split: str | None = "split", epochs: int = 8, batch: int = 32, rate: float = 1e-2, max_length: int = 220, patience: int = 2, workers: int = 2, buckets: int = 2048, width: int = 16, seed: int = 0) -> Encoder:
    """From (input_text, label[, split]): train rows (all without a split) fit, val rows stop.

    Shards of about SHARD_ROWS rows, `workers` at least, a task each.
    """
    known = df.where(F.col("label").isin(*LABELS))
    kind = F.col(split) if split else F.lit("train")
    rows = known.select("input_text", "label", kind.alias("split")).where("split in ('train', 'val')")
    # Copies of a row are counted and dealt out by their numbers, so that they share no shard.
    rows = cut(rows.groupBy("input_text", "label", "split").agg(F.count("*").alias("n")))
    many = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    net = Encoder(buckets, width, max_length, seed)
    net.losses = []
    if not many.get("train"):
        return net
    shards = max(workers, -(-sum(many.values()) // SHARD_ROWS))
    copies = rows.select("input_text", "label", "split", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).withColumn("h", F.xxhash64("input_text", "label", "split", "copy"))
    shard = F.pmod("h", F.lit(shards)).cast("int")
    dealt = copies.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("h", "input_text", "label")
    dealt = cut(dealt.select("shard", "split", "label", "input_text").mapInArrow(_laid_out(net), "shard int, split string, label int, ids binary, starts binary"))
    fits, stops = dealt.where("split = 'train'"), dealt.where("split = 'val'" if many.get("val") else "split = 'train'")
    memory = np.zeros(2 * net.flat().size + 1)
    kept, best, waited = net.flat(), np.inf, 0
    for epoch in range(epochs):
        total = summed_parts(fits.mapInArrow(_passed(net, memory, batch, rate, [seed, epoch]), "shard int, i int, part binary"))
        weights, memory = np.split(total[:-1] / total[-1], [net.flat().size])
        net.put(weights)
        off = stops.mapInArrow(_losses(net), "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
        net.losses.append(off[0] / off[1])
        if net.losses[-1] < best - 1e-12:
            best, waited, kept = net.losses[-1], 0, net.flat()
        else:
            waited += 1
            if waited >= patience:
                break
    net.put(kept)
    return net


def _laid_out(net: Encoder):
    """Rows with their pieces in place of texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = net.prepared(part.column("input_text").to_pylist())
                labels = pa.array([LABELS.index(x) for x in part.column("label").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("split"), labels, *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], ["shard", "split", "label", "ids", "starts"])

    return run


def _given(batches):
    """(shard, items, labels) of rows in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            x = np.empty(part.num_rows, object)
            for i, pair in enumerate(zip(part.column("ids").to_pylist(), part.column("starts").to_pylist(), strict=True)):
                x[i] = tuple(np.frombuffer(b, np.int32) for b in pair)
            yield part.column("shard")[0].as_py(), x, part.column("label").to_numpy()


def _passed(net: Encoder, memory: np.ndarray, batch: int, rate: float, seed: list[int]):
    """A shard's weights and memory after one pass over its rows from here, times their number, and the number."""

    def run(batches):
        if found := list(_given(batches)):
            shard, x, y = found[0][0], np.concatenate([x for _, x, _ in found]), np.concatenate([y for _, _, y in found])
            after = net.one_pass(x, y, memory, batch, rate, np.random.default_rng([*seed, shard]))
            yield in_parts(shard, np.concatenate([net.flat(), after, [1.0]]) * len(x))

    return run


def _losses(net: Encoder):
    def run(batches):
        found = [(net.loss(x, y), len(x)) for _, x, y in _given(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(f[0] for f in found)], pa.float64()), pa.array([sum(f[1] for f in found)], pa.int64())], ["loss", "n"])

    return run


def predict(model: Encoder, df: DataFrame) -> DataFrame:
    """Label, probabilities and score of every row."""
    name = "__probabilities"

    def found(texts: pd.Series) -> pd.Series:
        parts = [model.probabilities(model.prepared(texts.iloc[at : at + TOGETHER].tolist())) for at in range(0, len(texts), TOGETHER)]
        return pd.Series([p for part in parts for p in part], dtype=object)

    return score_rows(df.withColumn(name, F.pandas_udf(found, "array<double>")(F.col("input_text"))), name).drop(name)


def save(model: Encoder, spark: SparkSession, path: str) -> None:
    row = (list(model.labels), model.buckets, model.max_length, {k: v.ravel().tolist() for k, v in model.w.items()}, {k: list(v.shape) for k, v in model.w.items()})
    spark.createDataFrame([row], "labels array<string>, buckets int, max_length int, weights map<string,array<double>>, shapes map<string,array<int>>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Encoder:
    """The saved model, if it has exactly the three labels, in their order, and as many outputs."""
    row = spark.read.parquet(path).first()
    if list(row["labels"]) != list(LABELS):
        raise ValueError(f"{path} has labels {list(row['labels'])}; they must be {list(LABELS)}.")
    out = Encoder(row["buckets"], row["shapes"]["e"][1], row["max_length"])
    out.w = {k: np.array(v).reshape(row["shapes"][k]) for k, v in row["weights"].items()}
    if out.w["o"].shape[1] != len(LABELS) or out.w["b"].shape != (len(LABELS),):
        raise ValueError(f"{path} tells {out.w['o'].shape[1]} classes apart, not {len(LABELS)}.")
    return out
