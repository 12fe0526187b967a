"""Stripping lines that many earlier documents hold, batch by batch, as a stream with state.

Documents come in numbered batches. A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. A line is removed if its key has at least `min_chars` code points and at least `min_docs` documents of all
earlier batches held that key (as they came, before anything was removed).

Every batch is one start of a Structured Streaming query on one checkpoint. Tasks sum their documents' keys (SHA-256
digests) before the shuffle, so a line that is everywhere leaves a task once in FLUSH keys. Digests are dealt into hash
shards; applyInPandasWithState keeps a shard's state as blobs of a sorted fixed-width digest array and a count array:
numpy's searchsorted answers what earlier batches held, and sorted insertion merges the new keys. Shards are made from the
amount of text (a shard for SHARD_BYTES of it), so that a blob stays small however large the input is.

What a shard found is written in foreachBatch, under the batch's number, and the batch's documents are read again: lines
that pass a bitmap of fixed size (BITS; when it fills up more lines pass, and results stay the same) join the found
digests, and what a document loses is left out of it. Nothing that grows with the input is broadcast,
collected, or dealt to one task.

Defined results: null and empty texts are one empty line; trailing empty lines count; each row is a document of its own,
also if ids or whole rows repeat; a null id stays null; null batch numbers count as 0, and numbers outside the given range are an
error; a document whose lines all go keeps the empty text; empty batches and tables give no documents, and the last
batch still tells the lines that were removed; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volatide.llm.common import shared_folder

WIDTH = 32
DIGEST = f"S{WIDTH}"
SHARD_BYTES, LEAST_SHARDS = 4 << 20, 64
#: Distinct keys that a task sums before they leave it.
FLUSH = 100_000
BITS = 1 << 21

_SPACE = " \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Stripped(NamedTuple):
    """docs: doc_id, batch, n_all, n_removed, kept (text). lines: digest, batch, n_all, n_removed of each key that lost lines."""

    docs: DataFrame
    lines: DataFrame


def line_digests(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """The place and digest of each line whose key is long enough."""
    for at, line in enumerate((text or "").split("\n")):
        key = line.strip(_SPACE)
        if len(key) >= min_chars:
            yield at, hashlib.sha256(key.encode("utf-8", "surrogatepass").translate(_LOWER)).digest()


def _array(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), DIGEST)


def _listed(digests: np.ndarray) -> list[bytes]:
    """Whole digests; numpy's own items end at trailing zeros."""
    raw = digests.tobytes()
    return [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)]


def _summed_keys(shards: int, min_chars: int):
    """(shard, batch, digest, docs, lines) of documents; a batch's closing row goes to every shard, with a null digest."""
    names = ["shard", "batch", "digest", "docs", "lines"]

    def rows(held: dict[int, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for batch, (docs, lines) in held.items():
            digests = list(docs)
            shard = [int.from_bytes(d[:8], "big") % shards for d in digests]
            arrays = [pa.array(shard, pa.int32()), pa.array([batch] * len(digests), pa.int32()), pa.array(digests, pa.binary()), pa.array(list(docs.values()), pa.int64()), pa.array([lines[d] for d in digests], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        held: dict[int, tuple[Counter, Counter]] = {}
        for part in batches:
            for text, batch, closing in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if closing:
                    nothing = pa.nulls(shards, pa.binary()), pa.nulls(shards, pa.int64()), pa.nulls(shards, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array([batch] * shards, pa.int32()), *nothing], names)
                    continue
                docs, lines = held.setdefault(batch, (Counter(), Counter()))
                own = Counter(d for _, d in line_digests(text.as_py(), min_chars))
                docs.update(own.keys())
                lines.update(own)
                if len(docs) >= FLUSH:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return run


def lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted digest is, or would be inserted, in the sorted known ones, and whether it is there."""
    at = np.searchsorted(known, wanted)
    there = np.zeros(len(wanted), bool)
    inside = at < len(known)
    there[inside] = known[at[inside]] == wanted[inside]
    return at, there


def merged(known: np.ndarray, values: list[np.ndarray], fresh: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted digests with their columns of values; fresh ones (sorted, not among the known) are inserted in order."""
    at = np.searchsorted(known, fresh)
    return np.insert(known, at, fresh), [np.insert(a, at, b) for a, b in zip(values, new, strict=True)]


class Shard:
    """A shard's state: digests with the documents that held them; of those that lost lines, the first batch and the lines."""

    def __init__(self, blobs: tuple | None):
        read = lambda i, kind: np.frombuffer(blobs[i], kind) if blobs else np.zeros(0, kind)
        self.digests, self.docs = read(0, DIGEST), read(1, np.int64)
        self.lost, self.first, self.lines = read(2, DIGEST), read(3, np.int32), read(4, np.int64)

    def blobs(self) -> tuple:
        return tuple(x.tobytes() for x in (self.digests, self.docs, self.lost, self.first, self.lines))

    def add(self, batch: int, digests: np.ndarray, docs: np.ndarray, lines: np.ndarray, min_docs: int) -> np.ndarray:
        """Take in a batch's keys; gives those whose lines are removed in it."""
        keys, of = np.unique(digests, return_inverse=True)
        docs, lines = (np.bincount(of, x, len(keys)).astype(np.int64) for x in (docs, lines))
        at, there = lookup(self.digests, keys)
        gone = np.zeros(len(keys), bool)
        gone[there] = self.docs[at[there]] >= min_docs
        self.docs = self.docs.copy()
        self.docs[at[there]] += docs[there]
        self.digests, (self.docs,) = merged(self.digests, [self.docs], keys[~there], [docs[~there]])
        at, before = lookup(self.lost, keys[gone])
        self.lines = self.lines.copy()
        self.lines[at[before]] += lines[gone][before]
        fresh = keys[gone][~before]
        self.lost, (self.first, self.lines) = merged(self.lost, [self.first, self.lines], fresh, [np.full(len(fresh), batch, np.int32), lines[gone][~before]])
        return keys[gone]

    def removed_lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that lost lines, the first batch, all documents that held them, and the lines."""
        return self.lost, self.first, self.docs[lookup(self.digests, self.lost)[0]], self.lines


STATE = "digests binary, docs binary, lost binary, first binary, lines binary"
FOUND = "closing boolean, batch int, digest binary, n_all long, n_removed long"


def _updated(min_docs: int, last: int):
    """The digests that a batch removes; after the last batch also what each removed digest came to."""

    def update(key, frames, state):
        parts = list(frames)
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        shard = Shard(state.get if state.exists else None)
        for batch in sorted(rows["batch"].unique()):
            own = rows[rows["batch"] == batch]
            keys = own[own["digest"].notna()]
            if len(keys):
                gone = shard.add(int(batch), _array(keys["digest"].tolist()), keys["docs"].to_numpy(np.float64), keys["lines"].to_numpy(np.float64), min_docs)
                if len(gone):
                    yield pd.DataFrame({"closing": False, "batch": np.int32(batch), "digest": _listed(gone), "n_all": 0, "n_removed": 0})
            if batch == last and len(keys) < len(own) and len(shard.lost):
                lost, first, docs, lines = shard.removed_lines()
                yield pd.DataFrame({"closing": True, "batch": first, "digest": _listed(lost), "n_all": docs, "n_removed": lines})
        state.update(shard.blobs())

    return update


def _places(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint8).reshape(-1, WIDTH)[:, 8:12].copy().view(np.uint32)[:, 0] % np.uint32(BITS)


def _bitmap(found: DataFrame) -> np.ndarray:
    """Bits of the found digests: always BITS of them, combined before they are collected."""

    def words(batches):
        for batch in batches:
            places = np.unique(_places(_array(batch.column(0).to_pylist()))).astype(np.int64)
            if len(places):
                starts = np.flatnonzero(np.concatenate([[True], np.diff(places >> 6) > 0]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(places[starts] >> 6), pa.array(bits.view(np.int64))], ["word", "bits"])

    table = found.select("digest").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _likely_lines(bitmap: np.ndarray, min_chars: int):
    """(row, at, digest) of the lines that pass the bitmap."""

    def run(batches):
        for batch in batches:
            rows, at, digests = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, digest in line_digests(text.as_py(), min_chars):
                    rows.append(row)
                    at.append(i)
                    digests.append(digest)
            places = _places(_array(digests)) if digests else np.zeros(0, np.uint32)
            good = pa.array((bitmap[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], ["row", "at", "digest"]).filter(good)

    return run


def _without_lines(docs: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """The documents without the lines whose digests were found."""
    likely = docs.select("row", "text").mapInArrow(_likely_lines(_bitmap(found), min_chars), "row long, at int, digest binary")
    # Merge joins by hint: otherwise Spark broadcasts a side that happens to be small.
    away = likely.join(found.select("digest").hint("merge"), "digest").groupBy("row").agg(F.collect_list("at").alias("away"))
    lines, places = F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda n: F.sequence(F.lit(0), n - 1)
    left = F.transform(F.array_except(places(F.size(lines)), F.col("away")), lambda i: F.get(lines, i))
    return docs.join(away.hint("merge"), "row", "left").select(
        "doc_id",
        "batch",
        F.size(lines).cast("long").alias("n_all"),
        F.coalesce(F.size("away"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("away").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("kept"),
    )


def strip_seen_lines(docs: DataFrame, batch: Column, batches: int, min_docs: int = 5, min_chars: int = 10) -> Stripped:
    """Feed the rows of (doc_id, text) in the order of `batch` (0 to batches - 1) to the stream, and give what all its runs wrote.

    The folder is new at every call, below the shared one; what isn't part of the result is deleted at the end.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/linestrip-{uuid.uuid4().hex}"
    number = F.coalesce(batch.cast("int"), F.lit(0))
    number = F.when((number >= 0) & (number < batches), number).otherwise(F.raise_error(F.lit("a batch number is out of range")).cast("int"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"), number.alias("batch"), F.lit(False).alias("closing"))
    seen = Observation()
    rows = rows.observe(seen, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    closing = spark.range(batches).select(F.lit(-1).cast("long").alias("row"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("id").cast("int").alias("batch"), F.lit(True).alias("closing"))
    rows.union(closing).write.partitionBy("batch").parquet(f"{folder}/waiting")
    shards = max(LEAST_SHARDS, -(-seen.get["bytes"] // SHARD_BYTES))

    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *parts]))
    files = path().getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path("arrived"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "batch"), T.StructField("batch", T.IntegerType())])
    for n in range(batches):
        if not files.rename(path("waiting", f"batch={n}"), path("arrived", f"batch={n}")):
            raise OSError(f"batch {n} can't be moved to {folder}/arrived")

        def write(found: DataFrame, _: int, n: int = n) -> None:
            # Written first: the state is made once, and what follows reads files. A repeated run replaces them.
            found.write.mode("overwrite").parquet(f"{folder}/found/batch_{n}")
            gone = spark.read.schema(FOUND).parquet(f"{folder}/found/batch_{n}").where(f"not closing and batch = {n}")
            here = spark.read.schema(schema).option("basePath", f"{folder}/arrived").parquet(f"{folder}/arrived/batch={n}").where("not closing")
            _without_lines(here, gone, min_chars).write.mode("overwrite").parquet(f"{folder}/docs/batch_{n}")

        stream = spark.readStream.schema(schema).parquet(f"{folder}/arrived")
        keys = stream.select("text", "batch", "closing").mapInArrow(_summed_keys(shards, min_chars), "shard int, batch int, digest binary, docs long, lines long")
        found = keys.groupBy("shard").applyInPandasWithState(_updated(min_docs, batches - 1), FOUND, STATE, "append", "NoTimeout")
        found.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()

    lines = spark.read.schema(FOUND).parquet(f"{folder}/found/batch_{batches - 1}").where("closing").drop("closing")
    done = spark.read.schema(_done_schema(docs)).parquet(*[f"{folder}/docs/batch_{n}" for n in range(batches)])
    for part in ("waiting", "arrived", "stream"):
        files.delete(path(part), True)
    return Stripped(done, lines.select("digest", "batch", "n_all", "n_removed"))


def _done_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("batch", "integer").add("n_all", "long").add("n_removed", "long").add("kept", "string")
