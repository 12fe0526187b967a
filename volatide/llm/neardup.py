"""Near-duplicate documents by MinHash and odd sketches.

A document is the set of its distinct shingles of `words` words (ASCII letters lower-cased, words cut at ASCII white
space); with fewer words the whole sequence is one shingle; without words the set is empty and linked with nothing.
Two documents are linked when their Jaccard similarity is at least percent / 100; groups are connected components.

1. One pass makes per document: the size of its set, a 128-bit fingerprint of the set, band keys from MinHash
   samples, and two odd sketches (parity bitmaps): of the samples, and of the whole set. The population count of two
   sketches' XOR estimates how many samples differ, which is precise for high similarities; that of the whole sets
   never exceeds their symmetric difference, so it rules pairs out without loss, sharply up to some hundred shingles.
2. Equal sets are one node from here on (a class, by fingerprint), so exact copies of any number cost one node.
3. Nodes that share a band key are candidates. Each bucket proposes a spanning forest of its most similar pairs by
   sketch, never all pairs; a bucket of more than CHUNK nodes is dealt DEALS times at random into chunks, so its
   cost grows in proportion. The pairs are confirmed on full sets and make components.
4. Buckets that still hold several components propose the pairs between different components whose sketches don't
   rule the link out. A component with more than CHUNK nodes in a bucket has chunks of its own there, which are not
   compared with one another; so a large group of near copies that is one component by now costs nothing more, and
   only what is not linked to it meets it again. These pairs are confirmed too, and components found anew.

Full sets are recomputed only for nodes that are in some pair; a bitmap of fixed size (BITMAP_BITS, so a bounded
broadcast) over a hash of id and text tells a second pass over the texts which they are, and a join corrects its
false positives.

What can be missed: a link whose ends share no band (under 1e-6 at the threshold) or whose sampled sketches differ by
more bits than all but MISSED of the pairs at the threshold do (both MinHash's variance and the sketch's are in it).

Defined results: null text counts as empty; rows may repeat, a repeated row gets the result of its equal; rows that
share an id but not a text are documents of their own; rows with a null id get component_id from their group if any
member has an id, else null (such rows link others as any row does); an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.llm.common import cut, slices

SAMPLES = 256
SKETCH_BITS = 512
WHOLE_BITS = 1024
#: Share of the pairs at the threshold that the sampled sketches may rule out.
MISSED = 1e-7
#: Members of a bucket that are compared at once; a larger bucket is dealt into chunks, DEALS times.
CHUNK = 512
DEALS = 2
BITMAP_BITS = 23
WORDS_CACHED = 250_000

_ODD = np.random.default_rng(20240229).integers(0, 2**32, (2, SAMPLES), dtype=np.uint32)
_XOR, _MUL = _ODD[0], _ODD[1] | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_CACHED:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        words, salt = len(h), np.uint64(len(h))
    else:
        salt = np.uint64(0)
    total = h[: len(h) - words + 1] + salt
    for i in range(1, words):
        total = total * _STEP + h[i : len(h) - words + 1 + i]
    return np.unique(_mixed(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(best, ((low[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> bytes:
    place = _mixed(samples.astype(np.uint64) + np.arange(SAMPLES, dtype=np.uint64) * _STEP) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def whole_sketch(shingles: np.ndarray) -> bytes:
    place = (shingles & np.uint64(WHOLE_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=WHOLE_BITS) & 1).astype(np.uint8)).tobytes()


@functools.cache
def most_bits(percent: float) -> int:
    """XOR bits up to which two sketches may belong to sets of this similarity, but for MISSED of such pairs.

    The bits' exact distribution: a binomial number of samples differ, each puts two marks at random places, and the
    places with an odd number of marks are counted. More similar sets differ by fewer bits.
    """
    s = percent / 100
    odd, total = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    odd[0], up = 1.0, 1 - np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    for differing in range(SAMPLES + 1):
        total += math.comb(SAMPLES, differing) * (1 - s) ** differing * s ** (SAMPLES - differing) * odd
        for _ in range(2):
            rise, fall = odd * up, odd * (1 - up)
            odd = np.append(0.0, rise[:-1]) + np.append(fall[1:], 0.0)
    beyond = np.cumsum(total[::-1])[::-1]  # at least so many bits
    return int(np.flatnonzero(beyond > MISSED)[-1])


def layout(percent: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which 24 bands miss a pair at the threshold less than once in 1e6."""
    s = percent / 100
    return 24, max([1, *(r for r in range(1, 11) if (1 - s**r) ** 24 < 1e-6)])


def _signatures(docs: DataFrame, words: int, percent: float) -> DataFrame:
    bands, rows = layout(percent)
    salt = _mixed(np.arange(bands, dtype=np.uint64) + _STEP)

    def run(batches):
        for batch in slices(batches, 512):
            sizes, prints, keys, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words)
                sizes.append(len(found))
                if not len(found):
                    prints.append(None), keys.append(None), sketches.append(None)
                    continue
                best = minhash(found)
                key = salt.copy()
                for part in best[: bands * rows].reshape(bands, rows).T:
                    key = _mixed(key ^ part.astype(np.uint64)) * _STEP
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(key.view(np.int64))
                sketches.append(odd_sketch(best) + whole_sketch(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "row", "n", "print", "bands", "sketch"],
            )
        _HASHES.clear()  # workers are used again by other stages

    return docs.mapInArrow(run, "doc_id long, row long, n long, print binary, bands array<long>, sketch binary")


def _in_groups(batches, keys: list[str]):
    """Frames of whole groups from sorted batches, many small groups at once."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = np.ones(len(frame), bool)
        for k in keys:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        # Rows are sorted, so the last group is a suffix.
        at = len(frame) - int(last.sum())
        if at:
            yield frame.iloc[:at]
        rest = frame.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _bits(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _compared(bits: np.ndarray, sizes: np.ndarray, one_bits: np.ndarray, one_size, most: int, percent: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits by which the samples' sketches differ, and whether a link is possible."""
    differ = np.bitwise_count(bits ^ one_bits)
    distance = differ[:, : SKETCH_BITS // 64].sum(1, dtype=np.int32)
    whole = differ[:, SKETCH_BITS // 64 :].sum(1, dtype=np.int32)
    fits = 100 * np.minimum(sizes, one_size) >= percent * np.maximum(sizes, one_size)
    # |A xor B| <= (|A| + |B|) (1 - s) / (1 + s)
    fits &= (100 + percent) * whole <= (sizes + one_size) * (100 - percent)
    return distance, fits & (distance <= most)


def _forest(bits: np.ndarray, sizes: np.ndarray, most: int, percent: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the nearest admissible pairs (Prim's, a row of distances at a time)."""
    m = len(sizes)
    far = np.iinfo(np.int32).max
    near, parent, out = np.full(m, far, np.int32), np.zeros(m, np.int64), []
    todo = np.ones(m, bool)
    now = 0
    for _ in range(m):
        todo[now] = False
        if near[now] <= most:
            out.append((int(parent[now]), now))
        distance, fits = _compared(bits, sizes, bits[now], sizes[now], most, percent)
        closer = todo & fits & (distance < near)
        near[closer], parent[closer] = distance[closer], now
        if todo.any():
            now = int(np.where(todo, near, far).argmin()) if (near[todo] < far).any() else int(todo.argmax())
    return out


def _crossing(bits: np.ndarray, sizes: np.ndarray, group: np.ndarray, most: int, percent: float) -> list[tuple[int, int]]:
    """Admissible pairs between different components."""
    out = []
    for i in range(len(sizes) - 1):
        other = group[i + 1 :] != group[i]
        if other.any():
            at = np.flatnonzero(other) + i + 1
            _, near = _compared(bits[at], sizes[at], bits[i], sizes[i], most, percent)
            out += [(i, int(j)) for j in at[near]]
    return out


def _proposals(members: DataFrame, percent: float, crossing: bool) -> DataFrame:
    """Pairs (a, b), a < b, that the buckets propose; repeated over bands are one."""
    most = most_bits(percent)

    def run(batches):
        for frame in _in_groups(batches, ["key", "unit"]):
            first = ((frame["key"] != frame["key"].shift()) | (frame["unit"] != frame["unit"].shift())).to_numpy()
            edges = np.append(np.flatnonzero(first), len(frame))
            nodes, sizes, bits = frame["node"].to_numpy(), frame["n"].to_numpy(), _bits(frame["sketch"].tolist())
            group = frame["label"].to_numpy() if crossing else None
            pairs: list[tuple[int, int]] = []
            counts = np.diff(edges)
            two = edges[:-1][counts == 2]
            if len(two):  # most buckets
                _, good = _compared(bits[two], sizes[two], bits[two + 1], sizes[two + 1], most, percent)
                if crossing:
                    good &= np.array([group[i] != group[i + 1] for i in two], bool)
                pairs += [(int(i), int(i) + 1) for i in two[good]]
            for at, count in zip(edges[:-1][counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
                part = slice(at, at + count)
                found = _crossing(bits[part], sizes[part], group[part], most, percent) if crossing else _forest(bits[part], sizes[part], most, percent)
                pairs += [(at + i, at + j) for i, j in found]
            if pairs:
                a, b = (nodes[list(x)] for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    dealt = members.repartition("key", "unit").sortWithinPartitions("key", "unit", "node")
    return dealt.mapInArrow(run, "a long, b long").where("a < b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in slices(batches, 256):
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, print, row)."""
    slot = F.pmod("row", F.lit(1 << BITMAP_BITS))
    held = wanted.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    bitmap[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    bitmap = bitmap.view(np.uint64)

    def run(batches):
        given: set[bytes] = set()  # rows that share id and text are given once a task, as long as this has room
        for batch in slices(batches, 2048):
            at = batch.column("slot").to_numpy()
            keep = (bitmap[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            for part in slices([batch.filter(pa.array(keep))], 256):
                rows, prints, found = [], [], []
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    one = shingle_set(text, words).tobytes()
                    mark = xxhash.xxh3_128_digest(one)
                    if mark not in given:
                        rows.append(row), prints.append(mark), found.append(one)
                        if len(given) < WORDS_CACHED:
                            given.add(mark)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())], ["row", "print", "shingles"])
        _HASHES.clear()

    found = docs.select("row", "text", slot.alias("slot")).mapInArrow(run, "row long, print binary, shingles binary")
    return found.join(wanted.select("node", "print"), "print").select("node", "shingles").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node reaches, by alternating large and small stars."""

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        # Large star: larger neighbours of a node move to its least neighbour (or itself).
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        edges = edges.join(least, edges["b"] == least["c"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node's smaller neighbours and itself move to the least of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        moved = edges.join(least, edges["a"] == least["c"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, unit, node) from (key, node): buckets of two nodes or more; large ones in random chunks, DEALS times."""
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    chunks = F.ceil(F.col("c") / CHUNK)
    several = F.array(*[F.lit(i) * chunks + F.pmod(F.xxhash64("node", F.lit(i)), chunks) for i in range(DEALS)])
    units = F.when(F.col("c") <= CHUNK, F.array(F.lit(0).cast("long"))).otherwise(several)
    return rows.join(shared, "key").select("key", F.explode(units).alias("unit"), "node")


def _parted(members: DataFrame) -> DataFrame:
    """(key, unit, node, label) from (key, node, label): buckets of several components, in units that hold each pair of nodes of different components together."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("c") <= CHUNK, F.col("c")).otherwise(0)).alias("rest"), F.sum("c").alias("all")).where("labels > 1")
    small = F.col("all") <= CHUNK
    whole = members.join(mixed.where(small).select("key"), "key").select("key", F.lit("").alias("unit"), "node", "label")

    # Chunks of a large bucket: of a component with many nodes here (own = its label), or of all others together.
    large = cut(sizes.join(mixed.where(~small).select("key", "rest"), "key"))
    own = F.when(F.col("c") > CHUNK, F.col("label"))
    parts = F.when(F.col("c") > CHUNK, F.ceil(F.col("c") / CHUNK)).otherwise(F.ceil(F.col("rest") / CHUNK))
    chunks = large.select("key", own.alias("own"), parts.alias("parts")).distinct()
    chunks = chunks.select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    chunks = chunks.withColumn("chunk", F.struct(F.coalesce("own", F.lit(-1).cast("long")).alias("own"), "part"))
    other = chunks.select("key", F.col("own").alias("own2"), F.col("chunk").alias("chunk2"))
    met = chunks.join(other, "key").where((F.col("chunk") <= F.col("chunk2")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    unit = F.concat_ws(":", *[F.col(f"{c}.{f}").cast("string") for c in ("chunk", "chunk2") for f in ("own", "part")])
    met = met.select("key", F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"), unit.alias("unit"))
    hashed = F.xxhash64(F.when(F.col("c") > CHUNK, F.col("node")).otherwise(F.col("label")))
    mine = F.struct(F.coalesce(own, F.lit(-1).cast("long")).alias("own"), F.pmod(hashed, parts).alias("part"))
    placed = members.join(large, ["key", "label"]).withColumn("chunk", mine)
    return whole.union(placed.join(met, ["key", "chunk"]).select("key", "unit", "node", "label"))


def text_hash(doc_id: Column, text: Column) -> Column:
    """Together with the id, what a row is found by again."""
    return F.xxhash64(doc_id, text, doc_id.isNull())


def near_duplicates(df: DataFrame, words: int = 5, percent: float = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, first) of every row.

    `first` is true for the one document that stands for its group: the least id (null last), then the least text_hash;
    documents without words stand for themselves. A row is found again by its id and `text_hash`.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("row", text_hash(F.col("doc_id"), F.col("text")))
    signed = cut(_signatures(docs, words, percent))
    # From here on a set is a node, numbered once and for all by the checkpoint.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = signed.where("n > 0").groupBy("print").agg(F.min(rank).alias("rank"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = cut(nodes.withColumns({"node": F.monotonically_increasing_id(), "row": F.col("rank.row")}))

    sketches = nodes.select("node", "n", "sketch")
    members = cut(_dealt(nodes.select("node", F.explode("bands").alias("key"))))
    pairs = cut(_proposals(members.join(sketches, "node"), percent, crossing=False))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(_sets(docs, cut(nodes.select("node", "print", "row").join(ends, "node")), words))
    links = cut(_confirmed(pairs, sets, percent))
    found = cut(components(links))

    # A large bucket's deals may have held apart nodes that are in no pair; in a small one these are linked with nothing.
    held = members.groupBy("key", "node").agg(F.max("unit").alias("unit")).select("key", "node", (F.col("unit") > 0).alias("large"))
    again = held.join(ends.withColumn("paired", F.lit(True)), "node", "left").where("paired or large").select("key", "node")
    again = again.join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    more = _proposals(_parted(cut(again)).join(sketches, "node"), percent, crossing=True)
    more = cut(more.join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        ends = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct().join(sets.select("node"), "node", "left_anti")
        lacking = cut(nodes.select("node", "print", "row").join(ends, "node"))
        if not lacking.isEmpty():
            sets = sets.union(cut(_sets(docs, lacking, words)))
        added = cut(_confirmed(more, sets, percent))
        if not added.isEmpty():
            found = cut(components(links.union(added)))

    heads = nodes.select("node", "rank").join(found, "node").groupBy("label").agg(F.min("rank").alias("head"))
    heads = found.join(heads, "label").select("node", "head")
    heads = nodes.select("node", "print", "rank").join(heads, "node", "left").select("print", F.coalesce("head", "rank").alias("head"))
    full = signed.where("n > 0").select("doc_id", "row", "n", "print").join(cut(heads), "print").select("doc_id", "row", "n", "head")
    empty = signed.where("n = 0").select("doc_id", "row", "n", rank.alias("head"))
    component = F.col("head.doc_id")
    first = F.col("doc_id").eqNullSafe(component) & (F.col("row") == F.col("head.row"))
    return full.union(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("row").alias("text_hash"), first.alias("first")
    )
