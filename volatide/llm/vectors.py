"""What both vector searches share: clean vectors, blocks of bounded size, local search and merging.

Data rows carry a group (a Voronoi cell or a posting list). Groups are packed into bundles of at most about
`block_rows` rows; a larger group is split over several bundles by a hash of the id, so a group with a third of all
rows needs no large task. Queries are matrices of at most QUERIES_AT_ONCE rows, one copy for each bundle that holds
a group they need. A bundle's rows come sorted, data first and by group; queries then stream past them. Products are
made of a query and the groups that it needs, and of no others; a large group may be parted further where it is held.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volatide.llm.common import slices

QUERIES_AT_ONCE = 512
SCORES_AT_ONCE = 4_000_000


def clean(df: DataFrame, scale: int | None = None, zeros: bool = True) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and their dimension (the most common one)."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    if not zeros:
        x = x.where(F.exists("v", lambda c: c != 0))
    if scale is not None:
        x = x.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))
    dimension = x.agg(F.mode(F.size("v"), True)).first()[0] or 0
    return x.where(F.size("v") == dimension), dimension


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dimension)


def packed(rows: np.ndarray) -> pa.Array:
    """A row of the matrix as a binary value each."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), dimension)


def sample(x: DataFrame, rows: int, total: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most `rows` of `total` rows, the first by a hash of the id; each id once.

    A hash threshold leaves about twice as many before they are ordered, however many partitions there are.
    """
    h = F.pmod(F.xxhash64("vec_id"), F.lit(2**32))
    if total > 2 * rows + 200:
        x = x.where(h < int(2 * rows / total * 2**32))
    got = x.orderBy(h, "vec_id").limit(rows).toArrow().combine_chunks()
    ids = got.column("vec_id").to_numpy()
    column = got.column("v").combine_chunks() if got.num_rows else None
    vectors = matrix(column, dimension) if got.num_rows else np.zeros((0, dimension))
    ids, at = np.unique(ids, return_index=True)
    return ids, vectors[at]


class Bundles:
    """Where the rows of each group are: bundles first[g] .. first[g] + blocks[g] - 1."""

    def __init__(self, counts: np.ndarray, block_rows: int):
        self.first, self.blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        bundle, held = 0, 0
        for g, n in enumerate(counts.tolist()):
            blocks = -(-n // block_rows)
            if blocks > 1 or held + n > block_rows:
                bundle, held = bundle + (held > 0), 0
            self.first[g], self.blocks[g] = bundle, max(1, blocks)
            if blocks > 1:
                bundle += blocks
            else:
                held += n
        self.count = int((self.first + self.blocks).max()) if len(counts) else 0
        self.members = [np.flatnonzero((self.first <= b) & (b < self.first + self.blocks)) for b in range(self.count)]


def best(scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores, with those within a relative `slack` of the k-th and all its ties."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        edge = edge - slack * np.abs(edge)
        return np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def runs(grp: np.ndarray) -> np.ndarray:
    """Where the runs of equal groups begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(grp))


def needed_share(queries: DataFrame, needed: Callable, counts: np.ndarray, dimension: int) -> DataFrame:
    """One row (asked, pairs): products of queries and data that the groups needed hold, of all pairs."""

    def run(batches):
        for batch in slices(batches, QUERIES_AT_ONCE):
            if batch.num_rows:
                asked = int((needed(batch.column(0).to_numpy(), batch.column(2).to_numpy(), unpacked(batch.column(1), dimension)) @ counts).sum())
                yield pa.RecordBatch.from_arrays([pa.array([asked]), pa.array([batch.num_rows * int(counts.sum())])], ["asked", "pairs"])

    return queries.select("vec_id", "v", "grp").mapInArrow(run, "asked long, pairs long").agg(F.sum("asked").alias("asked"), F.sum("pairs").alias("pairs"))


def search(
    data: DataFrame,
    queries: DataFrame,
    needed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    counts: np.ndarray,
    dimension: int,
    k: int,
    block_rows: int,
    integer: bool,
    replicas: int = 1,
    parted: Callable[[np.ndarray], tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]] | None] | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) from data (grp, vec_id, v binary), distinct in each group, and queries (vec_id, v binary, grp).

    A row is in at most `replicas` groups.
    needed(ids, groups, vectors) gives for each query the groups it has to see. parted(rows), if it is given, may part
    the rows of a group: it gives each row's part and a function from queries to the parts that they have to see.
    """
    bundles = Bundles(counts, block_rows)

    def place(batches):
        for batch in batches:
            grp, hashed = batch.column("grp").to_numpy(), batch.column("h").to_numpy()
            at = bundles.first[grp] + hashed % bundles.blocks[grp]
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.zeros(len(at), np.int32)), pa.array(grp, pa.int64()), batch.column("vec_id"), batch.column("v"), none], names)

    def ask(batches):
        for batch in slices(batches, QUERIES_AT_ONCE):
            ids, q = batch.column(0).to_numpy(), unpacked(batch.column(1), dimension)
            if not len(ids):
                continue
            wanted = needed(ids, batch.column(2).to_numpy(), q)
            rows = []
            for b, members in enumerate(bundles.members):
                mask = wanted[:, members]
                use = np.flatnonzero(mask.any(1))
                if len(use):
                    rows.append((b, len(use), ids[use].astype(np.int64).tobytes() + q[use].tobytes(), np.packbits(mask[use]).tobytes()))
            if rows:
                at, n, payload, mask = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([1] * len(at), pa.int32()), pa.array([0] * len(at), pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(mask, pa.binary())], names)

    names = ["bundle", "side", "grp", "vec_id", "payload", "mask"]
    schema = "bundle long, side int, grp long, vec_id long, payload binary, mask binary"
    hashed = data.select("grp", "vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(2**31)).alias("h"))
    # Queries of one group stand together, so that those of a block need like groups.
    asked = queries.select("vec_id", "v", "grp").sortWithinPartitions("grp", "vec_id")
    both = hashed.mapInArrow(place, schema).union(asked.mapInArrow(ask, schema))
    dealt = both.repartition(max(1, bundles.count), "bundle").sortWithinPartitions("bundle", "side", "grp")
    kind = np.int64 if integer else float

    def solve(batches):
        now, held, ready = None, [], None
        for batch in batches:
            bundle, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero((np.diff(bundle) != 0) | (np.diff(side) != 0)) + 1
            for at, to in zip([0, *turns.tolist()], [*turns.tolist(), len(bundle)], strict=True):
                if at == to:
                    continue
                if bundle[at] != now:
                    now, held, ready = bundle[at], [], None
                part = batch.slice(at, to - at)
                if side[at] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), unpacked(part.column(4), dimension)))
                    continue
                if not held:
                    continue
                members = bundles.members[int(now)]
                if ready is None:
                    ready, held = load(members, *(np.concatenate(x) for x in zip(*held, strict=True))), [None]
                for n, payload, mask in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    ids, q = np.frombuffer(payload[: 8 * n], np.int64), np.frombuffer(payload[8 * n :], float).reshape(n, dimension)
                    use = np.unpackbits(np.frombuffer(mask, np.uint8), count=n * len(members)).reshape(n, -1).astype(bool)
                    yield from answer(ids, q, use, *ready)

    def load(members, grp, vec, x):
        """Ids and vectors by group and part, groups as (slot among the members, bounds of the parts, choice of parts), and the largest component."""
        groups, edges = [], runs(grp)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            slot, bounds, choose = int(np.searchsorted(members, grp[a])), np.array([a, b]), None
            if parted is not None and (found := parted(x[a:b])) is not None:
                part, choose = found
                order = np.argsort(part, kind="stable")
                vec[a:b], x[a:b] = vec[a:b][order], x[a:b][order]
                bounds = a + np.append(np.searchsorted(part[order], np.arange(part.max() + 1)), b - a)
            groups.append((slot, bounds, choose))
        return vec, x, groups, np.abs(x).max(initial=0)

    def pieces(q, use, groups):
        """(queries, from, to): slices of rows that the same queries need."""
        for slot, bounds, choose in groups:
            mine = np.flatnonzero(use[:, slot])
            if len(mine) and choose is None:
                yield mine, int(bounds[0]), int(bounds[-1])
            elif len(mine):
                wanted = choose(q[mine])
                for j in range(len(bounds) - 1):
                    some = mine[wanted[:, j]]
                    if len(some) and bounds[j + 1] > bounds[j]:
                        yield some, int(bounds[j]), int(bounds[j + 1])

    def joined(q, use, groups):
        """The pieces, neighbours that the same queries need as one."""
        last = None
        for mine, a, b in pieces(q, use, groups):
            if last is not None and last[2] == a and np.array_equal(last[0], mine):
                last = (mine, last[1], b)
                continue
            if last is not None:
                yield last
            last = (mine, a, b)
        if last is not None:
            yield last

    def answer(ids, q, use, vec, x, groups, biggest):
        exact = not integer or np.abs(q).max() * biggest * dimension < 2**53
        slack = 0.0 if integer and exact else 1e-6 if integer else 1e-9
        who, which = [], []
        for mine, a, b in joined(q, use, groups):
            step = max(1, SCORES_AT_ONCE // (b - a))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                scores = q[some] @ x[a:b].T
                scores[ids[some][:, None] == vec[a:b]] = -np.inf
                row, column = best(scores, k * replicas, slack)
                who.append(some[row])
                which.append(column + a)
        if not who:
            return
        who, which = np.concatenate(who), np.concatenate(which)
        # The same sum for equal vectors, wherever they stand in a block.
        a, b = q[who], x[which]
        if not integer:
            final = (a * b).sum(1)
        elif exact:
            final = (a.astype(np.int64) * b.astype(np.int64)).sum(1)
        else:  # whole numbers of any size, cut off at 64 bits
            whole = np.frompyfunc(int, 1, 1)
            final = np.array([min(max(t, -(2**63)), 2**63 - 1) for t in (whole(a) * whole(b)).sum(1)], np.int64)
        order = np.lexsort((vec[which], -final, who))
        who, which, final = who[order], which[order], final[order]
        copy = np.zeros(len(who), bool)  # replicas in several groups
        copy[1:] = (who[1:] == who[:-1]) & (vec[which[1:]] == vec[which[:-1]]) & (final[1:] == final[:-1])
        who, which, final = who[~copy], which[~copy], final[~copy]
        keep = np.arange(len(who)) - np.searchsorted(who, who, side="left") < k
        yield pa.RecordBatch.from_arrays([pa.array(ids[who[keep]]), pa.array(vec[which[keep]]), pa.array(final[keep].astype(kind))], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(solve, f"query_id long, vec_id long, score {'long' if integer else 'double'}").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
