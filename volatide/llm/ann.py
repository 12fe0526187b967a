"""Approximate nearest neighbours by largest inner product: balanced posting lists behind a graph of centroids.

A component sqrt(M^2 - |x|^2) (M: the largest norm) is appended to each vector, which turns the largest inner product
into the smallest Euclidean distance. Centroids are fitted by k-means on a bounded sample. A vector joins its nearest
centroid's list; a boundary vector also joins up to REPLICAS - 1 others whose distance is within BOUNDARY times the
nearest, unless such a centroid is nearer to one already chosen than APART times the vector. Lists are balanced: long ones
are split into blocks, short ones packed. A query walks a nearest-neighbour graph over the centroids, held in memory,
expanding every centroid whose distance is within a ratio of the best met so far; the lists within that ratio are
searched with exact products in double precision.

The ratio is the one parameter of recall. It is set on the sample: of a few hundred sample queries' true neighbours
in the sample, AIM must lie in a list within the ratio.

There are at most CENTROIDS such centroids, whatever the number of rows, so lists grow with the table. A list of more
than PART_ROWS rows is parted again where it is held, in the same way: centroids fitted to its own rows, a graph, and
a ratio set on its rows. So what a query is compared with in a list grows with the square root of the list at most.

Bounds, as documented parameters: SAMPLE rows to fit, at most CENTROIDS centroids (and as many in a list). Every row is
indexed. How much is searched depends on the data: `searched` tells. Where all directions are alike, neighbours are
hardly nearer than other rows, and most lists must be searched for AIM.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no
part; so do vectors of another length than the most common one; equal scores go to the smaller id; rows that repeat
both id and vector count once; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.llm import vectors
from volatide.llm.common import cut

SAMPLE = 16_384
CENTROIDS = 2048
LIST_ROWS = 256
REPLICAS = 2
BOUNDARY = 1.03
APART = 0.5
DEGREE = 24
AIM = 0.96
#: Rows of a list above which it is parted again, and rows of a part.
PART_ROWS = 8 * LIST_ROWS
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 512, 65_536, 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def centroids_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    found = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        owner = distances(x, found).argmin(1)
        counts = np.bincount(owner, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, owner, x)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return found


class Graph:
    """Nearest neighbours of each centroid, both ways, and a few far links.

    `floor` is added to all distances that are compared by ratio, so that a query on a centroid still has a ratio.
    """

    def __init__(self, points: np.ndarray, seed: int = 5):
        self.points, self.floor = points, 1e-9
        n = len(points)
        rng = np.random.default_rng(seed)
        between = distances(points, points)
        np.fill_diagonal(between, np.inf)
        self.between = between
        joined = np.zeros((n, n), bool)
        if n > 1:
            degree = min(DEGREE, n - 1)
            near = np.argpartition(between, degree - 1, axis=1)[:, :degree]
            joined[np.arange(n)[:, None], near] = True
            joined[np.arange(n)[:, None], rng.integers(0, n, (n, 4))] = True
        # Links as lists: those of point i are links[first[i] : first[i + 1]].
        which, self.links = np.nonzero(joined | joined.T)
        self.first = np.searchsorted(which, np.arange(n + 1))
        self.entries = np.unique(rng.integers(0, n, 4))

    def within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """For each query the centroids met whose distance is within `ratio` of the nearest met."""
        met = np.full((len(q), len(self.points)), np.inf)
        met[:, self.entries] = distances(q, self.points[self.entries]) + self.floor
        waiting = np.isfinite(met)  # met, and its links not followed
        while True:
            who, at = np.nonzero(waiting)
            near = met[who, at] <= ratio * met.min(1)[who]
            who, at = who[near], at[near]
            if not len(who):
                return met <= ratio * met.min(1)[:, None]
            waiting[who, at] = False
            many = self.first[at + 1] - self.first[at]
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, what = np.repeat(who, many), self.links[np.repeat(self.first[at], many) + offset]
            fresh = np.zeros(met.shape, bool)
            fresh[who, what] = True
            who, what = np.nonzero(fresh & np.isinf(met))
            step = q[who] - self.points[what]
            met[who, what] = np.sqrt((step * step).sum(1)) + self.floor
            waiting[who, what] = True


def enough(chosen: np.ndarray, q: np.ndarray, graph: Graph, sizes: np.ndarray, k: int) -> np.ndarray:
    """The lists chosen, and for queries for which they hold fewer than k other rows, the nearest lists that do."""
    short = np.flatnonzero(chosen @ sizes < k + 1)
    if len(short):
        order = np.argsort(distances(q[short], graph.points), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        more = np.zeros((len(short), len(sizes)), bool)
        np.put_along_axis(more, order, held - sizes[order] < k + 1, axis=1)
        chosen[short] |= more
    return chosen


def lists_of(x: np.ndarray, graph: Graph) -> np.ndarray:
    """(rows, REPLICAS) centroids of each vector, -1 where there is no further one."""
    away = distances(x, graph.points)
    width = min(2 * REPLICAS + 2, away.shape[1])
    order = np.argpartition(away, width - 1, axis=1)[:, :width]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(away, order, 1), axis=1, kind="stable"), 1)
    out = np.full((len(x), REPLICAS), -1)
    out[:, 0] = order[:, 0]
    used = np.ones(len(x), np.int64)
    first = away[np.arange(len(x)), order[:, 0]]
    for j in range(1, width):
        c = order[:, j]
        own = away[np.arange(len(x)), c]
        fits = (used < REPLICAS) & (own <= BOUNDARY * first)
        for r in range(REPLICAS):
            fits &= (out[:, r] < 0) | (graph.between[c, out[:, r]] > APART * own)
        rows = np.flatnonzero(fits)
        out[rows, used[rows]] = c[rows]
        used[rows] += 1
    return out


def ratio_for(sampled: np.ndarray, lists: np.ndarray, queries: np.ndarray, selves: np.ndarray, graph: Graph, k: int) -> float:
    """The least ratio at which AIM of the sample's true neighbours lie in a searched list; sets the graph's floor."""
    away = distances(queries, sampled)
    away[np.arange(len(queries)), selves] = np.inf
    own = distances(queries, graph.points)
    graph.floor = max(1e-9, 0.5 * float(np.median(own.min(1))))
    needs = []
    for i in range(len(queries)):
        near = np.argsort(away[i], kind="stable")[: min(k, len(sampled) - 1)]
        reach = np.where(lists[near] >= 0, own[i][lists[near]], np.inf).min(1)
        needs.append((reach + graph.floor) / (own[i].min() + graph.floor))
    return float(np.quantile(np.concatenate(needs), AIM, method="higher")) * (1 + 1e-9)


class Index:
    """Posting lists of all rows, and which lists a query has to see."""

    def __init__(self, df: DataFrame, k: int):
        x, dimension = vectors.clean(df, zeros=False)
        self.dimension = dimension
        self.total, most = x.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
        if not self.total:
            return
        largest = most * (1 + 1e-9)

        def lifted(v: np.ndarray) -> np.ndarray:
            return np.column_stack([v, np.sqrt(np.maximum(largest - (v * v).sum(1), 0))])

        def aimed(v: np.ndarray) -> np.ndarray:
            return np.column_stack([v * (np.sqrt(largest) / np.sqrt((v * v).sum(1)))[:, None], np.zeros(len(v))])

        def fitted(v: np.ndarray, parts: int) -> tuple[Graph, float]:
            graph = Graph(centroids_of(lifted(v), parts))
            asked = np.arange(0, len(v), max(1, len(v) // 256))
            return graph, ratio_for(lifted(v), lists_of(lifted(v), graph), aimed(v[asked]), asked, graph, k) if len(v) > 1 else 1.0

        _, sampled = vectors.sample(x, SAMPLE, self.total, dimension)
        graph, ratio = fitted(sampled, int(min(CENTROIDS, max(8, self.total // LIST_ROWS))))

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    rows = vectors.matrix(batch.column(1), dimension) + 0.0  # no negative zeros
                    found = lists_of(lifted(rows), graph)
                    who, which = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(found[who, which], pa.int64()), pa.array(which == 0), vectors.packed(rows[who])], ["vec_id", "grp", "own", "v"])

        self.data = cut(x.mapInArrow(assign, "vec_id long, grp long, own boolean, v binary").distinct())
        counts, own = np.zeros(len(graph.points), np.int64), np.zeros(len(graph.points), np.int64)
        for row in self.data.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect():  # at most CENTROIDS rows
            counts[row["grp"]], own[row["grp"]] = row["n"], row["own"]
        self.counts = counts

        def needed(ids: np.ndarray, grp: np.ndarray, q: np.ndarray) -> np.ndarray:
            return enough(graph.within(aimed(q), ratio), aimed(q), graph, own, k) & (counts > 0)

        def parted(v: np.ndarray):
            """Parts of a long list by the nearest of its own centroids, and which of them a query has to see."""
            if len(v) <= PART_ROWS:
                return None
            inner, inner_ratio = fitted(v[:: -(-len(v) // SAMPLE)], int(min(CENTROIDS, len(v) // LIST_ROWS)))
            owner = np.concatenate([distances(lifted(v[at : at + 4096]), inner.points).argmin(1) for at in range(0, len(v), 4096)])
            sizes = np.bincount(owner, minlength=len(inner.points))
            return owner, lambda q: enough(inner.within(aimed(q), max(ratio, inner_ratio)), aimed(q), inner, sizes, k)

        self.needed, self.parted = needed, parted


def neighbours(df: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` (over vec_id) holds, against all other rows."""
    index = Index(df, k)
    if not index.total:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, -(-index.counts.sum() // BLOCKS))))
    return vectors.search(index.data.select("grp", "vec_id", "v"), index.data.where(is_query & F.col("own")), index.needed, index.counts, index.dimension, k, block, integer=False, replicas=REPLICAS, parted=index.parted)


def searched(df: DataFrame, is_query: Column, k: int = 20) -> float:
    """The number of products that the lists searched hold, as a share of all pairs of a query and an entry of a list."""
    index = Index(df, k)
    if not index.total:
        return 0.0
    row = vectors.needed_share(index.data.where(is_query & F.col("own")), index.needed, index.counts, index.dimension).first()
    return (row["asked"] or 0) / max(1, row["pairs"] or 0)
