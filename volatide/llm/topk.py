"""Exact top-k by integer inner product: a Voronoi kNN join.

Queries and data are grouped by the nearest of a bounded number of pivots (rows of the data, picked by a hash). Each
group's summary is its pivot, its size, its radius and its largest norm.

A group of queries with pivot s and radius t, and a group of data with pivot p, radius r and largest norm m: every
product of theirs lies between s.p - d and min(s.p + d, (|s| + t) m), with d = |s| r + t |p| + t r. The group's bound is
what the data groups with the highest lower limits, of k members at least, reach; data groups whose upper limit doesn't
are of no use to any query of the group. Each query then narrows this down alike, with t = 0 and a second bound: the
k-th best product with the pivots themselves. Only groups whose upper limit reaches both bounds are searched; queries
are replicated to the bundles that hold such groups and solved there exactly, a group at a time.

How much this saves depends on the data: `searched` tells. Where all directions are alike no bound can rule much out.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
so do vectors of another length than the most common one; equal scores go to the smaller id; rows that repeat both
id and vector count once; an empty table gives an empty table; extra columns are ignored. Scores are exact in 64-bit
integers; scaled components and scores beyond these are cut off at their ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.llm import vectors
from volatide.llm.common import cut

#: At most so many pivots; a bounded closure.
PIVOTS = 512
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 512, 65_536, 16


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    at = squares.argmin(1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(1))


class Index:
    """Grouped data, its summaries, and which groups a query has to see."""

    def __init__(self, df: DataFrame, k: int, scale: int):
        x, self.dimension = vectors.clean(df, scale=scale)
        self.total = x.count()
        if not self.total:
            return
        pivot_ids, pivots = vectors.sample(x, int(min(PIVOTS, max(4, self.total**0.5 / 2))), self.total, self.dimension)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    rows = vectors.matrix(batch.column(1), self_dimension)
                    grp, distance = nearest(rows, pivots)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(grp, pa.int64()), pa.array(distance), pa.array(np.sqrt((rows * rows).sum(1))), vectors.packed(rows)], ["vec_id", "grp", "distance", "norm", "v"]
                    )

        self_dimension = self.dimension
        # Repeated rows would count as several candidates in the bounds.
        self.data = cut(x.mapInArrow(assign, "vec_id long, grp long, distance double, norm double, v binary").dropDuplicates(["vec_id", "v"]))
        summaries = self.data.groupBy("grp").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm")).toPandas()  # at most PIVOTS rows
        counts, radius, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        at = summaries["grp"].to_numpy()
        counts[at], radius[at], norm[at] = summaries["n"], summaries["radius"], summaries["norm"]
        self.counts = counts
        lengths = np.sqrt((pivots * pivots).sum(1))

        def reach(product: np.ndarray, slack: np.ndarray, high: np.ndarray, bound: np.ndarray | float = -np.inf) -> np.ndarray:
            """Groups whose upper limit reaches what k candidates (and the query itself, perhaps) reach."""
            low = np.where(counts > 0, product - slack, -np.inf)
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k + 1
            sorted_low = np.take_along_axis(low, order, 1)
            bound = np.maximum(bound, np.where(enough.any(1), np.take_along_axis(sorted_low, enough.argmax(1)[:, None], 1)[:, 0], -np.inf))
            return (counts > 0) & (np.minimum(product + slack, high) >= (bound - 1e-6 * (1 + np.abs(bound)))[:, None])

        between = pivots @ pivots.T
        spread = lengths[:, None] * radius + radius[:, None] * lengths + radius[:, None] * radius
        useful = reach(between, spread, (lengths + radius)[:, None] * norm)

        def needed(ids: np.ndarray, grp: np.ndarray, q: np.ndarray) -> np.ndarray:
            size = np.sqrt((q * q).sum(1))[:, None]
            product = q @ pivots.T
            others = np.where(ids[:, None] == pivot_ids, -np.inf, product)
            kth = np.partition(others, -k, axis=1)[:, -k] if others.shape[1] >= k else -np.inf
            return useful[grp] & reach(product, size * radius, size * norm, kth)

        self.needed = needed


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` (over vec_id) holds, against all other rows."""
    index = Index(df, k, scale)
    if not index.total:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, -(-index.total // BLOCKS))))
    return vectors.search(index.data.select("grp", "vec_id", "v"), index.data.where(is_query), index.needed, index.counts, index.dimension, k, block, integer=True)


def searched(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> float:
    """The share of all pairs of a query and a row whose product is made."""
    index = Index(df, k, scale)
    if not index.total:
        return 0.0
    row = vectors.needed_share(index.data.where(is_query), index.needed, index.counts, index.dimension).first()
    return (row["asked"] or 0) / max(1, row["pairs"] or 0)
