import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volatide.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "k") for i, v in rows], SCHEMA)


def usable(rows, zeros):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v)):
            out[i] = np.array(v, np.float32).astype(float)
    return out


def brute(x, is_query, k):
    out = {}
    for q in x:
        if is_query(q):
            scores = sorted(((-float((x[q] * x[v]).sum()), v) for v in x if v != q))[:k]
            out[q] = [(v, -s) for s, v in scores]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def messy(n, d, seed, copies=60):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    rows += [(n + i, [0.5] * d) for i in range(copies)]  # a common vector: ties
    return rows + [(n + 100, None), (n + 101, [float("nan")] * d), (n + 102, [None] * d), (n + 103, [0.0] * d), (None, [1.0] * d), (n + 104, [float("inf")] * d), (n + 105, []), (n + 106, [1.0] * (d + 1))]


@pytest.mark.parametrize("block", [16, 512])
def test_exact_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "LEAST_BLOCK", block)
    rows = messy(300, 12, 3)
    x = {i: np.floor(256 * v) for i, v in usable(rows, True).items() if len(v) == 12}
    assert collect(topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0)) == brute(x, lambda q: q % 5 == 0, 5)


def test_few_rows_and_empty_tables(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (50, [3.0, -1.0]), (50, [3.0, -1.0])])
    assert collect(topk.top_k(two, F.col("vec_id") % 50 == 0)) == {0: [(50, 65536)], 50: [(0, 65536)]}
    assert collect(ann.neighbours(two, F.col("vec_id") % 50 == 0)) == {0: [(50, 1.0)], 50: [(0, 1.0)]}
    for f in (topk.top_k, ann.neighbours):
        assert f(two.where("1 = 0"), F.lit(True)).count() == 0
        assert f(frame(spark, [(1, None)]), F.lit(True)).count() == 0
        assert f(frame(spark, [(0, [1.0])]), F.lit(True)).count() == 0


@pytest.mark.parametrize(("find", "k"), [(topk.top_k, 5), (ann.neighbours, 20)])
def test_repeated_rows_take_no_places(spark, find, k):
    rng = np.random.default_rng(4)
    rows = [(i, [*rng.normal(size=4).round(2).tolist(), 3.0]) for i in range(60)]
    again = [*rows, *(r for r in rows if r[0] < 6 for _ in range(30))]
    many = collect(find(frame(spark, again), F.col("vec_id") % 20 == 0, k=k))
    x = {i: np.floor(256 * v) if find is topk.top_k else v for i, v in usable(rows, True).items()}
    expected = brute(x, lambda q: q % 20 == 0, k)
    hits = [len({v for v, _ in many[q]} & {v for v, _ in expected[q]}) / k for q in expected]
    assert all(len(many[q]) == k for q in expected) and np.mean(hits) >= (1 if find is topk.top_k else 0.9)


def test_neighbours_with_ties_and_unusable_vectors(spark):
    rows = messy(400, 8, 5)
    x = {i: v for i, v in usable(rows, False).items() if len(v) == 8}
    expected, found = brute(x, lambda q: q % 20 == 0, 20), collect(ann.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert set(found) == set(expected)
    hits = [len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected]
    assert np.mean(hits) / 20 > 0.93
    for q, got in found.items():
        assert got == sorted(got, key=lambda p: (-p[1], p[0])) and len(got) == 20
        assert all(s == float((x[q] * x[v]).sum()) for v, s in got)


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    expected, found = brute(x, lambda q: q % 20 == 0, 20), collect(ann.neighbours(df, F.col("vec_id") % 20 == 0))
    assert sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected) / (20 * len(expected)) >= 0.95


def test_bundles_split_large_groups_and_pack_small_ones():
    b = vectors.Bundles(np.array([3, 100, 2, 0, 5, 9]), 10)
    assert b.blocks.tolist() == [1, 10, 1, 1, 1, 1]
    for g in range(6):
        assert all(g in b.members[i] for i in range(b.first[g], b.first[g] + b.blocks[g]))
    assert all(sum(n for g, n in enumerate([3, 0, 2, 0, 5, 9]) if g in m and b.blocks[g] == 1) <= 10 for m in b.members)


def clustered(n, d, clusters, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d))
    return [(i, (centers[i % clusters] + spread * rng.normal(size=d)).tolist()) for i in range(n)]


def test_bounds_rule_out_most_of_clustered_data(spark):
    rows = clustered(1500, 16, 25, 6, 0.05)
    df, x = frame(spark, rows), {i: np.floor(256 * v) for i, v in usable(rows, True).items()}
    is_query = F.col("vec_id") % 50 == 0
    assert 0 < topk.searched(df, is_query) < 0.5
    assert collect(topk.top_k(df, is_query)) == brute(x, lambda q: q % 50 == 0, 5)


def recall(expected, found, k):
    return np.mean([len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) / k for q in expected])


def test_few_lists_of_clustered_data_are_searched(spark):
    rows = clustered(4000, 16, 40, 7, 0.3)
    df, x = frame(spark, rows), usable(rows, False)
    is_query = F.col("vec_id") % 20 == 0
    assert 0 < ann.searched(df, is_query) < 0.5
    assert recall(brute(x, lambda q: q % 20 == 0, 20), collect(ann.neighbours(df, is_query)), 20) >= 0.93


def test_long_lists_are_parted_again(spark, monkeypatch):
    for name, value in (("CENTROIDS", 6), ("LIST_ROWS", 40), ("PART_ROWS", 200)):
        monkeypatch.setattr(ann, name, value)
    rows = clustered(3000, 12, 60, 8, 0.4)
    df, x = frame(spark, rows), usable(rows, False)
    found = collect(ann.neighbours(df, F.col("vec_id") % 20 == 0))
    assert recall(brute(x, lambda q: q % 20 == 0, 20), found, 20) >= 0.9
    assert all(len(v) == 20 and len({i for i, _ in v}) == 20 for v in found.values())


def test_the_graph_meets_what_all_distances_give():
    rng = np.random.default_rng(3)
    points, q = rng.normal(size=(300, 6)), rng.normal(size=(50, 6))
    graph = ann.Graph(points)
    away = ann.distances(q, points) + graph.floor
    want = away <= 1.3 * away.min(1)[:, None]
    met = graph.within(q, 1.3)
    assert not (met & ~want).any() and met.sum() > 0.95 * want.sum()


def test_huge_components_saturate(spark):
    rows = [(0, [1e30, 1.0]), (50, [1e30, -1.0]), (1, [3e8, 1e8]), (2, [-1e30, 0.0]), (100, [3e8, 1e8 + 8])]
    found = collect(topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0))
    top, big = 2**63 - 1, lambda x: math.floor(256 * float(np.float32(x)))
    assert found[0][:2] == [(1, top), (50, top)] and found[0][-1] == (2, -(2**63))
    assert dict(found[100])[1] == min(top, big(3e8) ** 2 + big(1e8) * big(1e8 + 8))
