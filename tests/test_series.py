"""Series that are spread over tasks: affine scans, likelihoods over blocks, sequences with a halo, gradients exchanged."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volatide.operators import garch, recurrence, residual


def returns(n, seed=1, alpha=0.1, beta=0.85):
    rng = np.random.default_rng(seed)
    v, y = 1.0, []
    for _ in range(n):
        v = 0.05 + alpha * (y[-1] if y else 0.0) ** 2 + beta * v
        y.append(math.sqrt(v) * rng.normal())
    return np.array(y) / 100


def frame(spark, y, name="a", **columns):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i + i // 5) for i in range(len(y))]
    return spark.createDataFrame(pd.DataFrame({"series_id": name, "date": days, "log_return": y, **columns}), ", ".join(["series_id string", "date date", "log_return double", *[f"{c} double" for c in columns]]))


def walk(y, p, sample, x=None):
    """The recursion a row at a time."""
    y = y * 100
    e, v = np.empty(len(y)), np.empty(len(y))
    for t in range(len(y)):
        e[t] = y[t] - p["c"] - (p["phi"] * y[t - 1] if t else 0.0)
        v[t] = max(sample, p["omega"] / max(1e-6, 1 - p["alpha"] - p["beta"])) if t == 0 else p["omega"] + p["alpha"] * e[t - 1] ** 2 + p["beta"] * v[t - 1] + (p["gamma"] * x[t - 1] if x is not None else 0.0)
    ahead = p["omega"] + p["alpha"] * e**2 + p["beta"] * v
    ahead[-1] = p["omega"] + (p["alpha"] + p["beta"]) * v[-1]
    if x is not None:
        ahead = np.maximum(ahead + p["gamma"] * x, 1e-12)
    return v / 1e4, ahead / 1e4, e / np.sqrt(v)


P = {"c": 0.02, "phi": 0.05, "omega": 0.04, "alpha": 0.08, "beta": 0.9, "gamma": 0.3}


def test_recurrence_equals_a_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000, 20_000):
        u = rng.normal(size=(n, 3))
        found, want = recurrence.recur(u, 0.97, np.ones(3)), np.ones((n + 1, 3))
        for t in range(n):
            want[t + 1] = u[t] + 0.97 * want[t]
        assert np.abs(found - want).max() < 1e-12


@pytest.mark.parametrize("exog", [None, "x"])
def test_one_series_in_fifty_blocks_equals_the_loop(spark, exog):
    y, x = returns(700), np.abs(np.random.default_rng(2).normal(size=700))
    df = frame(spark, y, x=x)
    assert recurrence.packed(df, ["log_return"], width=16).count() > 50
    got = garch.filter_series(df, P, exog=exog, width=16).orderBy("date").toPandas()
    want = walk(y, P, (y * 100).var(ddof=1), x if exog else None)
    for name, values in zip(("conditional_var", "forecast_var", "std_resid"), want):
        assert np.allclose(got[name], values, rtol=1e-9, atol=0)


def test_a_plan_of_the_filter_holds_no_series_in_a_group(spark):
    """Python sees a block's rows, and a row a block where a series is scanned."""
    y = returns(400)
    plan = garch.filter_series(frame(spark, y), P, width=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("FlatMapGroupsInPandas") == 1 and "Window" in plan


def test_scores_are_derivatives():
    y, x = returns(200) * 100, np.random.default_rng(4).normal(size=200)
    for sample, t in ((1.0, [0.1, 0.2, -1.0, 0.3, 1.2, 0.05]), (1e-9, [0.0, -0.3, -2.0, -1.0, 0.5, 0.01])):
        def f(t):
            p = garch.natural(t, 1.0)
            value, slope = garch.score(*garch.states(p, y, x, None, garch.seed(p, sample)))
            return value, garch.by_point(t, p, slope, 1.0)

        t = np.array(t)
        value, slope = f(t)
        around = [(f(t + 1e-6 * d)[0] - f(t - 1e-6 * d)[0]) / 2e-6 for d in np.eye(6)]
        assert np.isfinite(value) and np.allclose(slope, around, rtol=1e-5, atol=1e-5)


def test_fits_are_minima():
    """No small step of any parameter gives a lower loss, and the true process has none either."""
    y = returns(1500, 7)
    p = garch.fit(y)

    def loss(q):
        v, _, z = walk(y, q, (y * 100).var(ddof=1))
        return 0.5 * (np.log(2 * np.pi) + np.log(v * 1e4) + z**2).sum()

    assert p["loss"] == pytest.approx(loss(p), rel=1e-12)
    for name in ("c", "phi", "omega", "alpha", "beta"):
        for step in (-1e-3, 1e-3):
            assert loss(p | {name: p[name] + step * max(0.01, abs(p[name]))}) >= p["loss"] - 1e-6
    assert p["loss"] <= loss({"c": 0, "phi": 0, "omega": 0.05, "alpha": 0.1, "beta": 0.85, "gamma": 0})


def test_long_series_are_fitted_over_their_blocks(spark):
    """A value and score of all blocks equal the series' own, and so does the minimum that is found with them."""
    y, z = returns(300, 3), returns(120, 5)
    df = frame(spark, y, x=np.abs(y) * 50).union(frame(spark, z, "b", x=np.abs(z) * 50))
    blocks = garch.blocks_of(df, "log_return", "x", width=64)
    p = [0.02, 0.05, 0.04, 0.08, 0.9, 0.3]
    trials = spark.createDataFrame([(s, 0, p, 1.0) for s in ("a", "b")], "series_id string, k int, p array<double>, sample double")
    for row in garch.evaluate(blocks, trials, True).collect():
        own = y if row["series_id"] == "a" else z
        value, slope = garch.score(*garch.states(np.array(p), own * 100, np.abs(own) * 50, None, garch.seed(np.array(p), 1.0)))
        assert row["loss"] == pytest.approx(value, rel=1e-12) and np.allclose(row["slope"], slope, rtol=1e-9, atol=1e-9)
    known = garch.facts(blocks, True).orderBy("series_id").first()
    assert known["n"] == 300 and known["sample"] == pytest.approx((y * 100).var(ddof=1)) and known["lagged"] == pytest.approx(np.corrcoef(y[:-1], y[1:])[0, 1]) and known["rms"] == pytest.approx(np.sqrt(np.mean((y * 50) ** 2)))


def test_searches_over_blocks_end_where_one_task_ends(spark):
    z = returns(120, 5)
    blocks = garch.blocks_of(frame(spark, z), "log_return", width=64)
    found = garch.fit_blocks(blocks, garch.facts(blocks, False), tolerance=1e-3, rounds=12).first()
    assert found["loss"] == pytest.approx(garch.fit(z)["loss"], abs=0.5) and found["alpha"] + found["beta"] < 0.999


def test_many_series_are_fitted_apart(spark):
    parts = {name: returns(90, seed) for seed, name in enumerate("pqr")}
    df = None
    for name, y in parts.items():
        df = frame(spark, y, name) if df is None else df.union(frame(spark, y, name))
    got = {r["series_id"]: r for r in garch.fit_series(df).collect()}
    assert set(got) == set(parts) and all(got[k]["loss"] == pytest.approx(garch.fit(y)["loss"]) for k, y in parts.items())
    with pytest.raises(Exception, match="at least 30"):
        garch.fit_series(frame(spark, returns(29))).collect()


def test_expanding_in_blocks_equals_the_walk(spark):
    y = returns(260, 11)
    got = garch.expanding(frame(spark, y), 200, 21, width=30).orderBy("date").toPandas()
    z, p = y * 100, garch.fit(y[:200])
    first = p
    e = np.array([z[t] - p["c"] - (p["phi"] * z[t - 1] if t else 0.0) for t in range(len(z))])
    v, ahead = np.empty(len(z)), np.empty(len(z))
    v[0] = max(z[:200].var(ddof=1), p["omega"] / max(1e-6, 1 - p["alpha"] - p["beta"]))
    for i in range(len(z)):
        if i >= 200 and (i - 200) % 21 == 0:
            p = garch.fit(y[:i])
            e[: i + 1] = [z[t] - p["c"] - (p["phi"] * z[t - 1] if t else 0.0) for t in range(i + 1)]
        if i:
            v[i] = p["omega"] + p["alpha"] * e[i - 1] ** 2 + p["beta"] * v[i - 1]
        ahead[i] = p["omega"] + p["alpha"] * e[i] ** 2 + p["beta"] * v[i] if i < len(z) - 1 else p["omega"] + (p["alpha"] + p["beta"]) * v[i]
    assert first != p and np.allclose(got["conditional_vol"], np.sqrt(v) / 100, rtol=1e-9) and np.allclose(got["forecast_vol"], np.sqrt(ahead) / 100, rtol=1e-9) and np.allclose(got["std_resid"], e / np.sqrt(v), rtol=1e-9)


def test_sequences_in_blocks_equal_slices(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=200)
    y[[0, 17, 90]] = np.nan
    df = frame(spark, y, x=np.arange(200.0)).withColumn("log_return", F.when(~F.isnan("log_return"), F.col("log_return")))
    both = df.union(df.withColumn("series_id", F.lit("b")).limit(12))
    kept = [i for i in range(200) if not np.isnan(y[i])]
    for span in (512, 7, 20):
        got = residual.sequences(both, ["log_return", "x"], 6, span=span).orderBy("series_id", "date").collect()
        a = [r for r in got if r["series_id"] == "a"]
        assert len(a) == len(kept) - 5 and a[0].asDict().keys() == {*df.columns, "window"}
        for k, row in enumerate(a):
            assert row["window"] == [[y[i], float(i)] for i in kept[k : k + 6]] and row["x"] == float(kept[k + 5])


def test_numbers_of_rows(spark):
    df = frame(spark, returns(100)).union(frame(spark, returns(40), "b"))
    got = recurrence.numbered(df, width=8).orderBy("series_id", "date").collect()
    assert [r["i"] for r in got] == [*range(100), *range(40)]


def windows_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4, 2))
    y = x[:, -1, 0] + 0.1 * rng.normal(size=n)
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    split = np.where(np.arange(n) < 0.7 * n, "train", np.where(np.arange(n) < 0.85 * n, "val", "test"))
    rows = [("a", d, s, w.tolist(), float(t)) for d, s, w, t in zip(days, split, x, y)]
    return spark.createDataFrame(rows, "series_id string, date date, split string, window array<array<double>>, hybrid_residual_target double")


def test_tasks_that_exchange_gradients_learn_what_one_process_does(spark):
    """The barrier stage against the same shards in threads of this process, whose arrays are summed at a barrier."""
    import threading

    df, workers = windows_of(spark, 60), 2
    got = residual.learn_in_parallel(df, epochs=4, workers=workers).collect()[0]
    shards = df.repartition(workers, "date").withColumn("p", F.spark_partition_id()).toPandas()
    meet, seats, found = threading.Barrier(workers), [None] * workers, [None] * workers

    def work(k):
        def summed(numbers):
            seats[k] = np.asarray(numbers, float)
            meet.wait()
            total = np.sum(seats, axis=0)
            meet.wait()
            return total

        own = shards[shards["p"] == k].sort_values("date")
        found[k] = residual.Learned(residual._windows(own["window"]), own["hybrid_residual_target"].to_numpy(float), own["split"].to_numpy(), 4, summed, k, workers)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(workers)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got["losses"]) == 4 and np.allclose(got["losses"], found[0].losses, rtol=1e-12) and found[0].losses == found[1].losses


def test_large_groups_are_learned_in_parallel_and_predicted_everywhere(spark):
    df = windows_of(spark, 60)
    got = residual.learn_residuals(df, epochs=2, most_rows=10, workers=2)
    assert got.columns == ["series_id", "date", "split", "predicted_residual"] and got.count() == 60 and got.where("predicted_residual is null").count() == 0
    small = residual.learn_residuals(df, epochs=2, keep=("hybrid_residual_target",))
    assert small.count() == 60 and "hybrid_residual_target" in small.columns
