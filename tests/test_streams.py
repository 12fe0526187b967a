"""Streams with state: restarts and any cut into micro-batches give what one batch gives."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from volatide.operators import alignment
from volatide.streaming import ledger, news

START = dt.datetime(2024, 1, 1, 8, 0)


def brute(rows, max_attempts, base, late):
    """{url: (status, attempts, skipped, last error, retry time, outcome time, due)}, an attempt at a time in order of time."""
    last_seen, out = max(at for _, at, _, _ in rows) - late, {}
    for url in {r[0] for r in rows}:
        own = sorted((at, ok, error) for u, at, ok, error in rows if u == url)
        failures, status, done, n = [], "failed", None, 0
        for at, ok, error in sorted(own, key=lambda r: (r[0], not r[1], r[2])):
            if status != "failed":
                continue
            n += 1
            if ok:
                status, done = "completed", at
            else:
                failures.append((at, error))
                if len(failures) == max_attempts:
                    status, done = "dead", at
        retry = failures[-1][0] + base * 2 ** (len(failures) - 1) if status == "failed" else None
        out[url] = (status, n, len(own) - n, failures[-1][1] if failures else None, retry, done, retry is not None and retry <= last_seen)
    return out


def attempts(seed, n):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(12)}", START + dt.timedelta(seconds=i * 97), rng.random() < 0.15, rng.choice(["timeout", "404", ""])) for i in range(n)]


@pytest.mark.parametrize("cuts", [[90], [20, 25, 70, 90]])
def test_a_ledger_after_restarts_equals_one_pass(spark, tmp_path, cuts):
    rows = attempts(4, 90)
    schema = "url string, at timestamp, ok boolean, error string"
    folder = str(tmp_path / "in")
    at = 0
    for to in cuts:
        spark.createDataFrame([*rows[at:to], (None, rows[at][1], True, ""), ("u0", None, True, "")], schema).coalesce(1).write.mode("append").parquet(folder)
        at = to
        ledger.run(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), max_attempts=3, base_seconds=300, late="10 minutes")
    found = ledger.read(spark, str(tmp_path / "ledger"))
    got = {r["url"]: (r["status"], r["attempts"], r["skipped"], r["last_error"], r["retry_at"], r["done_at"], r["due"]) for r in found.collect()}
    want = brute(rows, 3, dt.timedelta(seconds=300), dt.timedelta(minutes=10))
    assert got == want and {v[0] for v in want.values()} >= {"dead", "completed"}
    urls = spark.createDataFrame([("new",), *[(u,) for u in want]], "url string")
    assert {r["url"] for r in ledger.to_fetch(urls, found).collect()} == {"new", *[u for u, v in want.items() if v[6]]}
    assert {r["status"]: r["urls"] for r in ledger.report(found).collect()} == {s: sum(v[0] == s for v in want.values()) for s in {v[0] for v in want.values()}}


def test_a_ledger_calls_python_by_shard_and_not_by_url(spark, tmp_path):
    rows = [(f"u{i}", START + dt.timedelta(seconds=i), i % 5 == 0, "e") for i in range(3000)]
    schema = "url string, at timestamp, ok boolean, error string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ledger.run(stream(), str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), shards=7)
    state = spark.read.format("statestore").load(str(tmp_path / "checkpoint"))
    assert 1 <= state.count() <= 7
    assert ledger.report(ledger.read(spark, str(tmp_path / "ledger"))).where("status = 'completed'").first()["urls"] == 600
    spark.createDataFrame(rows[:9], schema).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="7 shards"):
        ledger.run(stream(), str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), shards=8)


def test_outcomes():
    m = 1_000_000
    assert ledger.outcome(None, [1 * m], ["x"], 3, 60) == ("failed", 1, "x", 61 * m, None)
    assert ledger.outcome(None, [1 * m, 5 * m], ["x", "y"], 3, 60) == ("failed", 2, "y", 125 * m, None)
    assert ledger.outcome(3 * m, [1 * m, 5 * m], ["x", "y"], 3, 60) == ("completed", 2, "x", None, 3 * m)
    assert ledger.outcome(9 * m, [1 * m, 2 * m, 5 * m], ["x", "y", "z"], 3, 60) == ("dead", 3, "z", None, 5 * m)
    assert ledger.outcome(1 * m, [1 * m], ["x"], 3, 60) == ("completed", 1, None, None, 1 * m)


def test_days_are_replaced_as_news_arrives(spark, tmp_path):
    rng = random.Random(2)
    sessions = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4, 8)], "date date")
    rows = [(f"u{i}", rng.choice("abc"), START + dt.timedelta(hours=rng.randrange(200)) if rng.random() < 0.7 else None, dt.date(2024, 1, rng.randint(1, 9)), "x" * rng.randint(0, 9)) for i in range(80)]
    schema = "url string, category string, published_at timestamp_ntz, date date, body_clean string"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        news.upsert_days(news.daily_news_stream(stream, sessions), str(tmp_path / "daily"), str(tmp_path / "checkpoint"))
        whole = alignment.daily_news(alignment.align(spark.createDataFrame([r for j in range(k + 1) for r in rows[j::3]], schema), sessions))
        got = spark.read.parquet(str(tmp_path / "daily")).select(whole.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
