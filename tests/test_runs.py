"""Whole runs: ingestion with a ledger, observed reports, bucketed merges, tracking, scoring of what arrives."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from volatide import __main__ as command
from volatide import tracking
from volatide.operators import alignment, reconcile
from volatide.plans import flows
from volatide.sources import archive

PAGE = '<html><head><meta property="article:published_time" content="{day}T09:00:00+07:00"></head><body><h1 class="title">Title {n}</h1><div class="detail-content"><p>Body {n}.</p></div></body></html>'


def add_pages(spark, folder, rows):
    html = lambda n, day: PAGE.format(n=n, day=day) if day else "<p>no article"
    archive.write_pages(spark.createDataFrame([(f"https://cafef.vn/vi-mo/{n}.chn", html(n, day), stored) for n, day, stored in rows], "url string, html string, day string"), folder)


def test_ingestion_resumes_and_keeps_a_ledger(spark, tmp_path, capsys):
    folder, out = str(tmp_path / "pages"), str(tmp_path / "out")
    add_pages(spark, folder, [(1, "2024-01-01", "2024-01-02"), (2, "2023-06-01", "2024-01-02"), (3, None, "2024-01-02")])
    assert flows.ingest(spark, folder, "cafef", out, discover_only=True) == {"discovered_urls": 3}
    first = flows.ingest(spark, folder, "cafef", out, "2024-01-01", "2024-12-31")
    assert first == {"discovered_urls": 3, "parsed_articles": 1, "skipped_duplicates": 0, "date_filter_skips": 1, "failed_pages": 1}
    assert set(flows.ingest(spark, folder, "cafef", out, "2024-01-01", "2024-12-31").values()) == {0}
    # Completed pages that are stored again are skipped; one that failed may succeed.
    add_pages(spark, folder, [(1, "2024-01-01", "2024-01-03"), (3, "2024-01-03", "2024-01-03"), (4, "2024-01-04", "2024-01-03")])
    command.main(["ingest", "--pages", folder, "--start", "2024-01-01", "--output", out], spark)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"discovered_urls": 3, "parsed_articles": 2, "skipped_duplicates": 1, "date_filter_skips": 0, "failed_pages": 0}
    assert sorted(r["title"] for r in spark.read.parquet(f"{out}/articles").collect()) == ["Title 1", "Title 3", "Title 4"]
    status = {(r["url"][-5], r["status"]) for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert status == {("1", "completed"), ("2", "completed"), ("3", "failed"), ("3", "completed"), ("4", "completed")}
    limited = flows.ingest(spark, folder, "cafef", str(tmp_path / "few"), limit=1)
    assert 0 < limited["discovered_urls"] <= 3


def test_reports_come_from_the_passes_that_write(spark, tmp_path):
    news = spark.createDataFrame([("u1", "c", "s", "t", "2024-01-02", "2024-01-02 09:00:00", "x" * 200), ("u2", "c", "s", "t", "2024-01-06", "", "y" * 200), ("u3", "c", "s", "t", "2024-01-02", "", "short"), ("u4", "c", "s", "t", "2025-01-01", "", "z" * 200)], "url string, category string, source string, title string, date string, published_at string, body string")
    prices = spark.createDataFrame([(dt.date(2024, 1, d), 10.0 + d, 10.0, 11.0, 9.0, 5) for d in (2, 3, 8)], "date date, close double, open double, high double, low double, volume long")
    news.write.parquet(str(tmp_path / "news"))
    articles, daily, report = flows.preprocess(spark.read.parquet(str(tmp_path / "news")), prices)
    written = flows.export_preprocessed(spark.read.parquet(str(tmp_path / "news")), prices, str(tmp_path / "out"))
    assert written == report.first().asDict()
    for df, name in ((articles, "articles_clean"), (daily, "daily_news_prices")):
        got = spark.read.parquet(str(tmp_path / "out" / f"{name}.parquet"))
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_the_news_is_read_once(spark, tmp_path):
    """Rows that the reading of the raw news makes, by an accumulator in its place."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    news = spark.createDataFrame([(f"u{i}", "a", dt.date(2024, 1, 1 + i % 9), "x") for i in range(40)], "url string, category string, date date, body_clean string")
    prices = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 8)], "date date")
    report = alignment.write_aligned(news.mapInPandas(count, news.schema), prices, str(tmp_path / "a"), str(tmp_path / "d"), timestamp=None)
    assert seen.value == 40 and report["raw_rows"] == report["clean_rows"] == 40 and report["mapped_rows"] + report["unmapped_rows"] == 40 and report["trading_days"] == 3


def test_merges_of_bucketed_tables_shuffle_nothing(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(f"u{i % 40}", day, f"t{i}") for i in range(60)], "url string, trading_date date, title string")
    s = spark.createDataFrame([(f"u{i % 50 + 5}", day, float(i)) for i in range(80)], "url string, trading_date date, score double")
    tables = [reconcile.write_bucketed(df, f"volatide_test_{name}", str(tmp_path / name), buckets=4) for df, name in ((a, "a"), (s, "s"))]
    first, last = [F.col("title")], [F.col("score")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "inner"):
            merged = reconcile.merge_scores(*tables, how, first, last)
            assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
            assert sorted(merged.collect()) == sorted(reconcile.merge_scores(a, s, how, first, last).collect())
        counted = reconcile.reconcile_bucketed(*tables, ["url", "trading_date"])
        assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the counts
        assert sorted(counted.collect()) == sorted(reconcile.reconcile_keys(a, s, ["url", "trading_date"]).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        [spark.sql(f"DROP TABLE IF EXISTS volatide_test_{name}") for name in "as"]


def test_runs_are_rows(spark, tmp_path):
    folder = str(tmp_path)
    assert tracking.read_runs(spark, folder).count() == 0
    with tracking.run(spark, folder, "experiment", {"epochs": 3}) as top:
        for rate, rmse in ((0.1, 2.0), (0.2, 1.0)):
            with top.child("spec", {"rate": rate}) as one:
                one.metrics({"errors": {"rmse": rmse}, "text": "no number"})
                assert spark.read.parquet(one.artefact("days", spark.range(3))).count() == 3
    with pytest.raises(ZeroDivisionError), tracking.run(spark, folder, "spec") as bad:
        bad.metrics({"errors": {"rmse": 0.0}})
        1 / 0
    rows = {(r["name"], r["status"]): r for r in tracking.read_runs(spark, folder).collect()}
    assert rows["spec", "finished"]["parent_id"] == rows["experiment", "finished"]["run_id"] and rows["experiment", "finished"]["params"] == {"epochs": "3"} and ("spec", "failed") in rows
    assert [tuple(r)[0::2] for r in tracking.best(tracking.read_runs(spark, folder), "errors.rmse").collect()] == [("spec", 1.0)]
