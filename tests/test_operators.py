"""Literal cases of single operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volatide.functions import dates, text
from volatide.functions.optimize import Minimiser, minimise
from volatide.operators import alignment, checks, classify, corpus, frame, garch, labels, reconcile, residual, stats
from volatide.operators.sentiment import daily_sentiment
from volatide.operators.volatility import volatility_features, with_series
from volatide.schemas import DAILY_NEWS_PRICES, require_columns, require_unique
from volatide.sources import files, providers, sites


def d(x):
    return dt.date.fromisoformat(x)


ALIGN = [
    ("2024-01-08 14:30:00", "2024-01-08", ["2024-01-08", "2024-01-09", "2024-01-10"], "2024-01-08", "same_session", 0),
    ("2024-01-08 15:00:00", "2024-01-08", ["2024-01-08", "2024-01-09", "2024-01-10"], "2024-01-09", "after_close_forward", 1),
    ("2024-02-10 09:00:00", "2024-02-10", ["2024-02-08", "2024-02-19", "2024-02-20"], "2024-02-19", "non_trading_forward", 9),
    ("", "2024-03-02", ["2024-03-01", "2024-03-04"], "2024-03-04", "date_only_forward", 2),
    ("", "2024-03-01", ["2024-03-01", "2024-03-04"], "2024-03-01", "date_only_same_day", 0),
    ("2024-01-10 15:30:00", "2024-01-10", ["2024-01-10", "2024-01-11"], "2024-01-11", "after_close_forward", 1),
    ("2024-02-12 10:00:00", "2024-02-12", ["2024-02-08", "2024-02-21", "2024-02-22"], "2024-02-21", "non_trading_forward", 9),
    ("2024-01-08 14:45:00", "2024-01-08", ["2024-01-08", "2024-01-09"], "2024-01-08", "same_session", 0),
    ("2024-01-09 14:45:01", "2024-01-09", ["2024-01-08", "2024-01-09"], None, "after_close_forward", None),
    ("2024-01-08T02:00:00+00:00", "2024-01-01", ["2024-01-08", "2024-01-09"], "2024-01-08", "same_session", 0),
    ("2024-01-08T09:00:00+00:00", "2024-01-01", ["2024-01-08", "2024-01-09"], "2024-01-09", "after_close_forward", 1),
    ("2024-01-13 16:00:00", "2024-01-13", ["2024-01-12", "2024-01-15"], "2024-01-15", "non_trading_forward", 2),
    ("", None, ["2024-01-08"], None, "unmapped", None),
]


@pytest.mark.parametrize("case", ALIGN, ids=[f"{i}-{c[4]}" for i, c in enumerate(ALIGN)])
def test_alignment(spark, case):
    published, date, sessions, trading, reason, gap = case
    a = spark.createDataFrame([(published, date)], "published_at string, date string")
    a = a.withColumns({"published_at": dates.market_timestamp(F.col("published_at")), "date": F.col("date").cast("date")})
    got = alignment.align(a, spark.createDataFrame([(d(s),) for s in sessions], "date date")).first()
    assert (got["trading_date"], got["alignment_reason"], got["calendar_gap_days"]) == (trading and d(trading), reason, gap)


def test_alignment_needs_a_date(spark):
    with pytest.raises(ValueError, match="tells when"):
        alignment.align(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(d("2024-01-01"),)], "date date"))


def test_daily_news(spark):
    rows = [(d("2024-02-19"), "a", "xx", 0, "non_trading_forward", 9), (d("2024-02-19"), "a", "xxxx", 1, "after_close_forward", 1)]
    got = alignment.daily_news(spark.createDataFrame(rows, "trading_date date, category string, body_clean string, is_after_close int, alignment_reason string, calendar_gap_days long")).first()
    assert (got["n_articles"], got["n_categories"], got["mean_body_len"], got["after_close_share"], got["non_trading_share"], got["max_calendar_gap_days"]) == (2, 1, 3.0, 0.5, 0.5, 9)


PRICES = [("2024-01-02", 100.0, 99.5, 101.0, 99.0, 1000), ("2024-01-03", 101.0, 100.0, 102.0, 99.8, 1200), ("2024-01-04", 100.5, 100.8, 101.0, 99.7, 1100)]


def prices(spark, rows=PRICES):
    return spark.createDataFrame([(d(r[0]), *r[1:]) for r in rows], "Date date, TRDPRC_1 double, OPEN_PRC double, HIGH_1 double, LOW_1 double, ACVOL_UNS long")


def test_volatility_features(spark):
    rows = volatility_features(prices(spark), "garman_klass").orderBy("date").collect()
    hl, co = math.log(102 / 99.8), math.log(101 / 100)
    assert rows[0]["log_return"] is None and rows[1]["log_return"] == pytest.approx(math.log(1.01))
    assert rows[1]["parkinson_vol"] == pytest.approx(hl / math.sqrt(4 * math.log(2)))
    assert rows[1]["gk_vol"] == pytest.approx(math.sqrt(0.5 * hl**2 - (2 * math.log(2) - 1) * co**2))
    assert rows[0]["target_next_vol"] == rows[1]["target_vol"] and rows[2]["target_next_vol"] is None
    with pytest.raises(ValueError, match="Unknown target_type"):
        volatility_features(prices(spark), "other")
    with pytest.raises(ValueError, match="lacks the columns"):
        volatility_features(prices(spark).drop("HIGH_1"))


def scores(spark):
    rows = [("u1", "2024-01-02", 0.8, "positive", "Chứng khoán"), ("u2", "2024-01-02", -0.4, "negative", "Vĩ mô"), ("u3", "2024-01-03", 0.0, "neutral", "Vĩ mô")]
    return spark.createDataFrame(rows, "url string, trading_date string, sentiment_score double, sentiment_label string, category string")


def test_daily_sentiment(spark):
    a, b = daily_sentiment(scores(spark)).orderBy("date").collect()
    assert (a["sentiment_volume"], a["positive_share"], a["negative_share"], a["net_sentiment"]) == (2, 0.5, 0.5, 0.0)
    assert a["sentiment_surprise"] == pytest.approx(0.2) and b["sentiment_surprise"] == pytest.approx(-0.2)
    assert (a["macro_sentiment"], b["macro_sentiment"], a["market_sentiment"], b["market_sentiment"]) == (-0.4, 0.0, 0.8, None)
    assert (b["market_sentiment_missing"], b["sentiment_std"]) == (1, 0.0)
    lookup = daily_sentiment(scores(spark).drop("category"), scores(spark).select("url", "category")).orderBy("date").first()
    assert lookup["market_sentiment"] == 0.8


def test_thresholds_relabel(spark):
    s = spark.createDataFrame([("2024-01-02", 0.08), ("2024-01-02", -0.04), ("2024-01-03", 0.12)], "date string, sentiment_score double")
    low, high = (daily_sentiment(s, threshold=t).orderBy("date").collect() for t in (0.05, 0.10))
    assert (low[0]["positive_share"], low[0]["neutral_share"], high[0]["neutral_share"], high[1]["positive_share"]) == (0.5, 0.5, 1.0, 1.0)


def test_model_frame_fills_quiet_days(spark):
    news = spark.createDataFrame([(d("2024-01-02"), 2, 1, 50.0)], "date date, n_articles long, n_categories long, mean_body_len double")
    rows = frame.validate(frame.model_frame(prices(spark), news, scores(spark))).orderBy("date").collect()
    assert [r["has_sentiment"] for r in rows] == [1, 1, 0] and [r["n_articles"] for r in rows] == [2, 0, 0]
    assert (rows[1]["market_sentiment"], rows[2]["market_sentiment"], rows[2]["market_sentiment_missing"], rows[2]["net_sentiment"]) == (None, 0.0, 1, 0.0)


def test_text_functions(spark):
    rows = [(0, "<p>See https://x.y/z or www.a.b\xa0 mail me@x.org now</p>\n\n ok"), (1, None), (2, "  a \x1c b  ")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", text.clean_body(F.col("t")).alias("c"), text.count_tokens(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["See or mail now ok", "", "a b"] and [r["n"] for r in got][1:] == [0, 2]
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first()["x"]
    assert show(text.input_text(F.lit(" t "), F.lit("l  l"))) == "t . l l" and show(text.input_text(F.lit(""), F.lit("l"))) == "l"
    assert show(text.infer_category(F.lit("/kinh-te-vi-mo/x"), sites.BUSINESS_KEYWORDS, "?")) == "Kinh tế"
    assert show(text.normalize_url(F.lit("../b?q#f"), F.lit("https://h.x/a/c"))) == "https://h.x/b?q"
    assert show(text.normalize_url(F.lit("/r"), F.lit("https://h.x/a/c"))) == "https://h.x/r" and show(text.normalize_url(F.lit("javascript:x"))) is None
    for raw in ("2015-01-02T08:30:00+07:00", "Thứ sáu, 02/01/2015, 08:30", "02-01-2015"):
        assert show(dates.extract_date(F.lit(raw))) == d("2015-01-02")
    assert show(dates.extract_date(F.lit("no date 99/99/2020"))) is None


def test_corpora_and_reports(spark):
    first = spark.createDataFrame([("https://x/1", "c", "2024-01-02", "T", "body " * 400)], "url string, category string, published_at string, title string, body_clean string")
    extra = spark.createDataFrame([("y/1", "c", "2024-01-05", "U", "b"), ("y/2", "c", "2024-02-05", "V", "b")], "url string, category string, time string, title string, content string")
    parts = [corpus.training_rows(first, "cafef", "url", "category", "published_at", "title", "body_clean"), corpus.training_rows(extra, "extra", "url", "category", "time", "title", "content", "2024-01-31")]
    rows = corpus.training_corpus(parts).orderBy("article_id").collect()
    assert [r["article_id"] for r in rows] == ["https://x/1", "y/1"] and len(rows[0]["body_text"]) <= 1200 and rows[1]["published_at"] == "2024-01-05 00:00:00"
    with pytest.raises(ValueError, match="duplicate article_id"):
        corpus.training_corpus([parts[0], parts[0]])
    with pytest.raises(ValueError, match="lacks the columns"):
        corpus.training_rows(extra, "extra", "url", "category", "when", "title", "content")
    empty = corpus.token_stats(spark.createDataFrame([], "token_count long")).first()
    assert (empty["count"], empty["p95"]) == (0, 0.0)


def labelled(spark, n=10):
    return spark.createDataFrame([(f"a{i}", "s", "c", f"2024-01-{i + 1:02d}", "t", "b", "t . b") for i in range(n)], "article_id string, source string, category string, published_at string, title string, body_text string, input_text string")


def test_merging_annotations(spark):
    notes = spark.createDataFrame([(f"a{i}", "Negative ", 0.91 if i == 0 else 0.62) for i in range(10)], "article_id string, label string, confidence double")
    review = spark.createDataFrame([("a1", "positive")], "article_id string, label string")
    rows = labels.merge_annotations(labelled(spark), notes, review).orderBy("article_id").collect()
    assert [(r["article_id"], r["label"], r["confidence"], r["label_source"]) for r in rows] == [("a0", "negative", 0.91, "bootstrap"), ("a1", "positive", 1.0, "reviewed")]
    bad = {"duplicate": notes.union(notes), "no label": notes.withColumn("label", F.lit(" ")), "none of the three": notes.withColumn("label", F.lit("bullish"))}
    for message, frame_ in bad.items():
        with pytest.raises(ValueError, match=message):
            labels.merge_annotations(labelled(spark), frame_)
    with pytest.raises(ValueError, match="None of the annotated"):
        labels.merge_annotations(labelled(spark), notes.withColumn("article_id", F.concat(F.lit("z"), "article_id")))


def test_splits(spark):
    by = lambda df: [r["split"] for r in df.orderBy("article_id").collect()]
    assert by(labels.assign_splits(labelled(spark))) == ["train"] * 8 + ["test"] * 2
    assert by(labels.assign_splits(labelled(spark), train=0.7, val=0.2)) == ["train"] * 7 + ["val"] * 2 + ["test"]
    one_day = labelled(spark, 4).withColumn("published_at", F.lit("2024-01-01"))
    assert by(labels.assign_splits(one_day, val=0.1)) == ["train", "test", "val", "train"]
    assert by(labels.assign_splits(labelled(spark, 3), train=0.6, val=0.01)) == ["val", "train", "test"]
    with pytest.raises(ValueError, match="leave nothing"):
        labels.assign_splits(labelled(spark), train=0.9, val=0.1)
    with pytest.raises(ValueError, match="splits other than"):
        labels.assign_splits(labelled(spark).withColumn("split", F.lit("dev")))


def test_samples(spark):
    rows = [(f"a{i:03d}", "big" if i < 90 else "small", "c", f"{2020 + i % 2}-01-01") for i in range(95)]
    df = spark.createDataFrame(rows, "article_id string, source string, category string, published_at string")
    got = labels.source_balanced_sample(df, 30).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"big": 25, "small": 5}
    strata = labels.stratified_sample(df, 20).groupBy("source", "sample_year").count().collect()
    assert sum(r["count"] for r in strata) == 20 and {r["count"] for r in strata} <= {2, 3, 7, 8, 5, 6}
    assert labels.stratified_sample(df, 20).orderBy("article_id").collect() == labels.stratified_sample(df.repartition(5), 20).orderBy("article_id").collect()


def test_model_labels_fall_back(spark):
    df = spark.createDataFrame([(f"a{i}",) for i in range(30)], "article_id string")

    def broken(rows):
        return [{"article_id": rows[0]["article_id"], "label": "bullish", "confidence": 2, "rationale": ""}]

    def works(rows):
        return [{"article_id": r["article_id"], "label": "Neutral", "confidence": 0.5, "rationale": "r"} for r in rows] + [{"article_id": "other"}]

    rows = labels.bootstrap_labels(df, [("one", broken), ("two", works)]).collect()
    assert len(rows) == 30 and {(r["label"], r["model_name"]) for r in rows} == {("neutral", "two")}
    with pytest.raises(Exception, match="No model labelled"):
        labels.bootstrap_labels(df, [("one", broken)]).collect()


def test_json_is_salvaged(spark):
    one = '{"article_id": "a", "label": "neutral", "confidence": 0.4, "rationale": "x"}'
    texts = [f"Sure: [{one}] bye", f"so {one}.", "nothing", "[broken"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.salvage_json(F.col("t")).alias("x")).collect()]
    assert got[0][0]["article_id"] == got[1][0]["article_id"] == "a" and got[2] is None and got[3] is None


def test_merge_and_reconcile(spark):
    a = spark.createDataFrame([("u", "d", 1, "x"), ("u", "d", 2, "y"), ("v", "d", 3, "z")], "url string, trading_date string, n int, category string")
    s = spark.createDataFrame([("u", "d", 0.1, "p"), ("u", "d", 0.2, "q"), ("w", "d", 0.3, "r")], "url string, trading_date string, sentiment_score double, category string")
    rows = reconcile.merge_scores(a, s, "left", [F.col("n")], [-F.col("sentiment_score")]).orderBy("url").collect()
    assert [(r["url"], r["n"], r["sentiment_score"], r["category"], r["category_sentiment"]) for r in rows] == [("u", 1, 0.2, "x", "q"), ("v", 3, None, "z", None)]
    assert {r["merge"]: r["n"] for r in reconcile.reconcile_keys(a, s, ["url", "trading_date"]).collect()} == {"both": 1, "left_only": 1, "right_only": 1}
    with pytest.raises(ValueError, match="how must be"):
        reconcile.merge_scores(a, s, "outer")


def test_validation_fails_loudly(spark):
    s = spark.createDataFrame([("u", d("2024-01-02"), "c", 0.5, "positive", 0.7, 0.2, 0.2), ("u", d("2024-01-02"), "c", 0.5, "positive", 0.7, 0.2, 0.1)], "url string, trading_date date, category string, sentiment_score double, sentiment_label string, prob_positive double, prob_negative double, prob_neutral double")
    v = checks.inference_validation(s, s, "a", "b")
    row = v.first()
    assert (row["duplicate_urls"], row["row_count_match"], row["no_duplicate_urls"], row["probabilities_sum_to_one"], row["ready_for_modeling"]) == (1, True, False, False, False)
    with pytest.raises(RuntimeError, match="no_duplicate_urls"):
        checks.raise_for_failed(v)
    with pytest.raises(ValueError, match="lacks the columns"):
        checks.inference_validation(s, s.drop("category"), "a", "b")


def series(spark, values, **columns):
    frame_ = pd.DataFrame({"series_id": "s", "date": pd.date_range("2024-01-01", periods=len(values)).date, "log_return": values, **columns})
    return spark.createDataFrame(frame_)


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b, h = rng.random(60) + 0.5, rng.random(60) + 0.5, rng.random(60) + 0.5
    df = series(spark, a, actual=a, baseline=b, hybrid=h)
    diff = (a - b) ** 2 - (a - h) ** 2
    c = diff - diff.mean()
    spread = (c.var() + 2 * 0.5 * np.mean(c[1:] * c[:-1])) / 60
    got = stats.diebold_mariano(df).first()
    assert got["dm"] == pytest.approx(diff.mean() / math.sqrt(spread)) and got["p"] == pytest.approx(math.erfc(abs(got["dm"]) / math.sqrt(2)))
    assert tuple(stats.diebold_mariano(df.withColumn("hybrid", F.col("baseline"))).first())[1:] == (0.0, 1.0)
    x = a - a.mean()
    q = 60 * 62 * sum((np.sum(x[k:] * x[:-k]) / np.sum(x * x)) ** 2 / (60 - k) for k in range(1, 6))
    lb = {r["lag"]: r for r in stats.ljung_box(df, "actual").collect()}
    assert lb[5]["q"] == pytest.approx(q) and 0 < lb[10]["p"] <= 1
    assert {(r["q"], r["p"]) for r in stats.ljung_box(df.withColumn("one", F.lit(1.0)), "one").collect()} == {(0.0, 1.0)}
    with pytest.raises(ValueError, match="No loss is named"):
        stats.diebold_mariano(df, "cubic")
    for q_, k, p in ((2.0, 2, math.exp(-1)), (11.0705, 5, 0.05), (18.307, 10, 0.05)):
        assert stats._chi2_tail(q_, k) == pytest.approx(p, abs=1e-5)


def test_garch_fit_and_filter(spark):
    rng = np.random.default_rng(1)
    v, y = 1.0, []
    for _ in range(600):
        v = 0.05 + 0.1 * ((y[-1] if y else 0) ** 2) + 0.85 * v
        y.append(math.sqrt(v) * rng.normal())
    y = np.array(y) / 100
    p = garch.fit(y)
    assert p["omega"] > 0 and p["alpha"] >= 0 and p["beta"] >= 0 and p["alpha"] + p["beta"] < 1 and abs(p["phi"]) < 0.2 and 0.6 < p["alpha"] + p["beta"]
    with pytest.raises(ValueError, match="at least 30"):
        garch.fit(y[:20])
    df = series(spark, y)
    row = garch.fit_series(df).first()
    assert row["loss"] == pytest.approx(p["loss"])
    filtered = garch.filter_series(df, p).orderBy("date").toPandas()
    sample, var = (y * 100).var(ddof=1), None
    e = y * 100 - p["c"]
    e[1:] -= p["phi"] * y[:-1] * 100
    for i in range(5):
        var = max(sample, p["omega"] / (1 - p["alpha"] - p["beta"])) if i == 0 else p["omega"] + p["alpha"] * e[i - 1] ** 2 + p["beta"] * var
        assert filtered["conditional_var"][i] == pytest.approx(var / 1e4)
    assert (filtered["forecast_var"][:-1].to_numpy()[:50] == pytest.approx(filtered["conditional_var"][1:].to_numpy()[:50])) and filtered["std_resid"].std() == pytest.approx(1, abs=0.15)
    walked = garch.expanding(df, 500, 40).toPandas()
    assert len(walked) == 600 and walked.notna().all().all()
    checked = garch.validate(garch.filter_series(df, p), garch.fit_series(df)).first()
    assert checked["stationary"] and 0 <= checked["p5"] <= 1
    pushed = garch.fit(y, exog=np.r_[0, np.abs(y[:-1]) * 100])
    assert pushed["loss"] <= p["loss"] + 1e-3
    assert len(garch.add_features(df.withColumn("target_next_vol", F.lit(0.01)), "2025-03-01").dropna(subset=["hybrid_residual_target"]).collect()) == 600


def test_minimiser_finds_minima_and_can_be_kept_in_a_row():
    def f(x):
        value = (100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2).sum() + 3
        slope = np.zeros_like(x)
        slope[:-1] = -400 * x[:-1] * (x[1:] - x[:-1] ** 2) - 2 * (1 - x[:-1])
        slope[1:] += 200 * (x[1:] - x[:-1] ** 2)
        return value, slope

    at, value = minimise(f, np.array([-1.2, 1.0, 0.5]))
    assert at == pytest.approx([1, 1, 1], abs=1e-5) and value == pytest.approx(3, abs=1e-9)
    search = Minimiser(np.array([-1.2, 1.0, 0.5]))
    while not search.done:
        search = Minimiser.restored([float(x) for x in search.state()])
        search.tell(*f(search.trial))
    assert (search.at == at).all()
    assert Minimiser(np.zeros(1)).tell(np.nan, np.zeros(1)) is None


def test_sequences_and_splits(spark):
    df = with_series(series(spark, np.arange(12.0), feature_b=np.arange(12.0) * 2))
    w = residual.sequences(df, ["log_return", "feature_b"], 3).orderBy("date").collect()
    assert len(w) == 10 and w[0]["window"] == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]
    split = labels.split_by_dates(df, "2024-01-07", "2024-01-09").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 7, "val": 2, "test": 3}


def test_lstm_gradients_and_learning():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 4, 3)), rng.normal(size=6)
    net = residual.LSTM(3, 5, 4)
    _, g = net.gradient(x, y)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-6
        up = ((net.forward(x)[0] - y) ** 2).mean()
        w[at] -= 2e-6
        low = ((net.forward(x)[0] - y) ** 2).mean()
        w[at] += 1e-6
        assert g[name][at] == pytest.approx((up - low) / 2e-6, abs=1e-5)
    x = rng.normal(size=(200, 4, 3))
    y = x[:, -1, 0]
    net = residual.LSTM(3)
    losses = net.train(x[:150], y[:150], x[150:], y[150:], epochs=25, rate=0.01)
    assert min(losses) < 0.5 * losses[0] and ((net.forward(x[150:])[0] - y[150:]) ** 2).mean() == pytest.approx(min(losses))


def test_classifier_round_trip(spark, tmp_path):
    rows = [(f"good nice {i}", "positive") for i in range(20)] + [(f"bad awful {i}", "negative") for i in range(20)] + [(f"so so {i}", "neutral") for i in range(20)]
    df = spark.createDataFrame(rows, "input_text string, label string")
    model = classify.train(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    out = classify.predict(classify.validate_checkpoint(str(tmp_path / "model")), df).toPandas()
    assert (out["label"] == out["sentiment_label"]).all() and np.allclose(out[["prob_positive", "prob_negative", "prob_neutral"]].sum(axis=1), 1)
    assert (out["sentiment_score"] == out["prob_positive"] - out["prob_negative"]).all()


CAFEF = """<html><head><meta property="article:published_time" content="2015-01-03T09:00:00+07:00"></head><body><h1 class="title">A  title</h1>
<div class="sapo">Lead here.</div><div class="detail-content"><p>One.</p><p>Two &amp; three.</p></div></body></html>"""


def test_article_pages(spark):
    pages = spark.createDataFrame([("https://cafef.vn/thi-truong-chung-khoan/x-20150103.chn", CAFEF), ("https://cafef.vn/y", "<h1>no body</h1>"), ("https://cafef.vn/z", None)], "url string, html string")
    rows = sites.parse_articles(pages, "cafef").collect()
    assert [tuple(r) for r in rows] == [("https://cafef.vn/thi-truong-chung-khoan/x-20150103.chn", "cafef", "Chứng khoán", "A title", "2015-01-03", "2015-01-03T09:00:00+07:00", "Lead here. One. Two & three.")]
    with pytest.raises(ValueError, match="No selectors"):
        sites.parse_articles(pages, "other")
    xml = "<urlset><url><loc>https://cafef.vn/thi-truong-chung-khoan/a.chn</loc></url><url><loc>https://cafef.vn/doi-song/a.chn</loc></url><url><loc>https://cafef.vn/doanh-nghiep/b.chn</loc></url></urlset>"
    assert sorted(r["url"] for r in sites.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).collect()) == ["https://cafef.vn/doanh-nghiep/b.chn", "https://cafef.vn/thi-truong-chung-khoan/a.chn"]


def test_provider_rows(spark):
    vci = spark.createDataFrame([("VHM", "T", "2024-12-31T08:30:00", None, None, "42")], "symbol string, news_title string, public_date string, content string, url string, id string")
    assert tuple(providers.normalize_rows(vci, "VCI").first())[:7] == ("vnstock://vci/VHM/42", "vnstock", "Ticker:VHM", "T", "2024-12-31", "2024-12-31T08:30:00", "T")
    kbs = spark.createDataFrame([("VHM", "Head", "Title", "2024-12-31", "abc"), ("VHM", " ", "Only", "2024-12-30", "xyz"), ("VHM", None, None, "2024-12-30", "q")], "symbol string, head string, title string, date string, id string")
    rows = providers.normalize_rows(kbs, "KBS").orderBy("url").collect()
    assert [(r["url"], r["title"], r["body"], r["published_at"]) for r in rows] == [("vnstock://kbs/VHM/abc", "Head", "Title", ""), ("vnstock://kbs/VHM/xyz", "Only", "Only", "")]
    capped = providers.paginate(spark.range(20).select("id", F.lit("s").alias("symbol")), 2, 3, ["id"]).collect()
    assert len(capped) == 6 and all(r["capped"] for r in capped)


def test_files(spark, tmp_path):
    (tmp_path / "news.csv").write_text('url,source,category,title,date,body\nu1,s,c,"a ""q"" t",2024-01-02,"line\ntwo"\nu2,s,c,,2024-01-02,x\n')
    rows = files.read_raw_news(spark, str(tmp_path / "news.csv")).orderBy("url").collect()
    assert rows[0]["title"] == 'a "q" t' and rows[0]["published_at"] == "" and rows[1]["title"] == "" and "two" in rows[0]["body"]
    (tmp_path / "mixed.csv").write_text("url,source,category,title,date,published_at,body\nu1,s,c,t,2024-01-02,b\nu2,s,c,t,2024-01-02,2024-01-02 10:00:00,b2\n")
    fixed, counts = files.repair_news_csv(spark, str(tmp_path / "mixed.csv"))
    assert [(r["published_at"], r["body"]) for r in fixed.orderBy("url").collect()] == [("", "b"), ("2024-01-02 10:00:00", "b2")]
    assert tuple(counts.first()) == (2, 1, 1, 0)
    (tmp_path / "prices.csv").write_text("Date,TRDPRC_1,OPEN_PRC,HIGH_1,LOW_1,ACVOL_UNS\n2024-01-02,100,99,101,98,\n2024-01-03,101,100,102,99,7\n")
    p = files.read_prices(spark, str(tmp_path / "prices.csv")).orderBy("date").collect()
    assert p[0]["volume"] == 0 and p[1]["log_return"] == pytest.approx(math.log(1.01))
    files.write_parquet(prices(spark), str(tmp_path / "p.parquet"))
    assert files.read_parquet_table(spark, str(tmp_path / "p.parquet")).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="Expected a parquet"):
        files.read_parquet_table(spark, str(tmp_path / "p.csv"))
    assert files.write_report(spark.range(1).select(F.lit(1.5).alias("a")), str(tmp_path / "r.json")) == {"a": 1.5}
    assert files.flatten_metrics({"a": {"b": True, "c": "x"}, "d:e": 2}) == {"a.b": 1.0, "d_e": 2.0}
    files.write_jsonl(prices(spark), str(tmp_path / "l"))
    assert files.read_jsonl(spark, str(tmp_path / "l"), prices(spark).schema).count() == 3
    files.write_csv(spark.range(2), str(tmp_path / "c"))
    files.write_csv(spark.range(3), str(tmp_path / "c"), append=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match=r"thing lacks the columns \['x'\]"):
        require_columns(df, ["k", "x"], "thing")
    with pytest.raises(ValueError, match="duplicate k values"):
        require_unique(df, ["k"], "thing")


def test_whole_preprocessing(spark, tmp_path):
    from volatide.plans import flows

    days = pd.bdate_range("2024-01-02", periods=10)
    news = [(f"u{i}{t}", "s", "c", "t", str(day.date()), f"{day.date()} {t}", "words " * 30) for i, day in enumerate(days) for t in ("09:00:00", "15:30:00")]
    news += [("short", "s", "c", "t", "2024-01-02", "", "tiny"), ("dated", "s", "c", "t", "2024-01-06", "", "words " * 30)]
    raw = spark.createDataFrame(news, "url string, source string, category string, title string, date string, published_at string, body string")
    bars = spark.createDataFrame([(day.date(), 100.0 + i, 99.0, 101.0 + i, 98.0, 10 + i) for i, day in enumerate(days)], "date date, close double, open double, high double, low double, volume long")
    articles, daily, report = flows.preprocess(raw, bars)
    rows = daily.orderBy("date").collect()
    assert daily.columns == DAILY_NEWS_PRICES and [r["n_articles"] for r in rows] == [1, 2, 2, 2, 3, 2, 2, 2, 2, 2]
    assert articles.count() == 20
    r = report.first()
    assert (r["raw_rows"], r["clean_rows"], r["mapped_rows"], r["unmapped_rows"], r["zero_news_days"]) == (22, 21, 20, 1, 0)
    assert flows.export_preprocessed(raw, bars, str(tmp_path))["trading_days"] == 10


def test_stream_equals_batch(spark, tmp_path):
    from volatide.streaming import news

    rows = [(f"u{i}", "c", dt.datetime(2024, 1, 1 + i % 14, 9 + i % 9)) for i in range(60)]
    batch = spark.createDataFrame(rows, "url string, category string, published_at timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    sessions = spark.createDataFrame([(day.date(),) for day in pd.bdate_range("2024-01-01", "2024-01-15")], "date date")
    stream = news.align_stream(news.distinct_articles(news.article_stream(spark, str(tmp_path / "in"), batch.schema)), sessions)
    for _ in range(2):  # the second run finds nothing new
        news.run_available(stream.select("url", "trading_date", "alignment_reason"), str(tmp_path / "out"), str(tmp_path / "at"))
    got = {r["url"]: (r["trading_date"], r["alignment_reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = alignment.align(batch.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), sessions, date=None).collect()
    assert got == {r["url"]: (r["trading_date"], r["alignment_reason"]) for r in want}
    counted = news.article_stream(spark, str(tmp_path / "in"), batch.schema)
    news.score_available(counted, lambda b: b.groupBy("category").count(), str(tmp_path / "scored"), str(tmp_path / "at2"))
    assert spark.read.parquet(str(tmp_path / "scored")).agg(F.sum("count")).first()[0] == 60


def test_forecasts_and_robustness(spark):
    from volatide.plans import flows

    rng = np.random.default_rng(5)
    n = 160
    y = rng.normal(size=n) * 0.01
    vol = np.abs(y) + 0.002

    def build(threshold=0.05, target="parkinson"):
        return series(spark, y, abs_return=np.abs(y), target_vol=vol, target_next_vol=np.r_[vol[1:], vol[0]], mean_sentiment=rng.normal(size=n) * 0.1)

    ends = ("2024-04-10", "2024-05-05")
    out = flows.experiment(build(), *ends, length=5, epochs=2, features=["abs_return", "mean_sentiment", "garch_forecast_vol"])
    f = out["forecasts"].toPandas()
    assert len(f) > 20 and f[["actual", "baseline", "hybrid"]].notna().all().all() and (f["date"] > d(ends[1])).all()
    assert out["errors"].first()["n"] == len(f) and {r["segment"] for r in out["subperiods"].collect()} >= {"year_2024", "shock_regime", "calm_regime"}
    specs = [residual.Spec("hybrid", features=["abs_return"]), residual.Spec("garchx", kind="garchx"), residual.Spec("expanding", kind="expanding")]
    rows = {r["spec"]: r for r in flows.robustness(build, specs, *ends, length=5, epochs=1).collect()}
    assert set(rows) == {"hybrid", "garchx", "expanding"} and all(r["hybrid_rmse"] > 0 for r in rows.values())
    assert len(residual.specifications()) == 7


def test_forecasting_queries_run_the_whole_job(monkeypatch):
    import inspect

    from volatide.operators import residual
    from volatide.plans import flows, model_queries

    calls = []

    def note(real):
        def run(*args, **named):
            bound = inspect.signature(real).bind(*args, **named)
            bound.apply_defaults()
            calls.append(bound.arguments)
            return {"errors": None}

        return run

    monkeypatch.setattr(model_queries, "build_frame", lambda *_: None)
    monkeypatch.setattr(model_queries, "_ends", lambda _: ("a", "b"))
    for owner, name in ((residual, "hybrid_forecasts"), (flows, "robustness"), (flows, "experiment")):
        monkeypatch.setattr(owner, name, note(getattr(owner, name)))
    for query in (model_queries.residual_forecast, model_queries.robustness_specs, model_queries.experiment_errors):
        query(None, "")
    assert [(c["length"], c["epochs"]) for c in calls] == [(15, 30)] * 3
    assert all((c.get("features") or residual.FEATURES) == residual.FEATURES for c in calls)
    assert calls[1]["specs"] == residual.specifications()


def test_robustness_reads_the_large_tables_once_for_all_frames(spark, monkeypatch):
    from volatide.plans import flows, model_queries, news_queries
    from volatide.sources import domain

    sf, read, built, inner = "/root/testdata/sf0.001", [], {}, domain.table

    def noted(spark, sf_dir, name):
        read.append(name)
        return inner(spark, sf_dir, name)

    def build_all(build, specs, *ends):
        built.update({key: build(*key) for key in {(s.threshold, s.target) for s in specs}})

    with monkeypatch.context() as patch:
        patch.setattr(domain, "table", noted)
        patch.setattr(flows, "robustness", build_all)
        model_queries.robustness_specs(spark, sf)
    # Line items for the news, and once a threshold.
    assert read.count("orders") == 1 and read.count("lineitem") == 4
    assert len(built) == 4
    for key, found in built.items():
        alone = news_queries.build_frame(spark, sf, *key)
        assert found.columns == alone.columns
        a, b = (df.orderBy("date").toPandas() for df in (found, alone))
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_urls_are_joined_as_browsers_do(spark):
    from urllib.parse import urldefrag, urljoin

    bases = ["https://h.x/a/c", "https://h.x", "https://h.x/a/b/c/?k=1", "http://h.x:8/a/"]
    urls = ["../b?q", "../../../b", "./x/./y", "/r/../s", "x//y/../z", "..", ".", "a/..", "?p=2", "//o.x/p/../q", "https://z.x/a/../b", "/", "b/?u=../v", "//o.x", "c/d/"]
    rows = [(u, b) for u in urls for b in bases]
    df = spark.createDataFrame(rows, "u string, b string").select("u", "b", text.normalize_url(F.col("u"), F.col("b")).alias("n"))
    for r in df.collect():
        assert r["n"] == urldefrag(urljoin(r["b"], r["u"]))[0], (r["u"], r["b"])


def test_unix_seconds(spark):
    day = F.lit("2024-03-10").cast("date")
    row = spark.range(1).select(dates.unix_seconds(day).alias("a"), dates.unix_seconds(day, True).alias("b"), dates.unix_seconds(day, zone="Asia/Ho_Chi_Minh").alias("c")).first()
    start = int(dt.datetime(2024, 3, 10, tzinfo=dt.timezone.utc).timestamp())
    assert tuple(row) == (start, start + 86399, start - 7 * 3600)


def test_batches_never_exceed_their_size(spark, monkeypatch):
    monkeypatch.setattr(labels, "HASHED_TOGETHER", 90)
    sizes = [r["count"] for r in labels.batches(spark.range(1003).withColumnRenamed("id", "article_id"), 20).groupBy("batch_index").count().collect()]
    assert sum(sizes) == 1003 and max(sizes) == 20 and sum(s < 20 for s in sizes) <= 12


def test_checkpoints_need_three_labels_in_order(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString

    rows = [(f"{w} word {i}", l) for i in range(6) for w, l in (("bad", "negative"), ("so", "neutral"), ("good", "positive"))]
    df = spark.createDataFrame(rows, "input_text string, label string")
    good = classify.train(df)
    classify.check_labels(good, "good")
    with pytest.raises(ValueError, match="2 classes|\\[2\\] classes"):
        classify.check_labels(classify.train(df.where("label <> 'positive'")), "two")
    for names in (["positive", "neutral", "negative"], ["negative", "neutral"]):
        wrong = Pipeline(stages=[*good.stages[:-1], IndexToString(inputCol="prediction", outputCol="__label", labels=names)]).fit(df)
        wrong.save(str(tmp_path / names[0]))
        with pytest.raises(ValueError, match="must be"):
            classify.validate_checkpoint(str(tmp_path / names[0]))


def test_garchx_is_fitted_up_to_the_validation_end(spark):
    """Against the recursion spelled out: lagged sentiment, the whole sample's variance, a day's variance for its row."""
    rng = np.random.default_rng(3)
    n = 140
    y, mood, vol = rng.normal(size=n) * 0.01, rng.normal(size=n) * 0.1, np.abs(rng.normal(size=n)) * 0.01 + 0.002
    df = series(spark, y, mean_sentiment=mood, target_next_vol=vol)
    got = residual.garchx_forecasts(df, "2024-04-20").toPandas().sort_values("date")
    days = [r["date"] for r in df.orderBy("date").collect()]
    cut = sum(x <= dt.date(2024, 4, 20) for x in days)
    assert got["date"].tolist() == days[cut:] and np.allclose(got["actual"], vol[cut:])
    x = np.r_[0.0, mood[:-1]]
    p = garch.fit(y[:cut], exog=x[:cut])
    z = y * 100
    e = z - p["c"] - p["phi"] * np.r_[0.0, z[:-1]]
    v = [max(z.var(ddof=1), p["omega"] / max(1e-6, 1 - p["alpha"] - p["beta"]))]
    for i in range(1, n):
        v.append(p["omega"] + p["alpha"] * e[i - 1] ** 2 + p["beta"] * v[-1] + p["gamma"] * x[i - 1])
    assert np.allclose(got["hybrid"] * 100, np.sqrt(v)[cut:]) and np.allclose(got["gamma"], p["gamma"])


def test_specifications_follow_one_window_and_feature_list(spark):
    by = {s.name: s for s in residual.specifications()}
    assert by["no_sentiment"].features == residual.FEATURES[:6] and len(by["baseline_005"].features) == 17
    assert {"garch_forecast_var", "neutral_share", "macro_sentiment", "market_sentiment"} <= set(residual.FEATURES)


def test_expanding_starts_where_each_series_says(spark):
    rng = np.random.default_rng(8)
    a, b = (series(spark, rng.normal(size=n) * 0.01).withColumn("series_id", F.lit(name)) for n, name in ((90, "a"), (70, "b")))
    days = [r["date"] for r in a.orderBy("date").collect()]
    both = garch.expanding(a.union(b), train_end=str(days[49]), every=10).orderBy("date")
    for df, name in ((a, "a"), (b, "b")):
        alone = garch.expanding(df, 50, every=10).orderBy("date").toPandas()
        assert np.allclose(alone["forecast_vol"], both.where(F.col("series_id") == name).toPandas()["forecast_vol"])
    # One fit a cut, each on the rows before it.
    y = np.array([r["log_return"] for r in a.orderBy("date").collect()])
    p = garch.fit(y[:80])
    row = garch.expanding(a, 50, every=10).orderBy("date").toPandas().iloc[80]
    assert abs(row["std_resid"] - (y[80] * 100 - p["c"] - p["phi"] * y[79] * 100) / (row["conditional_vol"] * 100)) < 1e-6


def test_days_before_the_first_session_and_far_away(spark):
    sessions = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 5),)], "date date")
    days = [dt.date(1, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 4), dt.date(2024, 1, 6), dt.date(9999, 12, 31), None]
    rows = alignment.align(spark.createDataFrame([(str(i), x) for i, x in enumerate(days)], "url string, date date"), sessions, timestamp=None).orderBy("url").collect()
    assert [r["trading_date"] for r in rows] == [dt.date(2024, 1, 3), dt.date(2024, 1, 3), dt.date(2024, 1, 5), None, None, None]
    wide = spark.createDataFrame([(dt.date(1, 1, 1),), (dt.date(9999, 1, 1),)], "date date")
    with pytest.raises(Exception, match="span more than"):
        alignment.align(spark.createDataFrame([("u", days[1])], "url string, date date"), wide, timestamp=None).collect()
