"""Sessions, news controls, sentiment and the modelling frame."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.functions.dates import market_timestamp
from volatide.operators import alignment, checks, frame, reconcile, stats
from volatide.operators.sentiment import daily_sentiment, lagged_sentiment
from volatide.operators.volatility import log_returns
from volatide.plans.registry import ALIGNED, DAILY_NEWS, EVENTS, LINES, SCORES, VOLATILITY, Registry, daily_sentiment_sql, r, rounded
from volatide.sources import domain
from volatide.sources.domain import bars
from volatide.storage import cut, new_folder
from volatide.streaming import ledger, news

REGISTRY = query = Registry()

# Categories that stand for macro and market news.
GROUPS = {"macro": ("A",), "market": ("R",)}


def aligned_events(spark, sf_dir) -> DataFrame:
    return alignment.align(domain.event_articles(spark, sf_dir), domain.event_sessions(spark, sf_dir))


def aligned_lines(spark, sf_dir) -> DataFrame:
    return alignment.align(domain.line_articles(spark, sf_dir), bars(spark, sf_dir).select("date"), timestamp=None)


def _map_sql(operator: str) -> str:
    return f"""WITH {EVENTS}, bounds AS (SELECT min(date) AS a, max(date) AS b FROM articles), days AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM bounds)
    SELECT day, s.d AS session FROM days ASOF LEFT JOIN sessions s ON day {operator} s.d"""


@query(_map_sql("<="))
def session_map_ge(spark, sf_dir):
    m = alignment.session_map(domain.event_sessions(spark, sf_dir), domain.event_articles(spark, sf_dir).select("date"))
    return m.select("day", F.col("next_ge").alias("session"))


@query(_map_sql("<"))
def session_map_gt(spark, sf_dir):
    m = alignment.session_map(domain.event_sessions(spark, sf_dir), domain.event_articles(spark, sf_dir).select("date"))
    return m.select("day", F.col("next_gt").alias("session"))


ALIGNED_COLUMNS = ["url", "origin_date", "trading_date", "has_timestamp", "is_after_close", "alignment_reason", "calendar_gap_days"]


@query(f"WITH {ALIGNED} SELECT {', '.join(ALIGNED_COLUMNS)} FROM aligned")
def article_alignment(spark, sf_dir):
    return aligned_events(spark, sf_dir).select(*ALIGNED_COLUMNS)


@query(f"WITH {LINES} SELECT {', '.join(ALIGNED_COLUMNS)} FROM aligned")
def article_alignment_date_only(spark, sf_dir):
    return aligned_lines(spark, sf_dir).select(*ALIGNED_COLUMNS)


@query(f"WITH {ALIGNED} SELECT alignment_reason, count(*)::BIGINT AS n FROM aligned GROUP BY 1")
def alignment_reasons(spark, sf_dir):
    return aligned_events(spark, sf_dir).groupBy("alignment_reason").agg(F.count("*").alias("n"))


NEWS = ("mean_body_len", "after_close_share", "non_trading_share")


@query(f"WITH {ALIGNED}, {DAILY_NEWS} SELECT date, n_articles, n_categories, max_calendar_gap_days, {r(*NEWS)} FROM daily_news")
def daily_news_controls(spark, sf_dir):
    return rounded(alignment.daily_news(aligned_events(spark, sf_dir)))


@query(
    f"""WITH {LINES}, {DAILY_NEWS} SELECT date, {r('close', 'open', 'high', 'low')}, volume, {r('log_return')}, coalesce(n_articles, 0)::BIGINT AS n_articles, coalesce(n_categories, 0)::BIGINT AS n_categories,
    {r(*[f'coalesce({c}, 0) {c}' for c in NEWS])}, coalesce(max_calendar_gap_days, 0)::BIGINT AS max_calendar_gap_days FROM returns LEFT JOIN daily_news USING (date)"""
)
def daily_news_prices(spark, sf_dir):
    daily = alignment.news_prices(log_returns(bars(spark, sf_dir)), alignment.daily_news(aligned_lines(spark, sf_dir)))
    return rounded(daily.drop("series_id"))


@query(
    f"""WITH {LINES}, {DAILY_NEWS}, p AS (SELECT coalesce(n_articles, 0) AS n FROM bars LEFT JOIN daily_news USING (date))
    SELECT (SELECT count(*) FROM articles)::BIGINT AS raw_rows, count(*)::BIGINT AS clean_rows, count(trading_date)::BIGINT AS mapped_rows, (count(*) - count(trading_date))::BIGINT AS unmapped_rows,
      {r('avg(has_timestamp::DOUBLE) timestamp_share')}, sum((alignment_reason = 'after_close_forward')::INTEGER)::BIGINT AS after_close_rows,
      sum((alignment_reason IN ('non_trading_forward', 'date_only_forward'))::INTEGER)::BIGINT AS non_trading_rows,
      (SELECT count(*) FROM p)::BIGINT AS trading_days, (SELECT count(*) FROM p WHERE n = 0)::BIGINT AS zero_news_days FROM aligned"""
)
def preprocessing_diagnostics(spark, sf_dir):
    aligned = aligned_lines(spark, sf_dir)
    daily = alignment.news_prices(bars(spark, sf_dir), alignment.daily_news(aligned))
    return rounded(alignment.diagnostics(domain.line_articles(spark, sf_dir), aligned, daily))


@query(
    f"""WITH {ALIGNED}, {DAILY_NEWS} SELECT (SELECT count(*) FROM articles)::BIGINT AS raw_rows, count(*)::BIGINT AS clean_rows, count(trading_date)::BIGINT AS mapped_rows, (count(*) - count(trading_date))::BIGINT AS unmapped_rows,
      {r('avg(has_timestamp::DOUBLE) timestamp_share')}, sum((alignment_reason = 'after_close_forward')::INTEGER)::BIGINT AS after_close_rows,
      sum((alignment_reason IN ('non_trading_forward', 'date_only_forward'))::INTEGER)::BIGINT AS non_trading_rows,
      (SELECT count(*) FROM sessions)::BIGINT AS trading_days, (SELECT count(*) FROM sessions WHERE d NOT IN (SELECT date FROM daily_news))::BIGINT AS zero_news_days FROM aligned"""
)
def observed_diagnostics(spark, sf_dir):
    """The report of a run that writes its articles and days: all counts come from the passes that write."""
    folder = new_folder(spark, "preprocessed")
    prices = domain.event_sessions(spark, sf_dir).select("date")
    report = alignment.write_aligned(domain.event_articles(spark, sf_dir), prices, f"{folder}/articles", f"{folder}/daily")
    return rounded(spark.createDataFrame([report], "raw_rows long, clean_rows long, mapped_rows long, unmapped_rows long, timestamp_share double, after_close_rows long, non_trading_rows long, trading_days long, zero_news_days long"))


@query(f"WITH {LINES}, {DAILY_NEWS}, p AS (SELECT coalesce(n_articles, 0) AS n FROM bars LEFT JOIN daily_news USING (date)) SELECT {r('avg(n) mean', 'stddev_samp(n) std', 'min(n)::DOUBLE min', 'max(n)::DOUBLE max', 'avg((n = 0)::INTEGER::DOUBLE) zero_share')} FROM p")
def news_volume_stats(spark, sf_dir):
    return rounded(stats.news_volume(alignment.news_prices(bars(spark, sf_dir), alignment.daily_news(aligned_lines(spark, sf_dir)))))


@query(f"WITH {LINES}, {DAILY_NEWS}, p AS (SELECT coalesce(n_articles, 0) AS n FROM bars LEFT JOIN daily_news USING (date)) SELECT count(*)::BIGINT AS daily_rows, sum((n = 0)::INTEGER)::BIGINT AS zero_news_days, sum((n = 1)::INTEGER)::BIGINT AS one_article_days FROM p")
def daily_aggregation_validation(spark, sf_dir):
    return checks.daily_validation(alignment.news_prices(bars(spark, sf_dir), alignment.daily_news(aligned_lines(spark, sf_dir))))


@query("SELECT event_id::VARCHAR AS url, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 7 HOUR ELSE ts END AS local FROM events")
def market_timestamps(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("+00:00"))).otherwise(text)
    return e.select(F.col("event_id").cast("string").alias("url"), market_timestamp(text).alias("local"))


@query(f"WITH {EVENTS} SELECT url, origin FROM (SELECT url, coalesce(published_at::DATE, date) AS origin FROM articles) WHERE origin IN (SELECT d FROM sessions)")
def session_semi_join(spark, sf_dir):
    a = domain.event_articles(spark, sf_dir).select("url", F.coalesce(F.col("published_at").cast("date"), F.col("date")).alias("origin"))
    return a.join(domain.event_sessions(spark, sf_dir).withColumnRenamed("date", "origin"), "origin", "left_semi").select("url", "origin")


@query("SELECT event_id::VARCHAR AS url FROM events WHERE event_id % 3 <> 0")
def ledger_anti_join(spark, sf_dir):
    urls = domain.event_articles(spark, sf_dir).select("url")
    ledger = urls.select("url", F.when(F.col("url").cast("long") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return reconcile.not_done(urls, ledger)


@query("SELECT event_id::VARCHAR AS url, ts::DATE AS day, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def date_range_filter(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    e = e.where(F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    return e.select(F.col("event_id").cast("string").alias("url"), "day", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- sentiment ------------------------------------------------------------------------------------------------


def sentiment(spark, sf_dir, threshold=0.05) -> DataFrame:
    return daily_sentiment(domain.scores(spark, sf_dir), threshold=threshold, **GROUPS)


SENTIMENT = f"{SCORES}, {daily_sentiment_sql()}"


@query(f"WITH {SENTIMENT} SELECT date, {r('mean_sentiment', 'sentiment_std')}, sentiment_volume FROM sentiment")
def daily_sentiment_base(spark, sf_dir):
    return rounded(sentiment(spark, sf_dir).select("date", "mean_sentiment", "sentiment_std", "sentiment_volume"))


@query(f"WITH {SENTIMENT} SELECT date, {r('negative_share', 'neutral_share', 'positive_share')} FROM sentiment")
def label_shares_daily(spark, sf_dir):
    return rounded(sentiment(spark, sf_dir).select("date", "negative_share", "neutral_share", "positive_share"))


@query(f"WITH {SENTIMENT} SELECT date, {r('net_sentiment')} FROM sentiment")
def net_sentiment(spark, sf_dir):
    return rounded(sentiment(spark, sf_dir).select("date", "net_sentiment"))


@query(f"WITH {SENTIMENT} SELECT date, {r('sentiment_surprise')} FROM sentiment")
def sentiment_surprise(spark, sf_dir):
    return rounded(sentiment(spark, sf_dir).select("date", "sentiment_surprise"))


@query(f"WITH {SENTIMENT} SELECT date, {r('macro_sentiment', 'market_sentiment')}, macro_sentiment_missing, market_sentiment_missing FROM sentiment")
def macro_market_sentiment(spark, sf_dir):
    return rounded(sentiment(spark, sf_dir).select("date", "macro_sentiment", "market_sentiment", "macro_sentiment_missing", "market_sentiment_missing"))


@query(f"WITH {SENTIMENT} SELECT date, {r('coalesce(lag(mean_sentiment) OVER (ORDER BY date), 0) lag_mean_sentiment')} FROM sentiment")
def lagged_mean_sentiment(spark, sf_dir):
    return rounded(lagged_sentiment(sentiment(spark, sf_dir)).select("date", "lag_mean_sentiment"))


CATEGORY_LOOKUP = f"""{SCORES}, firsts AS (SELECT url, min(category) AS category FROM scores GROUP BY url),
  looked AS (SELECT s.trading_date, s.sentiment_score, f.category FROM scores s LEFT JOIN firsts f USING (url))"""


@query(f"WITH {CATEGORY_LOOKUP} SELECT trading_date AS date, {r('''avg(sentiment_score) FILTER (category = 'A') macro_sentiment''', '''avg(sentiment_score) FILTER (category = 'R') market_sentiment''')} FROM looked GROUP BY 1")
def macro_market_by_lookup(spark, sf_dir):
    s = domain.scores(spark, sf_dir)
    lookup = s.groupBy("url").agg(F.min("category").alias("category"))
    return rounded(daily_sentiment(s.drop("category"), lookup, **GROUPS).select("date", "macro_sentiment", "market_sentiment"))


def _threshold_sql(t: float) -> str:
    label = f"CASE WHEN sentiment_score > {t} THEN 'positive' WHEN sentiment_score < -{t} THEN 'negative' ELSE 'neutral' END"
    return f"WITH {SCORES}, {daily_sentiment_sql(label)} SELECT date, {r('negative_share', 'neutral_share', 'positive_share', 'net_sentiment')} FROM sentiment"


def _threshold(spark, sf_dir, t):
    s = domain.scores(spark, sf_dir)
    s = s.drop("sentiment_label") if t == 0.05 else s
    return rounded(daily_sentiment(s, threshold=t, **GROUPS).select("date", "negative_share", "neutral_share", "positive_share", "net_sentiment"))


@query(_threshold_sql(0.05))
def sentiment_threshold_005(spark, sf_dir):
    return _threshold(spark, sf_dir, 0.05)


@query(_threshold_sql(0.10))
def sentiment_threshold_010(spark, sf_dir):
    return _threshold(spark, sf_dir, 0.10)


@query(_threshold_sql(0.15))
def sentiment_threshold_015(spark, sf_dir):
    return _threshold(spark, sf_dir, 0.15)


@query(f"WITH {SENTIMENT} SELECT date, {r('mean_sentiment', 'sentiment_std')}, sentiment_volume FROM sentiment")
def daily_sentiment_passthrough(spark, sf_dir):
    ready = sentiment(spark, sf_dir).select(F.col("date").cast("string").alias("date"), "mean_sentiment", "sentiment_std", "sentiment_volume")
    return rounded(daily_sentiment(ready))


def _frame_sql(target: str, ahead: str) -> str:
    zero = ["mean_body_len", "mean_sentiment", "sentiment_std", "negative_share", "neutral_share", "positive_share", "net_sentiment", "sentiment_surprise"]
    return f"""WITH {VOLATILITY}, {LINES[LINES.index('sessions AS'):]}, {DAILY_NEWS}, {SENTIMENT}
    SELECT date, {r('log_return', 'abs_return', f'{target} target_vol', f'{ahead} target_next_vol', 'volume_zscore_21')},
      coalesce(n_articles, 0)::BIGINT AS n_articles, coalesce(n_categories, 0)::BIGINT AS n_categories, {r(*[f'coalesce({c}, 0) {c}' for c in zero])},
      coalesce(sentiment_volume, 0)::BIGINT AS sentiment_volume, {r(*[f'CASE WHEN coalesce(sentiment_volume, 0) = 0 THEN coalesce({c}, 0) ELSE {c} END {c}' for c in ('macro_sentiment', 'market_sentiment')])},
      coalesce(macro_sentiment_missing, 1) AS macro_sentiment_missing, coalesce(market_sentiment_missing, 1) AS market_sentiment_missing,
      (coalesce(sentiment_volume, 0) > 0)::INTEGER AS has_sentiment, (coalesce(sentiment_volume, 0) > 0)::INTEGER AS has_news
    FROM features LEFT JOIN daily_news USING (date) LEFT JOIN sentiment USING (date)"""


FRAME = [
    "date", "log_return", "abs_return", "target_vol", "target_next_vol", "volume_zscore_21", "n_articles", "n_categories", "mean_body_len", "mean_sentiment", "sentiment_std",
    "negative_share", "neutral_share", "positive_share", "net_sentiment", "sentiment_surprise", "sentiment_volume", "macro_sentiment", "market_sentiment",
    "macro_sentiment_missing", "market_sentiment_missing", "has_sentiment", "has_news",
]


class DailyParts:
    """The daily tables that frames are joined of. Each is made when it is first asked for, once, and written to the shared folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self._sentiment = spark, sf_dir, {}

    @functools.cached_property
    def bars(self) -> DataFrame:
        return cut(bars(self.spark, self.sf_dir))

    @functools.cached_property
    def news(self) -> DataFrame:
        return cut(alignment.daily_news(alignment.align(domain.line_articles(self.spark, self.sf_dir), self.bars.select("date"), timestamp=None)))

    def sentiment(self, threshold: float) -> DataFrame:
        if threshold not in self._sentiment:
            self._sentiment[threshold] = cut(daily_sentiment(domain.scores(self.spark, self.sf_dir), None, threshold, **GROUPS))
        return self._sentiment[threshold]


def build_frame(spark, sf_dir, threshold=0.05, target="parkinson", parts: DailyParts | None = None) -> DataFrame:
    """The frame; with `parts`, of what they hold already."""
    if parts is not None:
        return frame.validate(frame.model_frame(parts.bars, parts.news, parts.sentiment(threshold), None, threshold, target, **GROUPS))
    news = alignment.daily_news(aligned_lines(spark, sf_dir))
    return frame.validate(frame.model_frame(bars(spark, sf_dir), news, domain.scores(spark, sf_dir), None, threshold, target, **GROUPS))


@query(_frame_sql("target_vol", "target_next_vol"))
def model_frame_parkinson(spark, sf_dir):
    return rounded(build_frame(spark, sf_dir).select(*FRAME))


@query(_frame_sql("target_gk", "target_next_gk"))
def model_frame_gk(spark, sf_dir):
    return rounded(build_frame(spark, sf_dir, target="garman_klass").select(*FRAME))


# --- checks of scores -----------------------------------------------------------------------------------------


def _shares_sql(by: str, name: str) -> str:
    return f"""WITH {SCORES}, c AS (SELECT {by} AS {name}, {', '.join(f"sum((sentiment_label = '{x}')::INTEGER)::BIGINT AS n_{x}" for x in ('negative', 'neutral', 'positive'))}, count(*) AS t FROM scores GROUP BY 1)
    SELECT {name}, n_negative, n_neutral, n_positive, {r(*[f'n_{x} / t {x}_share' for x in ('negative', 'neutral', 'positive')])},
      CASE WHEN n_positive / t > 0.7 THEN 'positive' WHEN n_neutral / t > 0.7 THEN 'neutral' WHEN n_negative / t > 0.7 THEN 'negative' END AS dominant_label FROM c"""


@query(_shares_sql("year(trading_date)::INTEGER", "year"))
def year_label_shares(spark, sf_dir):
    return rounded(checks.label_shares(domain.scores(spark, sf_dir), F.year("trading_date"), "year"))


@query(_shares_sql("category", "category"))
def category_label_shares(spark, sf_dir):
    return rounded(checks.label_shares(domain.scores(spark, sf_dir), F.col("category"), "category"))


@query(f"WITH {SCORES}, c AS (SELECT least(floor((sentiment_score + 1) / 0.1::DOUBLE), 19)::BIGINT AS bin, count(*) AS n FROM scores WHERE sentiment_score BETWEEN -1 AND 1 GROUP BY 1) SELECT b.bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON b.bin = c.bin")
def score_histogram_20(spark, sf_dir):
    return checks.histogram(domain.scores(spark, sf_dir), "sentiment_score", -1.0, 1.0, 20)


@query(f"WITH {SCORES} SELECT {r('avg((sentiment_score > 0.05)::INTEGER::DOUBLE) positive_share', 'avg((sentiment_score < -0.05)::INTEGER::DOUBLE) negative_share', 'avg((sentiment_score BETWEEN -0.05 AND 0.05)::INTEGER::DOUBLE) neutral_share')} FROM scores")
def score_threshold_shares(spark, sf_dir):
    return rounded(checks.threshold_shares(domain.scores(spark, sf_dir)))


@query(
    f"""WITH {SCORES}, x AS (SELECT sentiment_score AS v FROM scores WHERE sentiment_score IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS t FROM x),
    c AS (SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY 1)
    SELECT b.bin, coalesce(c.n, 0)::BIGINT AS n, {r('coalesce(c.n, 0) / (t * ((hi - lo) / 50)) density')} FROM (SELECT unnest(range(50)) AS bin) b LEFT JOIN c ON b.bin = c.bin, e"""
)
def score_histogram_50(spark, sf_dir):
    return rounded(checks.data_histogram(domain.scores(spark, sf_dir), "sentiment_score", 50))


VALIDATION = f"""{VOLATILITY}, {SENTIMENT}, top AS (SELECT date FROM features WHERE abs_return IS NOT NULL ORDER BY abs_return DESC, date LIMIT 20),
  tested AS (SELECT (SELECT coalesce(avg(negative_share), 0) FROM sentiment) AS corpus_negative, (SELECT coalesce(avg(coalesce(negative_share, 0)), 0) FROM top LEFT JOIN sentiment USING (date)) AS top_negative)"""


@query(f"WITH {VALIDATION} SELECT {r('corpus_negative', 'top_negative')}, top_negative > corpus_negative AS passed FROM tested")
def top20_volatility_check(spark, sf_dir):
    from volatide.plans.market_queries import features

    return rounded(checks.volatility_check(features(spark, sf_dir), domain.scores(spark, sf_dir)))


@query(
    f"""WITH {VALIDATION}, yl AS (SELECT y, max(n / t) AS top FROM (SELECT year(trading_date) AS y, sentiment_label, count(*) AS n, sum(count(*)) OVER (PARTITION BY year(trading_date)) AS t FROM scores GROUP BY 1, 2) GROUP BY 1),
    b AS (
      SELECT (SELECT count(*) FROM scores)::BIGINT AS articles_rows, count(*)::BIGINT AS sentiment_rows, max(abs(prob_neutral + prob_positive + prob_negative - 1)) AS probability_error,
        (count(*) - count(DISTINCT url))::BIGINT AS duplicate_urls, avg((sentiment_label = 'negative')::INTEGER::DOUBLE) FILTER (category = 'R') AS h,
        avg((sentiment_label = 'negative')::INTEGER::DOUBLE) FILTER (category = 'N') AS l, (SELECT count(*) FROM yl WHERE top > 0.7)::BIGINT AS dominant_years FROM scores),
    g AS (SELECT *, articles_rows = sentiment_rows AS row_count_match, duplicate_urls = 0 AS no_duplicate_urls, probability_error < 1e-5 AS probabilities_sum_to_one,
      sentiment_rows < 50 OR dominant_years = 0 AS no_dominant_year, sentiment_rows < 50 OR h > l AS category_check, (SELECT top_negative > corpus_negative FROM tested) AS volatility_check FROM b)
    SELECT articles_rows, sentiment_rows, {r('probability_error')}, duplicate_urls, dominant_years, row_count_match, no_duplicate_urls, probabilities_sum_to_one, no_dominant_year, category_check, volatility_check,
      row_count_match AND no_duplicate_urls AND probabilities_sum_to_one AND no_dominant_year AND category_check AND volatility_check AS ready_for_modeling FROM g"""
)
def inference_validation(spark, sf_dir):
    from volatide.plans.market_queries import features

    s = domain.scores(spark, sf_dir)
    return rounded(checks.inference_validation(s, s, "R", "N", features(spark, sf_dir)))


@query(
    f"""WITH {SCORES}, n AS (SELECT count(*)::BIGINT AS n, {', '.join(f"sum((sentiment_label = '{x}')::INTEGER)::BIGINT AS n_{x}" for x in ('negative', 'neutral', 'positive'))}, avg(sentiment_score) AS mean, stddev_samp(sentiment_score) AS std, min(sentiment_score) AS min, max(sentiment_score) AS max FROM scores)
    SELECT n, n_negative, n_neutral, n_positive, {r('mean', 'std', 'min', 'max')} FROM n"""
)
def sentiment_descriptive(spark, sf_dir):
    s = domain.scores(spark, sf_dir)
    count = lambda x: F.sum((F.col("sentiment_label") == x).cast("long")).alias(f"n_{x}")
    x = F.coalesce("sentiment_score", F.lit(0.0))
    return rounded(s.agg(F.count("*").alias("n"), count("negative"), count("neutral"), count("positive"), F.avg("sentiment_score").alias("mean"), F.stddev_samp(x).alias("std"), F.min("sentiment_score").alias("min"), F.max("sentiment_score").alias("max")))


# --- joining articles and scores ------------------------------------------------------------------------------

PAIRS = f"""{SCORES}, a AS (
    SELECT l_orderkey || '-' || l_linenumber AS url, l_shipdate::DATE AS trading_date, min(struct_pack(p := l_partkey, s := l_suppkey, c := l_returnflag, o := l_linestatus)) AS x
    FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2),
  s AS (SELECT url, trading_date, min(struct_pack(p := -l_partkey, s := -l_suppkey, c := category, v := sentiment_score)) AS x FROM scores WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)"""
SHOWN = "url, trading_date, a.x.o AS source, a.x.c AS category, s.x.c AS category_sentiment, round(s.x.v, 6) + 0.0 AS sentiment_score"


def _articles(spark, sf_dir) -> DataFrame:
    a = domain.line_articles(spark, sf_dir).where(F.col("l_suppkey") % 7 != 0)
    return a.select("url", F.col("date").alias("trading_date"), "category", "source", "l_partkey", "l_suppkey")


def _merged(spark, sf_dir, how):
    s = domain.scores(spark, sf_dir).where(F.col("l_suppkey") % 5 != 0).select("url", "trading_date", "category", "sentiment_score", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    first = [F.col("l_partkey"), F.col("l_suppkey"), F.col("category"), F.col("source")]
    last = [-F.col("p"), -F.col("s"), F.col("category"), F.col("sentiment_score")]
    out = reconcile.merge_scores(_articles(spark, sf_dir), s, how, first, last)
    return rounded(out.select("url", "trading_date", "source", "category", "category_sentiment", "sentiment_score"))


@query(f"WITH {PAIRS} SELECT {SHOWN} FROM a LEFT JOIN s USING (url, trading_date)")
def merge_articles_sentiment_left(spark, sf_dir):
    return _merged(spark, sf_dir, "left")


@query(f"WITH {PAIRS} SELECT {SHOWN} FROM a JOIN s USING (url, trading_date)")
def merge_articles_sentiment_inner(spark, sf_dir):
    return _merged(spark, sf_dir, "inner")


@query(
    f"""WITH {PAIRS} SELECT CASE WHEN a.x IS NOT NULL AND s.x IS NOT NULL THEN 'both' WHEN a.x IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge, count(*)::BIGINT AS n
    FROM a FULL JOIN s USING (url, trading_date) GROUP BY 1"""
)
def key_reconciliation(spark, sf_dir):
    s = domain.scores(spark, sf_dir).where(F.col("l_suppkey") % 5 != 0)
    return reconcile.reconcile_keys(_articles(spark, sf_dir), s, ["url", "trading_date"])


@query(f"WITH {EVENTS} SELECT url, category, date FROM articles ORDER BY date DESC, url LIMIT 50")
def latest_articles(spark, sf_dir):
    """A report of the first 50 articles, latest days first."""
    return domain.event_articles(spark, sf_dir).select("url", "category", "date").orderBy(F.desc("date"), "url").limit(50)


def _bucketed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = domain.scores(spark, sf_dir).where(F.col("l_suppkey") % 5 != 0).select("url", "trading_date", "category", "sentiment_score", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    folder = new_folder(spark, "bucketed")
    name = folder.rsplit("-", 1)[-1]
    return reconcile.write_bucketed(_articles(spark, sf_dir), f"articles_{name}", f"{folder}/articles"), reconcile.write_bucketed(s, f"scores_{name}", f"{folder}/scores")


@query(f"WITH {PAIRS} SELECT {SHOWN} FROM a LEFT JOIN s USING (url, trading_date)")
def merge_articles_sentiment_bucketed(spark, sf_dir):
    """The left merge of tables that are bucketed by its keys."""
    articles, scores = _bucketed(spark, sf_dir)
    first = [F.col("l_partkey"), F.col("l_suppkey"), F.col("category"), F.col("source")]
    last = [-F.col("p"), -F.col("s"), F.col("category"), F.col("sentiment_score")]
    out = reconcile.merge_scores(articles, scores, "left", first, last)
    return rounded(out.select("url", "trading_date", "source", "category", "category_sentiment", "sentiment_score"))


@query(
    f"""WITH {PAIRS} SELECT CASE WHEN a.x IS NOT NULL AND s.x IS NOT NULL THEN 'both' WHEN a.x IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge, count(*)::BIGINT AS n
    FROM a FULL JOIN s USING (url, trading_date) GROUP BY 1"""
)
def key_reconciliation_bucketed(spark, sf_dir):
    return reconcile.reconcile_bucketed(*_bucketed(spark, sf_dir), ["url", "trading_date"])


ORDERED = "ORDER BY l_partkey, l_suppkey, l_returnflag, l_extendedprice, l_quantity"


@query(f"SELECT url, l_partkey, l_suppkey, category FROM (SELECT l_orderkey || '-' || l_linenumber AS url, l_partkey, l_suppkey, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey, l_linenumber {ORDERED}) AS i FROM lineitem) WHERE i = 1")
def dedupe_first(spark, sf_dir):
    a = domain.line_articles(spark, sf_dir).select("url", "l_partkey", "l_suppkey", "category", "l_extendedprice", "l_quantity")
    return reconcile.keep_one(a, ["url"], [F.col(c) for c in ("l_partkey", "l_suppkey", "category", "l_extendedprice", "l_quantity")]).select("url", "l_partkey", "l_suppkey", "category")


@query(f"SELECT url, l_partkey, l_suppkey FROM (SELECT l_orderkey || '-' || l_linenumber AS url, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS i FROM lineitem) WHERE i = 1")
def dedupe_last(spark, sf_dir):
    a = domain.line_articles(spark, sf_dir).select("url", "l_partkey", "l_suppkey")
    return reconcile.keep_one(a, ["url"], [-F.col("l_partkey"), -F.col("l_suppkey")])


@query("SELECT l_orderkey AS k, max(l_suppkey % 2) AS side FROM lineitem GROUP BY 1 HAVING min(l_suppkey % 2) = max(l_suppkey % 2)")
def key_set_difference(spark, sf_dir):
    line = domain.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 2).alias("side"))
    return line.groupBy("k").agg(F.min("side").alias("lo"), F.max("side").alias("side")).where("lo = side").select("k", "side")


@query(f"WITH {ALIGNED} SELECT url, origin_date, trading_date, alignment_reason FROM aligned WHERE published_at IS NOT NULL")
def stream_alignment(spark, sf_dir):
    """The stream's rows, processed with an available-now trigger. Articles without a timestamp have no place in a stream."""
    root = new_folder(spark, "stream")
    batch = domain.event_articles(spark, sf_dir).where("published_at is not null").select("url", "category", F.col("published_at").cast("timestamp").alias("published_at"))
    batch.write.parquet(f"{root}/in")
    stream = news.article_stream(spark, f"{root}/in", batch.schema)
    found = news.align_stream(news.distinct_articles(stream), domain.event_sessions(spark, sf_dir).select("date"))
    news.run_available(found.select("url", "origin_date", "trading_date", "alignment_reason"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def _in_turns(spark, rows: DataFrame, turn, turns: int, name: str, start) -> str:
    """Write the rows by turn, and start a stream anew after each turn has arrived; gives the folder of all of it."""
    root = new_folder(spark, name)
    rows.withColumn("turn", turn.cast("int")).write.partitionBy("turn").parquet(f"{root}/waiting")
    path = lambda part: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path("in"))
    for n in range(turns):
        if files.exists(path(f"waiting/turn={n}")):
            files.rename(path(f"waiting/turn={n}"), path(f"in/turn={n}"))
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
        start(stream, root)
    return root


@query(f"WITH {ALIGNED}, {DAILY_NEWS} SELECT date, n_articles, n_categories, max_calendar_gap_days, {r(*NEWS)} FROM daily_news")
def stream_daily_news(spark, sf_dir):
    """The news controls of all events, which arrive in three turns by a hash, so every turn touches every day again."""
    articles = domain.event_articles(spark, sf_dir).select("url", "category", "published_at", "date", "body_clean")
    sessions = domain.event_sessions(spark, sf_dir)
    root = _in_turns(spark, articles, F.pmod(F.xxhash64("url"), F.lit(3)), 3, "daily-news", lambda stream, root: news.upsert_days(news.daily_news_stream(stream, sessions), f"{root}/daily", f"{root}/checkpoint"))
    return rounded(spark.read.schema("date date, n_articles long, n_categories long, mean_body_len double, after_close_share double, non_trading_share double, max_calendar_gap_days long").parquet(f"{root}/daily"))


@query(
    """WITH a AS (
      SELECT user_id || '/' || ts::DATE AS url, ts AS moment, event_type IN ('purchase', 'signup') AS ok, event_type AS error FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    t AS (SELECT *, count(*) OVER (PARTITION BY url) AS total, min(moment) FILTER (ok) OVER (PARTITION BY url) AS first_ok FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY moment, error) AS i FROM t WHERE NOT ok AND (first_ok IS NULL OR moment < first_ok)),
    s AS (SELECT url, count(*) AS n, max(moment) FILTER (i <= 3) AS last_at, max_by(error, i) FILTER (i <= 3) AS last_error, max(moment) FILTER (i = 3) AS dead_at FROM f GROUP BY url),
    u AS (SELECT url, any_value(total) AS total, any_value(first_ok) AS first_ok FROM t GROUP BY url),
    o AS (
      SELECT u.url, CASE WHEN coalesce(n, 0) >= 3 THEN 'dead' WHEN first_ok IS NOT NULL THEN 'completed' ELSE 'failed' END AS status, coalesce(n, 0) AS n, total, last_error, last_at, first_ok, dead_at
      FROM u LEFT JOIN s USING (url)
    ), x AS (
      SELECT *, CASE status WHEN 'dead' THEN 3 WHEN 'completed' THEN n + 1 ELSE n END AS attempts, CASE WHEN status = 'failed' THEN last_at + INTERVAL 600 SECOND * (2 ** (n - 1)) END AS retry_at FROM o)
    SELECT url, status, attempts::BIGINT AS attempts, (total - attempts)::BIGINT AS skipped, last_error, epoch_us(retry_at) AS retry_us, CASE status WHEN 'dead' THEN epoch_us(dead_at) WHEN 'completed' THEN epoch_us(first_ok) END AS done_us,
      coalesce(retry_at <= (SELECT max(moment) FROM a) - INTERVAL 1 HOUR, false) AS due FROM x"""
)
def fetch_ledger(spark, sf_dir):
    """Events as attempts to fetch a user's page of a day, in three turns by time; purchases and signups succeed."""
    e = domain.table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    at = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    attempts = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("url"), at.alias("at"), F.col("event_type").isin("purchase", "signup").alias("ok"), F.col("event_type").alias("error"))
    cuts, n = attempts.agg(F.percentile_approx("at", F.array(F.lit(0.3), F.lit(0.7)), F.lit(1000)), F.count("*")).first()
    cuts, shards = cuts or [], max(16, n // 10_000)
    turn = sum((F.col("at") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    root = _in_turns(spark, attempts, turn, 3, "ledger", lambda stream, root: ledger.run(stream, f"{root}/ledger", f"{root}/checkpoint", shards=shards))
    micros = lambda c: F.unix_micros(c)
    return ledger.read(spark, f"{root}/ledger").select("url", "status", "attempts", "skipped", "last_error", micros("retry_at").alias("retry_us"), micros("done_at").alias("done_us"), "due")
