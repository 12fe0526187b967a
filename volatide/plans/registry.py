"""Registering queries beside the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracles[function.__name__] = sql
            return function

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that both engines agree on them."""
    names = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names}) if names else df


def r(*columns: str) -> str:
    """The same in SQL; "a b" rounds a under the name b."""
    pairs = [(c.rsplit(" ", 1) if " " in c else (c, c)) for c in columns]
    return ", ".join(f"round({a}, 6) + 0.0 AS {b}" for a, b in pairs)


# Shared parts of the SQL statements.
BARS = """bars AS (
  SELECT o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close,
    max(o_totalprice) AS high, min(o_totalprice) AS low, count(*)::BIGINT AS volume
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1)"""
RETURNS = f"""{BARS}, returns AS (SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS log_return FROM bars)"""
VOLATILITY = f"""{RETURNS}, spans AS (SELECT *, abs(log_return) AS abs_return, log_return * log_return AS squared_return, ln(high / low) AS hl, ln(close / open) AS co FROM returns),
  vols AS (SELECT *, sqrt(hl * hl / (4 * ln(2))) AS parkinson_vol, sqrt(greatest(0.5::DOUBLE * hl * hl - (2 * ln(2) - 1) * co * co, 0)) AS gk_vol FROM spans),
  features AS (
    SELECT *, coalesce(parkinson_vol, abs_return) AS target_vol, lead(coalesce(parkinson_vol, abs_return)) OVER (ORDER BY date) AS target_next_vol,
      coalesce(gk_vol, abs_return) AS target_gk, lead(coalesce(gk_vol, abs_return)) OVER (ORDER BY date) AS target_next_gk,
      CASE WHEN count(volume) OVER w = 21 THEN (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END AS volume_zscore_21
    FROM vols WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"""
EVENTS = """sessions AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE isodow(ts) <= 5 AND ts::DATE NOT BETWEEN DATE '2024-01-16' AND DATE '2024-01-18'),
  articles AS (
    SELECT event_id::VARCHAR AS url, event_type AS category, CASE WHEN event_type <> 'error' THEN ts END AS published_at, ts::DATE AS date,
      coalesce(props, '') AS body_clean, user_id, value
    FROM events)"""
ALIGN = """marked AS (
    SELECT a.*, coalesce(a.published_at::DATE, a.date) AS origin_date, (a.published_at IS NOT NULL)::INTEGER AS has_timestamp, s.d IS NOT NULL AS on_session,
      coalesce(s.d IS NOT NULL AND a.published_at::TIME > TIME '14:45:00', false) AS late
    FROM articles a LEFT JOIN sessions s ON s.d = coalesce(a.published_at::DATE, a.date)),
  aligned AS (
    SELECT m.*, s.d AS trading_date, m.late::INTEGER AS is_after_close, (s.d - m.origin_date)::BIGINT AS calendar_gap_days,
      CASE WHEN origin_date IS NULL THEN 'unmapped' WHEN late THEN 'after_close_forward' WHEN on_session AND has_timestamp = 1 THEN 'same_session'
        WHEN on_session THEN 'date_only_same_day' WHEN has_timestamp = 1 THEN 'non_trading_forward' ELSE 'date_only_forward' END AS alignment_reason
    FROM marked m ASOF LEFT JOIN sessions s ON m.origin_date + m.late::INTEGER <= s.d)"""
ALIGNED = f"{EVENTS}, {ALIGN}"
LINES = f"""{RETURNS}, sessions AS (SELECT date AS d FROM bars),
  articles AS (
    SELECT l_orderkey || '-' || l_linenumber AS url, l_linestatus AS source, l_returnflag AS category, NULL::TIMESTAMP AS published_at, l_shipdate::DATE AS date, '' AS body_clean
    FROM lineitem), {ALIGN}"""
DAILY_NEWS = """daily_news AS (
    SELECT trading_date AS date, count(*)::BIGINT AS n_articles, count(DISTINCT category)::BIGINT AS n_categories, avg(length(body_clean)) AS mean_body_len,
      avg(is_after_close::DOUBLE) AS after_close_share, avg((alignment_reason IN ('non_trading_forward', 'date_only_forward'))::INTEGER::DOUBLE) AS non_trading_share,
      max(calendar_gap_days) AS max_calendar_gap_days
    FROM aligned WHERE trading_date IS NOT NULL GROUP BY 1)"""
SCORES = """raw_scores AS (
    SELECT l_orderkey || '-' || l_linenumber AS url, l_shipdate::DATE AS trading_date, l_returnflag AS category, round(l_discount * 20 - 1, 6) AS s,
      l_partkey, l_suppkey, l_extendedprice, l_quantity
    FROM lineitem),
  parts AS (
    SELECT *, (1 - 0.9::DOUBLE * abs(s)) / 3 + CASE WHEN s > 0 THEN 0.9::DOUBLE * s ELSE 0 END AS prob_positive,
      (1 - 0.9::DOUBLE * abs(s)) / 3 + CASE WHEN s < 0 THEN -0.9::DOUBLE * s ELSE 0 END AS prob_negative, (1 - 0.9::DOUBLE * abs(s)) / 3 AS prob_neutral
    FROM raw_scores),
  scores AS (
    SELECT *, round(prob_positive - prob_negative, 9) AS sentiment_score,
      CASE WHEN prob_positive > prob_negative AND prob_positive > prob_neutral THEN 'positive' WHEN prob_negative > prob_positive AND prob_negative > prob_neutral THEN 'negative' ELSE 'neutral' END AS sentiment_label
    FROM parts)"""


def daily_sentiment_sql(label: str = "sentiment_label") -> str:
    return f"""labelled AS (SELECT *, {label} AS lab FROM scores),
  daily AS (
    SELECT trading_date AS date, avg(sentiment_score) AS mean_sentiment, coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std, count(*)::BIGINT AS sentiment_volume,
      avg((lab = 'negative')::INTEGER::DOUBLE) AS negative_share, avg((lab = 'neutral')::INTEGER::DOUBLE) AS neutral_share, avg((lab = 'positive')::INTEGER::DOUBLE) AS positive_share,
      avg(sentiment_score) FILTER (category IN ('A')) AS macro_sentiment, avg(sentiment_score) FILTER (category IN ('R')) AS market_sentiment
    FROM labelled GROUP BY 1),
  sentiment AS (
    SELECT *, positive_share - negative_share AS net_sentiment,
      mean_sentiment - coalesce(avg(mean_sentiment) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS sentiment_surprise,
      (macro_sentiment IS NULL)::INTEGER AS macro_sentiment_missing, (market_sentiment IS NULL)::INTEGER AS market_sentiment_missing
    FROM daily)"""


#: Unicode white space as RE2 has to be told.
BLANK = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INK = BLANK.replace("[", "[^", 1)


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANK}+', ' ', 'g'))"


DOCS = """docs AS (
    SELECT doc_id::VARCHAR AS article_id, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS category,
      strftime(DATE '1995-01-02' + (doc_id % 2400)::INTEGER, '%Y-%m-%d') || ' ' || lpad((((doc_id * 37) % 1440) // 60)::VARCHAR, 2, '0') || ':' || lpad(((doc_id * 37) % 60)::VARCHAR, 2, '0') || ':00' AS published_at,
      substring(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') AS body_text
    FROM documents)"""
NOTES = """notes AS (
    SELECT doc_id::VARCHAR AS article_id, doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label, 0.5::DOUBLE + (doc_id % 50) / 100 AS confidence
    FROM labels)"""
