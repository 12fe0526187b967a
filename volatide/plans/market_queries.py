"""Bars, returns, volatilities and statistics of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.operators import checks, garch, labels, residual, stats
from volatide.operators.volatility import by_date, log_returns, volatility_features, with_series
from volatide.plans.registry import BARS, RETURNS, VOLATILITY, Registry, r, rounded
from volatide.sources import domain, files
from volatide.sources.domain import bars

REGISTRY = query = Registry()


def features(spark, sf_dir, target="parkinson") -> DataFrame:
    return volatility_features(bars(spark, sf_dir), target)


@query(f"WITH {BARS} SELECT date, {r('open', 'close', 'high', 'low')}, volume FROM bars")
def daily_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("date", "open", "close", "high", "low", "volume"))


@query(f"""WITH {BARS} SELECT date AS "Date", {r('close "TRDPRC_1"', 'open "OPEN_PRC"', 'high "HIGH_1"', 'low "LOW_1"')}, volume AS "ACVOL_UNS" FROM bars""")
def vendor_price_schema(spark, sf_dir):
    return rounded(files.vendor_prices(bars(spark, sf_dir)))


@query(f"WITH {RETURNS} SELECT date, {r('close', 'log_return')} FROM returns")
def log_returns_daily(spark, sf_dir):
    return rounded(log_returns(bars(spark, sf_dir)).select("date", "close", "log_return"))


@query(f"WITH {VOLATILITY} SELECT date, {r('abs_return', 'squared_return')} FROM features")
def abs_sq_returns(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("date", "abs_return", "squared_return"))


@query(f"WITH {VOLATILITY} SELECT date, {r('parkinson_vol', 'target_vol')} FROM features")
def parkinson_vol(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("date", "parkinson_vol", "target_vol"))


@query(f"WITH {VOLATILITY} SELECT date, {r('gk_vol', 'target_gk target_vol')} FROM features")
def garman_klass_vol(spark, sf_dir):
    return rounded(features(spark, sf_dir, "garman_klass").select("date", "gk_vol", "target_vol"))


@query(f"WITH {VOLATILITY} SELECT date, {r('target_next_vol')} FROM features")
def target_next_vol(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("date", "target_next_vol"))


@query(f"WITH {VOLATILITY} SELECT date, {r('volume_zscore_21')} FROM features")
def volume_zscore_21(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("date", "volume_zscore_21"))


SEGMENTS = """per_segment AS (
    SELECT c_mktsegment AS series_id, o_orderdate::DATE AS date, arg_max(o_totalprice, o_orderkey) AS close
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2)"""


@query(f"WITH {SEGMENTS} SELECT series_id, date, {r('ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) log_return')} FROM per_segment")
def log_returns_by_segment(spark, sf_dir):
    orders, customer = domain.table(spark, sf_dir, "orders"), domain.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.where(F.weekday("o_orderdate") < 5).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    many = joined.groupBy(F.col("c_mktsegment").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
    return rounded(log_returns(many).select("series_id", "date", "log_return"))


@query(f"WITH {VOLATILITY} SELECT date, {r('abs_return', 'log_return')} FROM features WHERE abs_return IS NOT NULL ORDER BY abs_return DESC, date LIMIT 20")
def top20_abs_return_days(spark, sf_dir):
    return rounded(checks.most_volatile_days(features(spark, sf_dir)).select("date", "abs_return", "log_return"))


@query(
    f"""WITH {RETURNS}, x AS (SELECT log_return AS v FROM returns WHERE log_return IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS t FROM x),
    c AS (SELECT least(floor((v - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY 1)
    SELECT b.bin, coalesce(c.n, 0)::BIGINT AS n, {r('coalesce(c.n, 0) / (t * ((hi - lo) / 60)) density')} FROM (SELECT unnest(range(60)) AS bin) b LEFT JOIN c ON b.bin = c.bin, e"""
)
def return_histogram_60(spark, sf_dir):
    return rounded(checks.data_histogram(log_returns(bars(spark, sf_dir)), "log_return", 60))


@query(f"""WITH {RETURNS} SELECT {r('avg(log_return) mu', 'stddev_pop(log_return) sigma')} FROM returns""")
def return_normal_fit(spark, sf_dir):
    return rounded(log_returns(bars(spark, sf_dir)).agg(F.avg("log_return").alias("mu"), F.stddev_pop("log_return").alias("sigma")))


MOMENTS = f"""{RETURNS}, x AS (SELECT log_return * 100 AS x FROM returns WHERE log_return IS NOT NULL),
  m AS (SELECT count(*)::BIGINT AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, skewness(x) AS skew, kurtosis(x) AS kurtosis FROM x),
  c AS (SELECT avg((x.x - m.mean) ** 2) AS m2, avg((x.x - m.mean) ** 3) AS m3, avg((x.x - m.mean) ** 4) AS m4 FROM x, m)"""


@query(f"WITH {MOMENTS} SELECT n, {r('mean', 'std', 'min', 'max', 'skew', 'kurtosis')} FROM m")
def descriptive_stats(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("pct", F.col("log_return") * 100)
    return rounded(stats.describe(x, "pct").drop("series_id", "jarque_bera", "jarque_bera_p"))


@query(f"WITH {MOMENTS} SELECT {r('n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) jarque_bera', 'exp(-(n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)) / 2) jarque_bera_p')} FROM m, c")
def jarque_bera(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("pct", F.col("log_return") * 100)
    return rounded(stats.describe(x, "pct").select("jarque_bera", "jarque_bera_p"))


def _ljung_sql(x: str) -> str:
    lags = " UNION ALL ".join(f"SELECT {k} AS k, sum(c * l{k}) AS s FROM lagged" for k in range(1, 11))
    return f"""WITH {RETURNS}, x AS (SELECT date, {x} AS x FROM returns WHERE log_return IS NOT NULL), m AS (SELECT avg(x) AS mean FROM x), d AS (SELECT date, x - mean AS c FROM x, m),
    lagged AS (SELECT c, {", ".join(f"lag(c, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 11))} FROM d),
    t AS (SELECT count(*) AS n, sum(c * c) AS v FROM d), a AS ({lags})
    SELECT lag::INTEGER AS lag, {r('n * (n + 2) * sum((s / v) ** 2 / (n - k)) q')} FROM a, t, (VALUES (5), (10)) AS g(lag) WHERE k <= lag GROUP BY lag, n"""


@query(_ljung_sql("log_return * 100"))
def ljung_box_returns(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("pct", F.col("log_return") * 100)
    return rounded(stats.ljung_box(x, "pct", p_value=False).drop("series_id"))


@query(_ljung_sql("(log_return * 100) ** 2"))
def ljung_box_squared_returns(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("sq", F.pow(F.col("log_return") * 100, F.lit(2)))
    return rounded(stats.ljung_box(x, "sq", p_value=False).drop("series_id"))


@query()
def ljung_box_p_values(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("pct", F.col("log_return") * 100)
    return stats.ljung_box(x, "pct")


def _chi2_even_sql(q: str, degrees: int) -> str:
    """Upper tail of chi-squared with an even number of degrees: a Poisson sum."""
    terms, factorial = [], 1
    for j in range(degrees // 2):
        factorial *= max(1, j)
        terms.append(f"pow({q} / 2, {j}) / {factorial}")
    return f"exp(-{q} / 2) * ({' + '.join(terms)})"


@query(f"WITH q10 AS ({_ljung_sql('log_return * 100')}) SELECT lag, {r(_chi2_even_sql('q', 10) + ' p')} FROM q10 WHERE lag = 10")
def ljung_box_p_value_lag10(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("pct", F.col("log_return") * 100)
    return rounded(stats.ljung_box(x, "pct", lags=(10,)).select("lag", "p"))


# Stand-in forecasts: yesterday's volatility and a five-day mean.
FORECASTS = f"""{VOLATILITY}, forecasts AS (
    SELECT date, target_next_vol AS actual, target_vol AS baseline, avg(target_vol) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hybrid, log_return AS sentiment
    FROM features WHERE target_vol > 0)"""
USABLE = "forecasts WHERE actual IS NOT NULL AND sentiment IS NOT NULL"


def forecasts(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir).where("target_vol > 0")
    mean = F.avg("target_vol").over(by_date().rowsBetween(-4, 0))
    out = f.select("series_id", "date", F.col("target_next_vol").alias("actual"), F.col("target_vol").alias("baseline"), mean.alias("hybrid"), F.col("log_return").alias("sentiment"))
    return out.where("actual is not null and sentiment is not null")


def _errors(p: str) -> list[str]:
    return [f"sqrt(avg((actual - {p}) ** 2)) {p}_rmse", f"avg(abs(actual - {p})) {p}_mae", f"avg(abs(actual - {p}) / greatest(abs(actual), 1e-8)) {p}_mape"]


@query(f"WITH {FORECASTS} SELECT count(*)::BIGINT AS n, {r(*_errors('baseline'), *_errors('hybrid'))} FROM {USABLE}")
def forecast_errors(spark, sf_dir):
    return rounded(residual.compare(forecasts(spark, sf_dir)).drop("series_id"))


@query(
    f"""WITH {FORECASTS}, f AS (SELECT * FROM {USABLE}), m AS (SELECT median(actual) AS m FROM f),
    l AS (SELECT f.*, unnest(list_filter(['year_' || year(date), CASE WHEN actual > m THEN 'shock_regime' ELSE 'calm_regime' END,
        CASE WHEN sentiment < -0.05 THEN 'negative_sentiment_days' END, CASE WHEN sentiment > 0.05 THEN 'positive_sentiment_days' END], lambda x: x IS NOT NULL)) AS segment FROM f, m)
    SELECT segment, count(*)::BIGINT AS size, {r('sqrt(avg((actual - baseline) ** 2)) baseline_rmse', 'sqrt(avg((actual - hybrid) ** 2)) hybrid_rmse', 'avg(abs(actual - baseline)) baseline_mae', 'avg(abs(actual - hybrid)) hybrid_mae')}
    FROM l GROUP BY segment"""
)
def subperiod_analysis(spark, sf_dir):
    return rounded(stats.subperiods(forecasts(spark, sf_dir)).drop("series_id"))


def _dm_sql(loss: str) -> str:
    d = f"{loss.replace('P', 'baseline')} - ({loss.replace('P', 'hybrid')})"
    return f"""WITH {FORECASTS}, f AS (SELECT date, {d} AS d FROM {USABLE}), m AS (SELECT avg(d) AS mean, var_pop(d) AS v0, count(*) AS n FROM f),
    g AS (SELECT avg(p) AS v1 FROM (SELECT (d - mean) * (lag(d) OVER (ORDER BY date) - mean) AS p FROM f, m))
    SELECT {r('CASE WHEN v0 + v1 > 0 THEN mean / sqrt((v0 + v1) / n) ELSE 0 END dm')} FROM m, g"""


@query(_dm_sql("(actual - P) ** 2"))
def diebold_mariano_square(spark, sf_dir):
    return rounded(stats.diebold_mariano(forecasts(spark, sf_dir), "square", p_value=False).select("dm"))


@query(_dm_sql("abs(actual - P)"))
def diebold_mariano_absolute(spark, sf_dir):
    return rounded(stats.diebold_mariano(forecasts(spark, sf_dir), "absolute", p_value=False).select("dm"))


@query(_dm_sql("(ln(P) + actual / greatest(P, 1e-8))"))
def diebold_mariano_qlike(spark, sf_dir):
    return rounded(stats.diebold_mariano(forecasts(spark, sf_dir), "qlike", p_value=False).select("dm"))


@query()
def diebold_mariano_p_value(spark, sf_dir):
    return stats.diebold_mariano(forecasts(spark, sf_dir), "square")


@query(
    # erfc by the series of erf whose terms are all positive.
    f"""WITH RECURSIVE found AS ({_dm_sql("(actual - P) ** 2")}), x AS (SELECT dm, abs(dm) / sqrt(2) AS x FROM found),
    s AS (SELECT 0 AS i, x AS term, x AS total FROM x UNION ALL SELECT i + 1, term * 2 * x.x * x.x / (2 * i + 3), total + term * 2 * x.x * x.x / (2 * i + 3) FROM s, x WHERE i < 400)
    SELECT dm, {r("CASE WHEN dm = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x.x * x.x) * max_total END p")} FROM x, (SELECT max(total) AS max_total FROM s)"""
)
def diebold_mariano_p(spark, sf_dir):
    return rounded(stats.diebold_mariano(forecasts(spark, sf_dir), "square").select("dm", "p"))


@query(
    f"""WITH {BARS}, n AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM bars)
    SELECT date, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM n"""
)
def temporal_split_rows(spark, sf_dir):
    return labels.split_by_rows(with_series(bars(spark, sf_dir))).select("date", "split")


@query(f"WITH {BARS} SELECT date, CASE WHEN date <= DATE '1996-12-31' THEN 'train' WHEN date <= DATE '1997-12-31' THEN 'val' ELSE 'test' END AS split FROM bars")
def split_by_dates(spark, sf_dir):
    return labels.split_by_dates(bars(spark, sf_dir), "1996-12-31", "1997-12-31").select("date", "split")


# Fixed parameters of the variance filters.
GARCH = {"c": 0.02, "phi": 0.05, "omega": 40.0, "alpha": 0.08, "beta": 0.9, "gamma": 0.0}


def _garch_sql(push: str = "0.0") -> str:
    o, a, b = GARCH["omega"], GARCH["alpha"], GARCH["beta"]
    return f"""WITH RECURSIVE {RETURNS}, y AS (
      SELECT date, log_return * 100 AS y, volume, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n, var_samp(log_return * 100) OVER () AS sample FROM returns WHERE log_return IS NOT NULL),
    e AS (SELECT *, y - {GARCH['c']}::DOUBLE - coalesce({GARCH['phi']}::DOUBLE * lag(y) OVER (ORDER BY i), 0) AS e, {push}::DOUBLE AS push FROM y),
    v AS (
      SELECT i, greatest(sample, {o}::DOUBLE / greatest(1e-6, 1 - {a}::DOUBLE - {b}::DOUBLE)) AS v, e, push FROM e WHERE i = 1
      UNION ALL SELECT e.i, {o}::DOUBLE + {a}::DOUBLE * v.e * v.e + v.push + {b}::DOUBLE * v.v, e.e, e.push FROM v JOIN e ON e.i = v.i + 1)
    SELECT e.date, round(sqrt(v.v), 4) + 0.0 AS conditional_vol,
      round(sqrt(CASE WHEN e.i < n THEN {o}::DOUBLE + {a}::DOUBLE * e.e * e.e + {b}::DOUBLE * v.v ELSE {o}::DOUBLE + ({a}::DOUBLE + {b}::DOUBLE) * v.v END + e.push), 4) + 0.0 AS forecast_vol, round(e.e / sqrt(v.v), 4) + 0.0 AS std_resid
    FROM e JOIN v ON e.i = v.i"""


def _filtered(df: DataFrame, parameters: dict, exog: str | None = None) -> DataFrame:
    f = garch.filter_series(df, parameters, exog=exog)
    return f.select("date", (F.sqrt("conditional_var") * 100).alias("conditional_vol"), (F.sqrt("forecast_var") * 100).alias("forecast_vol"), "std_resid")


@query(_garch_sql())
def garch_filter_fixed(spark, sf_dir):
    return rounded(_filtered(log_returns(bars(spark, sf_dir)), GARCH), 4)


@query(_garch_sql("0.5 * volume"))
def garchx_filter_fixed(spark, sf_dir):
    return rounded(_filtered(log_returns(bars(spark, sf_dir)).withColumn("x", F.col("volume").cast("double")), GARCH | {"gamma": 0.5}, "x"), 4)


@query(
    f"""WITH RECURSIVE {RETURNS}, y AS (SELECT log_return * 100 AS y, row_number() OVER (ORDER BY date) AS i, var_samp(log_return * 100) OVER () AS sample FROM returns WHERE log_return IS NOT NULL),
    points AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (0.02), (0.05), (0.08), (0.12)) AS x(a), (VALUES (0.8), (0.85), (0.9), (0.95)) AS z(b) WHERE a + b < 0.999),
    v AS (
      SELECT i, a, b, y, sample, sample AS v FROM y, points WHERE i = 1
      UNION ALL SELECT y.i, v.a, v.b, y.y, v.sample, v.sample * (1 - v.a - v.b) + v.a * v.y * v.y + v.b * v.v FROM v JOIN y ON y.i = v.i + 1),
    losses AS (SELECT a, b, sum(0.5::DOUBLE * (ln(2 * pi()) + ln(v) + y * y / v)) AS loss FROM v GROUP BY a, b)
    SELECT 'index' AS series_id, arg_min(a, loss) AS alpha, arg_min(b, loss) AS beta, round(min(loss), 3) + 0.0 AS loss FROM losses"""
)
def garch_grid_argmin(spark, sf_dir):
    points = garch.grid(log_returns(bars(spark, sf_dir)), [0.02, 0.05, 0.08, 0.12], [0.8, 0.85, 0.9, 0.95])
    return points.groupBy("series_id").agg(F.min_by(F.struct("alpha", "beta", "loss"), "loss").alias("b")).select("series_id", "b.alpha", "b.beta", (F.round("b.loss", 3) + F.lit(0.0)).alias("loss"))


def _segments(spark, sf_dir, *keys) -> DataFrame:
    """Log returns of the last order a day of each group of customers."""
    orders, customer = domain.table(spark, sf_dir, "orders"), domain.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = orders.where(F.weekday("o_orderdate") < 5).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    many = joined.groupBy(F.concat_ws("-", *keys).alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
    return log_returns(many)


@query(
    f"""WITH RECURSIVE p AS (
      SELECT c_mktsegment || '-' || c_nationkey AS series_id, o_orderdate::DATE AS date, arg_max(o_totalprice, o_orderkey) AS close
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2),
    q AS (SELECT series_id, date, 100 * ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS y FROM p),
    y AS (SELECT *, row_number() OVER s AS i, count(*) OVER (PARTITION BY series_id) AS n, coalesce(var_samp(y) OVER (PARTITION BY series_id), 0) AS sample FROM q WHERE y IS NOT NULL WINDOW s AS (PARTITION BY series_id ORDER BY date)),
    e AS (SELECT *, y - {GARCH['c']}::DOUBLE - coalesce({GARCH['phi']}::DOUBLE * lag(y) OVER (PARTITION BY series_id ORDER BY i), 0) AS e FROM y),
    v AS (
      SELECT series_id, i, greatest(sample, {GARCH['omega']}::DOUBLE / greatest(1e-6, 1 - {GARCH['alpha']}::DOUBLE - {GARCH['beta']}::DOUBLE)) AS v, e FROM e WHERE i = 1
      UNION ALL SELECT e.series_id, e.i, {GARCH['omega']}::DOUBLE + {GARCH['alpha']}::DOUBLE * v.e * v.e + {GARCH['beta']}::DOUBLE * v.v, e.e FROM v JOIN e ON e.series_id = v.series_id AND e.i = v.i + 1)
    SELECT e.series_id, e.date, round(sqrt(v.v), 4) + 0.0 AS conditional_vol,
      round(sqrt(CASE WHEN e.i < n THEN {GARCH['omega']}::DOUBLE + {GARCH['alpha']}::DOUBLE * e.e * e.e + {GARCH['beta']}::DOUBLE * v.v ELSE {GARCH['omega']}::DOUBLE + ({GARCH['alpha']}::DOUBLE + {GARCH['beta']}::DOUBLE) * v.v END), 4) + 0.0 AS forecast_vol, round(e.e / sqrt(v.v), 4) + 0.0 AS std_resid
    FROM e JOIN v ON e.series_id = v.series_id AND e.i = v.i"""
)
def garch_filter_series(spark, sf_dir):
    """A series for each segment and nation."""
    f = garch.filter_series(_segments(spark, sf_dir, "c_mktsegment", "c_nationkey"), GARCH)
    return rounded(f.select("series_id", "date", (F.sqrt("conditional_var") * 100).alias("conditional_vol"), (F.sqrt("forecast_var") * 100).alias("forecast_vol"), "std_resid"), 4)


@query()
def garch_fit_segments(spark, sf_dir):
    """A fit for each segment."""
    return garch.fit_series(_segments(spark, sf_dir, "c_mktsegment"))


@query(
    f"""WITH vol AS ({_garch_sql()}), {VOLATILITY.removeprefix('WITH ')}
    SELECT f.date, {r('f.target_next_vol target_next_vol')}, conditional_vol AS garch_conditional_vol, forecast_vol AS garch_forecast_vol, std_resid AS garch_std_resid
    FROM features f LEFT JOIN vol ON vol.date = f.date"""
)
def garch_features_fixed(spark, sf_dir):
    """The garch columns of the frame (volatilities in per cent), for given parameters."""
    frame = features(spark, sf_dir)
    given = frame.select("series_id").distinct().select("series_id", *[F.lit(v).alias(n) for n, v in GARCH.items()])
    full = garch.add_features(frame, "9999-12-31", parameters=given)
    cents = [F.round(F.col(c) * k, 4).alias(c) for c, k in (("garch_conditional_vol", 100), ("garch_forecast_vol", 100), ("garch_std_resid", 1))]
    return rounded(full.select("date", "target_next_vol", *cents))


@query()
def garch_fit(spark, sf_dir):
    return garch.fit_series(log_returns(bars(spark, sf_dir)))


@query()
def garchx_fit(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir)).withColumn("x", F.lag("volume").over(by_date()).cast("double"))
    return garch.fit_series(x, exog="x")


@query()
def garch_diagnostics(spark, sf_dir):
    x = log_returns(bars(spark, sf_dir))
    fitted = garch.fit_series(x)
    return garch.validate(garch.filter_fitted(x, fitted), fitted)


@query()
def expanding_garch(spark, sf_dir):
    return garch.expanding(log_returns(bars(spark, sf_dir)), train_rows=1200)


@query()
def garch_features(spark, sf_dir):
    return garch.add_features(features(spark, sf_dir), "1996-12-31").drop("open", "high", "low")


@query(
    f"""WITH {VOLATILITY}, x AS (SELECT date, abs_return, target_vol, row_number() OVER (ORDER BY date) AS i FROM features WHERE abs_return IS NOT NULL AND target_vol IS NOT NULL)
    SELECT a.date, count(*)::BIGINT AS steps, {r('sum(b.abs_return) sum_abs', 'sum(b.target_vol) sum_vol', 'arg_min(b.target_vol, b.i) first_vol')} FROM x a JOIN x b ON b.i BETWEEN a.i - 14 AND a.i WHERE a.i >= 15 GROUP BY a.date"""
)
def rolling_sequences(spark, sf_dir):
    w = residual.sequences(features(spark, sf_dir), ["abs_return", "target_vol"], 15)
    total = lambda k: F.aggregate(F.transform("window", lambda row: row[k]), F.lit(0.0), lambda a, x: a + x)
    return rounded(w.select("date", F.size("window").cast("long").alias("steps"), total(0).alias("sum_abs"), total(1).alias("sum_vol"), F.col("window")[0][1].alias("first_vol")))


@query(f"WITH {VOLATILITY} SELECT year(date)::BIGINT AS year, count(*)::BIGINT AS sessions, {r('avg(target_vol) mean_vol', 'stddev_samp(target_vol) std_vol')} FROM features GROUP BY 1")
def volatility_clustering(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("sessions"), F.avg("target_vol").alias("mean_vol"), F.stddev_samp("target_vol").alias("std_vol")))
