"""Returns, range volatilities and targets from daily bars.

Windows are partitioned by series, so many symbols spread over the cluster; one symbol has a row a day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volatide.schemas import PRICE_NAMES, PRICES, require_columns


def with_series(df: DataFrame) -> DataFrame:
    return df if "series_id" in df.columns else df.withColumn("series_id", F.lit("index"))


def by_date() -> Window:
    return Window.partitionBy("series_id").orderBy("date")


def canonical_prices(df: DataFrame) -> DataFrame:
    out = df.withColumnsRenamed({k: v for k, v in PRICE_NAMES.items() if k in df.columns})
    return require_columns(out, PRICES, "Price data").withColumn("date", F.col("date").cast("date"))


def _log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless it is finite."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def log_returns(df: DataFrame) -> DataFrame:
    df = with_series(df)
    r = F.when((F.col("close") > 0) & (F.lag("close").over(by_date()) > 0), F.log(F.col("close") / F.lag("close").over(by_date())))
    return df.withColumn("log_return", r)


def zscore(value: Column, rows: int, window: Window) -> Column:
    """Null until `rows` values that aren't null."""
    last = window.rowsBetween(1 - rows, 0)
    full = F.count(value).over(last) == rows
    return F.when(full, (value - F.avg(value).over(last)) / F.nullif(F.stddev_samp(value).over(last), F.lit(0.0)))


def volatility_features(prices: DataFrame, target: str = "parkinson") -> DataFrame:
    if target not in ("parkinson", "garman_klass"):
        raise ValueError(f"Unknown target_type: {target}")
    df = log_returns(canonical_prices(prices))
    span, body = _log_ratio(F.col("high"), F.col("low")), _log_ratio(F.col("close"), F.col("open"))
    inner = 0.5 * F.pow(span, F.lit(2)) - (2 * math.log(2) - 1) * F.pow(body, F.lit(2))
    df = df.withColumns(
        {
            "abs_return": F.abs("log_return"),
            "squared_return": F.pow("log_return", F.lit(2)),
            "parkinson_vol": F.sqrt(F.pow(span, F.lit(2)) / (4 * math.log(2))),
            # greatest() would skip a null
            "gk_vol": F.when(inner.isNotNull(), F.sqrt(F.greatest(inner, F.lit(0.0)))),
        }
    )
    df = df.withColumn("target_vol", F.coalesce("parkinson_vol" if target == "parkinson" else "gk_vol", "abs_return"))
    df = df.withColumn("target_next_vol", F.lead("target_vol").over(by_date()))
    return df.withColumn("volume_zscore_21", zscore(F.col("volume").cast("double"), 21, by_date()))
