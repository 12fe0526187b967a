"""Reports and validation of scores, counts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.operators.sentiment import daily_sentiment
from volatide.schemas import LABELS, SCORES, require_columns

DOMINANT = 0.70
MIN_ROWS = 50


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = value_counts(df, column)
    return counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select(column, (F.col("n") / F.col("t")).alias("share"))  # one row on the right


def top_categories(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """A top-k report; ties by name."""
    return value_counts(df, column).orderBy(F.col("n").desc(), column).limit(n)


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts with a column for each of `values`; zero where there is none."""
    return df.groupBy(rows).agg(*[F.sum((F.col(columns) == v).cast("long")).alias(f"n_{v}") for v in values])


def label_shares(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Counts and row-wise shares of the labels, and the dominant one if it passes 70 %."""
    n = {label: F.sum((F.col("sentiment_label") == label).cast("long")) for label in LABELS}
    out = df.groupBy(by.alias(name)).agg(*[c.alias(f"n_{label}") for label, c in n.items()])
    total = F.nullif(sum((F.col(f"n_{label}") for label in LABELS[1:]), F.col(f"n_{LABELS[0]}")), F.lit(0).cast("long"))
    out = out.withColumns({f"{label}_share": F.coalesce(F.col(f"n_{label}") / total, F.lit(0.0)) for label in LABELS})
    dominant = F.lit(None).cast("string")
    for label in LABELS:
        dominant = F.when(F.col(f"{label}_share") > DOMINANT, label).otherwise(dominant)
    return out.withColumn("dominant_label", dominant)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for all bins; the last includes its upper edge, values outside are dropped."""
    x = F.col(column)
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    counted = df.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").fillna({"n": 0})


def data_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n, density) over the data's range."""
    x = df.where(F.col(column).isNotNull())
    edges = x.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("t"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    counted = x.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of edges
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    out = every.join(counted, "bin", "left").fillna({"n": 0}).crossJoin(F.broadcast(edges))
    return out.select("bin", "n", (F.col("n") / (F.col("t") * width)).alias("density"))


def threshold_shares(df: DataFrame, column: str = "sentiment_score", threshold: float = 0.05) -> DataFrame:
    x = F.col(column)
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(share(x > threshold).alias("positive_share"), share(x < -threshold).alias("negative_share"), share(x.between(-threshold, threshold)).alias("neutral_share"))


def daily_validation(daily: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return daily.agg(F.count("*").alias("daily_rows"), count(F.col("n_articles") == 0).alias("zero_news_days"), count(F.col("n_articles") == 1).alias("one_article_days"))


def most_volatile_days(returns: DataFrame, n: int = 20) -> DataFrame:
    """A top-k report of |return|; ties by date."""
    return returns.where(F.col("abs_return").isNotNull()).orderBy(F.col("abs_return").desc(), "date").limit(n)


def volatility_check(returns: DataFrame, scores: DataFrame, n: int = 20) -> DataFrame:
    """Mean negative share on the most volatile days against all days with news."""
    daily = daily_sentiment(scores).select("date", "negative_share")
    top = most_volatile_days(returns, n).select("date").join(daily, "date", "left").agg(F.coalesce(F.avg(F.coalesce("negative_share", F.lit(0.0))), F.lit(0.0)).alias("top_negative"))
    everything = daily.agg(F.coalesce(F.avg("negative_share"), F.lit(0.0)).alias("corpus_negative"))
    return everything.crossJoin(top).withColumn("passed", F.col("top_negative") > F.col("corpus_negative"))  # one row each


def inference_validation(articles: DataFrame, scores: DataFrame, more_negative: str, less_negative: str, returns: DataFrame | None = None) -> DataFrame:
    """One row of the gates and `ready_for_modeling`."""
    require_columns(scores, SCORES, "Sentiment output")
    total = sum((F.col(f"prob_{x}") for x in LABELS[1:]), F.col(f"prob_{LABELS[0]}"))
    negative = lambda name: F.avg(F.when(F.col("category") == name, (F.col("sentiment_label") == "negative").cast("double")))
    base = scores.agg(
        F.count("*").alias("sentiment_rows"), F.max(F.abs(total - 1)).alias("probability_error"), negative(more_negative).alias("high"), negative(less_negative).alias("low")
    )
    repeated = scores.groupBy("url").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_urls"))
    years = label_shares(scores, F.year("trading_date"), "year").agg(F.count("dominant_label").alias("dominant_years"))
    out = articles.agg(F.count("*").alias("articles_rows")).crossJoin(base).crossJoin(repeated).crossJoin(years)  # one row each
    large = F.col("sentiment_rows") >= MIN_ROWS
    out = out.withColumns(
        {
            "row_count_match": F.col("articles_rows") == F.col("sentiment_rows"),
            "no_duplicate_urls": F.col("duplicate_urls") == 0,
            "probabilities_sum_to_one": F.coalesce(F.col("probability_error") < 1e-5, F.lit(True)),
            "no_dominant_year": ~large | (F.col("dominant_years") == 0),
            "category_check": ~large | F.coalesce(F.col("high") > F.col("low"), F.lit(False)),
        }
    )
    out = out.crossJoin(volatility_check(returns, scores).select(F.col("passed").alias("volatility_check"))) if returns is not None else out.withColumn("volatility_check", F.lit(True))
    gates = ["row_count_match", "no_duplicate_urls", "probabilities_sum_to_one", "no_dominant_year", "category_check", "volatility_check"]
    ready = F.col(gates[0])
    for g in gates[1:]:
        ready = ready & F.col(g)
    return out.withColumn("ready_for_modeling", ready).drop("high", "low")


def raise_for_failed(validation: DataFrame) -> None:
    row = validation.first().asDict()
    failed = [k for k, v in row.items() if v is False and k != "ready_for_modeling"]
    if failed:
        raise RuntimeError(f"Validation failed: {', '.join(failed)}")
