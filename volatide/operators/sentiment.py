"""Article scores to daily sentiment, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volatide.schemas import LABELS, MACRO_CATEGORIES, MARKET_CATEGORIES

DEFAULT_THRESHOLD = 0.05


def threshold_label(score, threshold: float):
    return F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")


def daily_sentiment(
    scores: DataFrame,
    articles: DataFrame | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    macro: tuple[str, ...] = MACRO_CATEGORIES,
    market: tuple[str, ...] = MARKET_CATEGORIES,
) -> DataFrame:
    """Daily features; a frame that is daily already passes through with its date column cast.

    Labels are recomputed from scores only where they are absent or the threshold isn't the default. Categories come
    from the scores, else from `articles` by url, else macro and market sentiment are null.
    """
    source = "trading_date" if "trading_date" in scores.columns else "date"
    if "sentiment_score" not in scores.columns:
        if "mean_sentiment" not in scores.columns:
            raise ValueError("Sentiment frame is neither article level nor daily.")
        return scores.withColumn("date", F.col(source).cast("date")).drop(*({source} - {"date"}))
    df = scores.withColumns({"date": F.col(source).cast("date"), "sentiment_score": F.col("sentiment_score").try_cast("double")})
    df = df.where(F.col("date").isNotNull() & F.col("sentiment_score").isNotNull() & ~F.isnan("sentiment_score"))
    if "sentiment_label" not in df.columns or threshold != DEFAULT_THRESHOLD:
        df = df.withColumn("sentiment_label", threshold_label(F.col("sentiment_score"), threshold))
    if "category" not in df.columns:
        if articles is not None:
            df = df.join(articles.select("url", "category").dropDuplicates(["url"]), "url", "left")
        else:
            df = df.withColumn("category", F.lit(None).cast("string"))
    score = F.col("sentiment_score")
    count = lambda label: F.sum((F.col("sentiment_label") == label).cast("double"))
    labelled = F.sum(F.col("sentiment_label").isin(*LABELS).cast("double"))
    daily = df.groupBy("date").agg(
        F.avg(score).alias("mean_sentiment"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sentiment_std"),
        F.count("*").alias("sentiment_volume"),
        *[(count(label) / F.nullif(labelled, F.lit(0.0))).alias(f"{label}_share") for label in LABELS],
        F.avg(F.when(F.col("category").isin(*macro), score)).alias("macro_sentiment"),
        F.avg(F.when(F.col("category").isin(*market), score)).alias("market_sentiment"),
    )
    # A row a day that has news; the five rows before it, not calendar days.
    prior = F.avg("mean_sentiment").over(Window.orderBy("date").rowsBetween(-5, -1))
    return daily.withColumns(
        {
            "net_sentiment": F.col("positive_share") - F.col("negative_share"),
            "sentiment_surprise": F.col("mean_sentiment") - F.coalesce(prior, F.lit(0.0)),
            "macro_sentiment_missing": F.col("macro_sentiment").isNull().cast("int"),
            "market_sentiment_missing": F.col("market_sentiment").isNull().cast("int"),
        }
    )


def lagged_sentiment(daily: DataFrame) -> DataFrame:
    return daily.withColumn("lag_mean_sentiment", F.coalesce(F.lag("mean_sentiment").over(Window.orderBy("date")), F.lit(0.0)))
