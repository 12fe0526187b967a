"""The star-schema tables seen as prices, news, scores, corpora and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of weekdays as daily bars."""
    orders = table(spark, sf_dir, "orders").where(F.weekday("o_orderdate") < 5)
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.count("*").alias("volume"),
    )


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timestamped articles; errors have a date only."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.col("event_id").cast("string").alias("url"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type") != "error", ts).alias("published_at"),
        ts.cast("date").alias("date"),
        F.coalesce("props", F.lit("")).alias("body_clean"),
        "user_id",
        "value",
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays with events, but for a holiday."""
    day = F.col("ts").cast("date")
    days = table(spark, sf_dir, "events").select(day.alias("date")).distinct()
    return days.where((F.weekday("date") < 5) & ~F.col("date").between(F.lit("2024-01-16").cast("date"), F.lit("2024-01-18").cast("date")))


def line_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as date-only articles."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"),
        F.col("l_linestatus").alias("source"),
        F.col("l_returnflag").alias("category"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.lit("").alias("body_clean"),
        "l_discount",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored articles: three probabilities from the discount."""
    a = line_articles(spark, sf_dir).withColumn("s", F.round(F.col("l_discount") * 20 - 1, 6))
    rest = (1 - 0.9 * F.abs("s")) / 3
    a = a.withColumns(
        {
            "prob_positive": rest + F.when(F.col("s") > 0, 0.9 * F.col("s")).otherwise(0.0),
            "prob_negative": rest + F.when(F.col("s") < 0, -0.9 * F.col("s")).otherwise(0.0),
            "prob_neutral": rest,
        }
    )
    score = F.round(F.col("prob_positive") - F.col("prob_negative"), 9)
    label = F.when((F.col("prob_positive") > F.col("prob_negative")) & (F.col("prob_positive") > F.col("prob_neutral")), "positive")
    label = label.when((F.col("prob_negative") > F.col("prob_positive")) & (F.col("prob_negative") > F.col("prob_neutral")), "negative").otherwise("neutral")
    return a.select("url", F.col("date").alias("trading_date"), "category", score.alias("sentiment_score"), label.alias("sentiment_label"), "prob_positive", "prob_negative", "prob_neutral", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a news corpus."""
    d = table(spark, sf_dir, "documents")
    start = F.lit("1995-01-02").cast("date")
    day = F.date_add(start, F.pmod("doc_id", F.lit(2400)).cast("int"))
    minutes = F.pmod(F.col("doc_id") * 37, F.lit(1440)).cast("int")
    at = F.concat(day.cast("string"), F.lit(" "), F.lpad(F.expr("cast(pmod(doc_id * 37, 1440) div 60 as string)"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(":00"))
    return d.select(
        F.col("doc_id").cast("string").alias("article_id"),
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("category"),
        at.alias("published_at"),
        F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"),
        F.coalesce("text", F.lit("")).alias("body_text"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return lab.select(F.col("doc_id").cast("string").alias("article_id"), "doc_id", label.alias("label"), (0.5 + (F.col("doc_id") % 50) / 100).alias("confidence"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(spark, sf_dir).where("doc_id % 10 = 0").select("article_id", F.lit("positive").alias("label"), F.lit(1.0).alias("confidence"))
