"""The same alignment over a stream of articles, resumable by its checkpoint (an extension: the batch forms come first)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.operators.alignment import CLOSE, align, with_next_sessions


def article_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_articles(stream: DataFrame, key: str = "url", at: str = "published_at", late: str = "7 days") -> DataFrame:
    """Each url once within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def align_stream(stream: DataFrame, sessions: DataFrame, timestamp: str = "published_at", close: str = CLOSE) -> DataFrame:
    """Stream-static join with the session map (a row a day): late news goes to the next session."""
    joined = with_next_sessions(stream.withColumn("origin_date", F.col(timestamp).cast("date")), sessions, "origin_date")
    late = F.coalesce(F.col("is_session") & (F.date_format(timestamp, "HH:mm:ss.SSSSSS") > f"{close}.000000"), F.lit(False))
    reason = F.when(late, "after_close_forward").when(F.coalesce("is_session", F.lit(False)), "same_session").otherwise("non_trading_forward")
    return joined.withColumns({"trading_date": F.when(late, F.col("next_gt")).otherwise(F.col("next_ge")), "alignment_reason": reason}).drop("is_session", "next_ge", "next_gt")


def windowed_counts(stream: DataFrame, at: str = "published_at", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Articles a window and category; windows close when the watermark passes them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), "category").agg(F.count("*").alias("n_articles"))


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived since the checkpoint, append it as Parquet, and stop."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def score_available(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Score each micro-batch; a batch that ran before is overwritten under its number, so a restart repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def daily_news_stream(articles: DataFrame, sessions: DataFrame, body: str = "body_clean") -> DataFrame:
    """News controls of the trading days that a micro-batch touches, over all articles so far (update mode).

    State is a row a trading day. Days and reasons are those of the batch alignment, also for articles that only have a date.
    """
    aligned = align(articles, sessions).where("trading_date is not null")
    off = F.col("alignment_reason").isin("non_trading_forward", "date_only_forward")
    sums = aligned.groupBy(F.col("trading_date").alias("date")).agg(
        F.count("*").alias("n_articles"),
        F.size(F.collect_set("category")).cast("long").alias("n_categories"),
        F.sum(F.length(body)).alias("chars"),
        F.count(body).alias("bodies"),
        F.sum("is_after_close").alias("after_close"),
        F.sum(off.cast("int")).alias("off"),
        F.max("calendar_gap_days").alias("max_calendar_gap_days"),
    )
    share = lambda part, whole: F.col(part) / F.when(F.col(whole) > 0, F.col(whole))
    return sums.select("date", "n_articles", "n_categories", share("chars", "bodies").alias("mean_body_len"), share("after_close", "n_articles").alias("after_close_share"), share("off", "n_articles").alias("non_trading_share"), "max_calendar_gap_days")


def upsert_days(daily: DataFrame, table: str, checkpoint: str) -> None:
    """Replace the touched days in a table that is partitioned by date; a micro-batch that runs again replaces the same days by the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        batch.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(table)

    daily.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
