"""Joining articles with scores, deduplication with explicit order, and key reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("url", "trading_date")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, found by a mergeable aggregate: partial before the shuffle, no window."""
    names = df.columns
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = F.struct(*[F.col(f"`{c}`") for c in names])
    # The keys are the group's own, so that what comes after knows how rows are dealt.
    kept = df.groupBy(*keys).agg(F.min_by(rest, ranked).alias("__kept"))
    return kept.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__kept.`{c}`").alias(c) for c in names])


def title_dedupe(df: DataFrame, source_order: list[str]) -> DataFrame:
    """First row of each title hash, sources in the given order, then by url."""
    from volatide.functions.text import title_hash

    hashed = df.withColumn("title_hash", title_hash(F.col("title"), F.col("date")))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source")), F.lit(0).cast("long"))
    rank = F.when(rank == 0, len(source_order) + 1).otherwise(rank)
    return keep_one(hashed, ["title_hash"], [rank, F.col("url")])


def merge_scores(articles: DataFrame, scores: DataFrame, how: str = "left", first: list[Column] | None = None, last: list[Column] | None = None) -> DataFrame:
    """Articles (first a key) with scores (last a key); overlapping score columns get the suffix _sentiment."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how!r}")
    keys = list(KEYS)
    if first is not None:
        articles = keep_one(articles, keys, first)
    if last is not None:
        scores = keep_one(scores, keys, last)
    scores = scores.withColumnsRenamed({c: f"{c}_sentiment" for c in scores.columns if c in articles.columns and c not in keys})
    return articles.join(scores, keys, how)


def reconcile_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(merge, n): distinct keys in both, left_only, right_only. One aggregation over the union, no outer join."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    kind = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return seen.groupBy(kind.alias("merge")).agg(F.count("*").alias("n"))


def not_done(urls: DataFrame, ledger: DataFrame, states: tuple[str, ...] = ("completed",)) -> DataFrame:
    """Urls that the ledger (url, status) doesn't list as done."""
    return urls.join(ledger.where(F.col("status").isin(*states)).select("url"), "url", "left_anti")


#: Buckets of tables whose keys are joined again and again.
BUCKETS = 64


def write_bucketed(df: DataFrame, table: str, path: str | None = None, keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS) -> DataFrame:
    """Save the frame as a table that is dealt into buckets by its keys and sorted in them; gives the table.

    Deduplication, merging and reconciliation of two such tables with the same number of buckets shuffle nothing.
    """
    writer = df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def reconcile_bucketed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`reconcile_keys` of bucketed tables: an outer join of the distinct keys inside buckets; only counts are shuffled."""
    sides = [df.select(*keys).distinct().withColumn(name, F.lit(1)) for df, name in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], keys, "full")
    kind = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    return both.groupBy(kind.alias("merge")).agg(F.count("*").alias("n"))
