"""Ticker news of several providers under one contract, with fallback from one provider to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.functions.dates import split_date_fields
from volatide.functions.text import first_present
from volatide.schemas import RAW_NEWS

# Candidate columns of each part, in order.
URL = ("url", "news_source_link", "newsSourceLink", "source_url", "link")
CANDIDATES = {
    "VCI": {
        "title": ("news_title", "newsTitle", "title", "headline"),
        "body": ("content", "news_full_content", "newsFullContent", "news_short_content", "newsShortContent", "description"),
        "date": ("published_at", "public_date", "publicDate", "publish_date", "publishDate", "date"),
        "id": ("news_id", "newsId", "id"),
    },
    "KBS": {
        "title": ("head", "title", "news_title", "headline"),
        "body": ("content", "description", "title"),
        "date": ("publish_time", "date", "publish_date", "publishDate"),
        "id": ("id", "news_id", "newsId"),
    },
    "": {
        "title": ("title", "news_title", "newsTitle", "head", "headline"),
        "body": ("content", "description", "body", "news_full_content", "newsFullContent"),
        "date": ("published_at", "publish_time", "public_date", "publicDate", "publish_date", "publishDate", "date"),
        "id": ("id", "news_id", "newsId"),
    },
}


def _pick(df: DataFrame, names: tuple[str, ...]) -> Column:
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    return first_present(*there) if there else F.lit("")


def normalize_rows(df: DataFrame, provider: str, row_number: str = "row_number", symbol: str = "symbol") -> DataFrame:
    """Articles of a provider's rows; rows without title or date go, a missing body is the title, a missing url is made."""
    rules = CANDIDATES.get(provider.upper(), CANDIDATES[""])
    picked = df.withColumns({"__title": _pick(df, rules["title"]), "__body": _pick(df, rules["body"]), "__raw": _pick(df, rules["date"]), "__url": _pick(df, URL), "__id": _pick(df, rules["id"])})
    date, published = split_date_fields(F.col("__raw"))
    number = F.col(row_number).cast("string") if row_number in df.columns else F.lit("0")
    made = F.concat(F.lit(f"vnstock://{provider.lower()}/"), F.col(symbol), F.lit("/"), F.coalesce(F.nullif(F.col("__id"), F.lit("")), number))
    out = picked.where((F.col("__title") != "") & (F.col("__raw") != ""))
    return out.select(
        F.coalesce(F.nullif(F.col("__url"), F.lit("")), made).alias("url"),
        F.lit("vnstock").alias("source"),
        F.concat(F.lit("Ticker:"), F.col(symbol)).alias("category"),
        F.col("__title").alias("title"),
        date.alias("date"),
        published.alias("published_at"),
        F.coalesce(F.nullif(F.col("__body"), F.lit("")), F.col("__title")).alias("body"),
        F.col(symbol).alias("symbol"),
    )


def with_fallback(parts: list[DataFrame], symbol: str = "symbol") -> DataFrame:
    """All rows of the first provider that has any for a symbol."""
    tagged = parts[0].withColumn("__p", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        tagged = tagged.unionByName(part.withColumn("__p", F.lit(i)), allowMissingColumns=True)
    best = tagged.groupBy(symbol).agg(F.min("__p").alias("__best"))
    return tagged.join(best, symbol).where(F.col("__p") == F.col("__best")).drop("__p", "__best")


def paginate(rows: DataFrame, page_size: int, max_pages: int, order: list[str], symbol: str = "symbol") -> DataFrame:
    """A provider serves at most max_pages pages of a symbol; add `capped` where there were more."""
    from pyspark.sql import Window

    limit = page_size * max_pages
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(symbol).orderBy(*order))).where(F.col("__n") <= limit + 1)
    capped = F.max((F.col("__n") > limit).cast("int")).over(Window.partitionBy(symbol)) == 1
    return ranked.withColumn("capped", capped).where(F.col("__n") <= limit).drop("__n")


def source_stats(articles: DataFrame) -> DataFrame:
    """Counters a source."""
    return articles.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.sum((~F.col("url").startswith("vnstock://")).cast("long")).alias("rows_with_real_urls"),
        F.sum((F.col("published_at") != "").cast("long")).alias("rows_with_published_at"),
        F.sum((F.col("body") == F.col("title")).cast("long")).alias("title_body_fallbacks"),
    )


def combine_sources(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of sources, one row a title and date, the first source going first."""
    from volatide.operators.reconcile import title_dedupe

    df = parts[0].select(*RAW_NEWS)
    for part in parts[1:]:
        df = df.unionByName(part.select(*RAW_NEWS))
    return title_dedupe(df, order)
