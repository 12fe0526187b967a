"""Model inputs and training corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.functions import text as X
from volatide.functions.dates import published_text
from volatide.schemas import LABELED, TRAINING, require_columns, require_unique


def prepare_inputs(df: DataFrame, max_body_chars: int = 300, min_tokens: int = 5, max_tokens: int = 220) -> DataFrame:
    """Title and lead as one text, with its token count; rows outside the token range go."""
    lead = X.body_lead(F.col("body_text"), max_body_chars)
    out = df.withColumn("body_lead", lead).withColumn("input_text", X.input_text(F.col("title"), F.col("body_lead")))
    out = out.withColumn("token_count", X.count_tokens(F.col("input_text")))
    return out.where(F.col("token_count").between(min_tokens, max_tokens))


def token_stats(df: DataFrame, column: str = "token_count") -> DataFrame:
    """One row; zeros when there are no values."""
    c = F.col(column).try_cast("double")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.agg(F.count(c).alias("count"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"), zero(F.avg(c)).alias("mean"), zero(F.percentile(c, F.lit(0.95))).alias("p95"))


def input_report(raw: DataFrame, prepared: DataFrame) -> DataFrame:
    stats = token_stats(prepared)
    report = raw.agg(F.count("*").alias("raw_rows")).crossJoin(stats)  # one row each
    return report.withColumns({"prepared_rows": F.col("count"), "dropped_rows": F.col("raw_rows") - F.col("count"), "p95_under_200": F.col("p95") < 200})


def training_rows(df: DataFrame, source: str, url: str, category: str, published: str, title: str, body: str, max_date: str | None = None) -> DataFrame:
    """A source's columns under the corpus names; with `max_date`, only rows dated up to its midnight."""
    require_columns(df, [url, category, published, title, body], f"{source} training corpus")
    if max_date is not None:
        df = df.where(F.try_to_timestamp(F.col(published).cast("string")) <= F.lit(max_date).cast("timestamp"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(
        F.col(url).cast("string").alias("article_id"),
        F.lit(source).alias("source"),
        F.lit(source).alias("source_dataset"),
        blank(category).alias("category"),
        F.col(published).cast("string").alias("published_at"),
        blank(title).alias("title"),
        blank(body).alias("body_text"),
    )


def training_corpus(parts: list[DataFrame], max_body_chars: int = 1200, check: bool = True) -> DataFrame:
    """Union by name, normalised; duplicate ids are an error."""
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    require_columns(df, [c for c in TRAINING if c != "input_text"], "training input")
    if check:
        require_unique(df, ["article_id"], "Combined training corpus")
    out = df.withColumns(
        {
            **{c: X.normalize(F.col(c)) for c in ("source", "category", "title", *(["source_dataset"] if "source_dataset" in df.columns else []))},
            "published_at": published_text(F.col("published_at")),
            "body_text": X.body_slice(F.col("body_text"), max_body_chars),
        }
    )
    out = out.withColumn("input_text", X.input_text(F.col("title"), F.col("body_text")))
    names = LABELED if {"label", "split"} <= set(out.columns) else TRAINING
    return out.select(*names, *[c for c in out.columns if c not in names])
