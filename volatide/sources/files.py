"""Readers and sinks. Readers declare schemas, so no pass over the data infers them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.operators.volatility import canonical_prices, log_returns
from volatide.schemas import RAW_NEWS, VENDOR_PRICES, conform, strings


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or CSV by suffix."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path.rstrip("/"))[1]
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"Unsupported table format: {kind or path}")


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"Expected a parquet file: {path}")
    return read_table(spark, path)


def read_raw_news(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, empty rather than null; without published_at it is added empty."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "")
    df = reader.csv(path)
    return conform(df, RAW_NEWS).fillna("")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Canonical daily bars with log returns; vendor names are understood."""
    df = spark.read.option("header", True).csv(path)
    typed = canonical_prices(df)
    numbers = {c: F.col(c).try_cast("double") for c in ("close", "open", "high", "low")} | {"volume": F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).cast("long")}
    return log_returns(typed.withColumns(numbers))


def repair_news_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows under seven columns, counts): rows of six columns get an empty published_at; others keep what fits."""
    wide = strings([f"c{i}" for i in range(8)])
    lines = spark.read.option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "\x00").option("emptyValue", "").schema(wide).csv(path)
    filled = F.array_size(F.filter(F.array(*[F.col(f"c{i}") for i in range(8)]), lambda x: x.isNotNull()))
    rows = lines.withColumn("n", filled).where(F.col("c0") != RAW_NEWS[0])
    old = F.col("n") == 6
    picked = [F.coalesce(F.when(old, None if i == 5 else F.col(f"c{i - (i > 5)}")).otherwise(F.col(f"c{i}")) if i != 5 else F.when(~old, F.col("c5")), F.lit("")).alias(name) for i, name in enumerate(RAW_NEWS)]
    counts = rows.agg(F.count("*").alias("total_rows"), F.sum(old.cast("long")).alias("padded_rows"), F.sum((F.col("n") == 7).cast("long")).alias("correct_rows"), F.sum((~F.col("n").isin(6, 7)).cast("long")).alias("odd_rows"))
    return rows.select(*picked), counts


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of parts, each with its header; appending needs no bookkeeping."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(report: DataFrame, path: str) -> dict:
    """A one-row frame as indented JSON in one text part."""
    row = report.limit(1).toJSON().collect()
    parsed = json.loads(row[0]) if row else {}
    report.sparkSession.createDataFrame([(json.dumps(parsed, indent=2, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return parsed


def vendor_prices(df: DataFrame) -> DataFrame:
    """Canonical bars under the vendor's names; volume without value is 0."""
    names = dict(zip(["date", "close", "open", "high", "low", "volume"], VENDOR_PRICES, strict=True))
    return df.select(*[F.col(c).alias(n) if c != "volume" else F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("long").alias(n) for c, n in names.items()])


def flatten_metrics(report: dict, prefix: str = "") -> dict[str, float]:
    """Nested numbers under dotted names; booleans are 0 or 1, anything else is left out."""
    out: dict[str, float] = {}
    for key, value in report.items():
        name = f"{prefix}{''.join(c if c.isalnum() or c in '_-./ ' else '_' for c in str(key))}"
        if isinstance(value, dict):
            out |= flatten_metrics(value, f"{name}.")
        elif isinstance(value, (bool, int, float)):
            out[name] = float(value)
    return out
