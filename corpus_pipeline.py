"""A training-corpus pipeline over `documents`; each stage applies one operator to all rows its predecessor kept.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays (five-word
shingles, similarity 0.8). pii: confirmed spans are replaced by their kind. mixing: documents are repeated or left out
so that sources meet their target weights. byte_bpe: texts become token ids, which are decoded and compared.
All stages but the last return the columns of documents, whatever other columns there are and whatever their names. A
document is its id and text: of rows that share both, one stays (by a hash of all its columns); rows that share an id
but not a text are documents of their own; null ids count as equal. Null texts are scored and kept or dropped as
empty ones; empty tables stay empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.llm import bpe, mixing, neardup, pii, quality
from volatide.llm.common import checked_broadcast, cut, shared_folder, table, unused

#: Keys of two numbers that are broadcast at most.
MOST_KEYS = 200_000
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    name = unused(docs.columns, "__quality")
    scored = quality.annotate(docs, quality.learn(docs, labels), name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = neardup.near_duplicates(docs, words=5, percent=80)
    key = lambda doc_id, text_hash: F.struct(F.coalesce(doc_id.cast("long"), F.lit(0)), text_hash).alias("key")
    gone = checked_broadcast(cut(found.where(~F.col("first")).select(key(F.col("doc_id"), F.col("text_hash"))).distinct()), MOST_KEYS)
    mine = key(F.col("doc_id"), neardup.text_hash(F.col("doc_id").cast("long"), F.col("text")))
    left = docs.select(mine, F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("order")).join(gone, "key", "left_anti")
    # Only documents whose rows repeat need to meet; texts are shuffled only where the keys are too many to be broadcast.
    repeated = checked_broadcast(cut(docs.select(mine).groupBy("key").count().where("count > 1").select("key")), MOST_KEYS)
    one = left.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return left.join(repeated, "key", "left_anti").select("row.*").union(one.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = unused(docs.columns, "__spans")
    masked = pii.redact(pii.find_spans(docs, out=spans), spans=spans).drop(spans)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.expand(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = docs.select("doc_id", "lang", "source", "text")
    done = bpe.encode(plain, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, ids="token_ids", decoded="decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select("doc_id", "lang", "source", F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Classification and tokenization can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written as Parquet to the shared folder and read again for the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
                before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
