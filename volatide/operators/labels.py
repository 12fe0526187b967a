"""Labels: merging annotations, temporal splits, sampling for annotation, and batched labelling by a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volatide.functions.text import normalize_label
from volatide.operators.alignment import MOST_DAYS
from volatide.schemas import LABELED, SPLITS, TRAINING, require_columns, require_unique


def clean_annotations(df: DataFrame, dataset: str, threshold: float, allow_low: bool = False, reviewed: bool = False, check: bool = True) -> DataFrame:
    """(article_id, label, confidence, label_source); reviewed ones skip the threshold."""
    require_columns(df, ["article_id", "label"], dataset)
    label = normalize_label(F.col("label"))
    if check:
        require_unique(df, ["article_id"], dataset)
        bad = df.agg(F.max((F.trim(F.coalesce("label", F.lit(""))) == "").cast("int")), F.max(label.isNull().cast("int"))).first()
        if bad[0]:
            raise ValueError(f"{dataset}: some rows have no label.")
        if bad[1]:
            raise ValueError(f"{dataset}: some labels are none of the three.")
    confidence = F.col("confidence").try_cast("double") if "confidence" in df.columns else F.lit(1.0 if reviewed else None).cast("double")
    out = df.select("article_id", label.alias("label"), confidence.alias("confidence"), F.lit("reviewed" if reviewed else "bootstrap").alias("label_source"))
    if check and "confidence" in df.columns and not out.where(F.col("confidence").isNull()).isEmpty():
        raise ValueError(f"{dataset}: some confidences are no numbers.")
    if "confidence" in df.columns and not allow_low and not reviewed:
        out = out.where(F.col("confidence") >= threshold)
    return out


def merge_annotations(corpus: DataFrame, annotations: DataFrame, reviewed: DataFrame | None = None, threshold: float = 0.8, allow_low: bool = False, check: bool = True) -> DataFrame:
    """Labelled rows of the corpus; a review overrides label, confidence and source."""
    require_columns(corpus, TRAINING, "normalized training corpus")
    if check:
        require_unique(corpus, ["article_id"], "Normalized training corpus")
    fields = ("label", "confidence", "label_source")
    out = corpus.drop(*fields).join(clean_annotations(annotations, "annotation file", threshold, allow_low, check=check), "article_id", "left")
    if reviewed is not None:
        review = clean_annotations(reviewed, "reviewed annotation file", threshold, reviewed=True, check=check).withColumnsRenamed({f: f"reviewed_{f}" for f in fields})
        out = out.join(review, "article_id", "left").withColumns({f: F.coalesce(f"reviewed_{f}", f) for f in fields}).drop(*[f"reviewed_{f}" for f in fields])
    out = out.where(F.col("label").isNotNull())
    if check and out.isEmpty():
        raise ValueError("None of the annotated article_ids is in the corpus.")
    return out


def assign_splits(df: DataFrame, order: str = "article_id", time: str = "published_at", train: float = 0.8, val: float = 0.0) -> DataFrame:
    """Add `split`: the first days train, then val, the rest test. A complete split column is kept.

    Days are few, so ranks of days are computed over distinct days; rows never meet in one window. Numbers of days
    round half to even. On one day the first rows by `order` fill the other splits, the rest trains.
    """
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError(f"Shares of {train} for train and {val} for val leave nothing for a split.")
    if "split" in df.columns and df.where(F.col("split").isNull()).isEmpty():
        out = df.withColumn("split", F.lower(F.trim("split")))
        if not out.where(~F.col("split").isin(*SPLITS)).isEmpty():
            raise ValueError(f"Rows have splits other than {", ".join(SPLITS)}.")
        return out
    require_columns(df, [time], "Temporal split")
    dated = df.drop("split").withColumn("__day", F.to_date(F.try_to_timestamp(F.col(time).cast("string"))))
    if not dated.where(F.col("__day").isNull()).isEmpty():
        raise ValueError(f"Rows without a date in {time} can't be split by time.")
    days = dated.select("__day").distinct()
    total = days.count()
    if total <= 1:
        rest = ["train", "test", *(["val"] if val > 0 else [])]
        head = [r[order] for r in dated.select(order).orderBy(order).limit(len(rest)).collect()]
        split = F.lit("train")
        if len(head) == len(rest):
            for key, name in zip(head, rest, strict=True):
                split = F.when(F.col(order) == key, name).otherwise(split)
        return dated.withColumn("split", split).drop("__day")
    n_train = min(max(1, round(total * train)), total - 1)
    n_val = max(0, round(total * val))
    if n_train + n_val >= total:
        n_val = max(0, total - n_train - 1)
    ranked = days.withColumn("__n", F.row_number().over(Window.orderBy("__day")))
    split = F.when(F.col("__n") <= n_train, "train").when(F.col("__n") <= n_train + n_val, "val").otherwise("test")
    named = ranked.select("__day", split.alias("split"))
    out = dated.join(F.broadcast(named) if total <= MOST_DAYS else named, "__day").drop("__day")
    if val > 0 and n_val == 0:  # an expected split without a day gets the first row of the largest one
        sizes = out.groupBy("split").count().orderBy(F.col("count").desc(), "split").first()
        moved = out.where(F.col("split") == sizes["split"]).agg(F.min(order)).first()[0]
        out = out.withColumn("split", F.when(F.col(order) == moved, "val").otherwise(F.col("split")))
    return out


def labelled_corpus(merged: DataFrame) -> DataFrame:
    return merged.select(*LABELED, *[c for c in ("source_dataset", "confidence", "label_source") if c in merged.columns])


def split_by_rows(df: DataFrame, order: str = "date", train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Add `split` by the row's place in its series: int(n * ratio) rows each, the rest test."""
    place, n = F.row_number().over(Window.partitionBy("series_id").orderBy(order)), F.count("*").over(Window.partitionBy("series_id"))
    n_train, n_val = F.floor(n * train), F.floor(n * val)
    return df.withColumn("split", F.when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test"))


def split_by_dates(df: DataFrame, train_end: str, val_end: str, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test"))


# --- sampling -------------------------------------------------------------------------------------------------


def category_bucket(df: DataFrame, category: str = "category") -> DataFrame:
    """Add `category_bucket`: high from 1000 rows, mid from 100, else low."""
    name = F.coalesce(F.col(category), F.lit(""))
    counts = df.groupBy(name.alias("__c")).agg(F.count("*").alias("__n"))
    bucket = F.when(F.col("__n") >= 1000, "high").when(F.col("__n") >= 100, "mid").otherwise("low")
    return df.join(counts.withColumn("category_bucket", bucket).drop("__n"), name == F.col("__c")).drop("__c")


def stratified_sample(df: DataFrame, n: int, seed: int = 42, key: str = "article_id", per: str | None = None) -> DataFrame:
    """Round robin over (source, year, category bucket): each stratum gives one row a round, by a seeded hash.

    Only the first n rows of a stratum can be chosen, so strata are cut to n by a partial top-n (Spark's window group
    limit) before rows meet.
    """
    source = "source_dataset" if "source_dataset" in df.columns else "source"
    year = F.coalesce(F.year(F.try_to_timestamp(F.col("published_at").cast("string"))), F.lit(-1))
    marked = category_bucket(df).withColumn("sample_year", year).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    strata = [source, "sample_year", "category_bucket"]
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key))
    turns = marked.withColumn("__turn", turn).where(F.col("__turn") <= n)
    return turns.orderBy("__turn", *strata).limit(n).drop("__h", "__turn")


def source_balanced_sample(df: DataFrame, n: int, seed: int = 42, key: str = "article_id") -> DataFrame:
    """Equal quotas by source, one more for the first sources by name; what a small source leaves is filled from the rest."""
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    sizes = df.groupBy("source").agg(F.count("*").alias("__size"))
    quotas = sizes.withColumn("__quota", F.floor(F.lit(n) / F.count("*").over(Window.partitionBy())) + (F.row_number().over(Window.orderBy("source")) <= F.lit(n) % F.count("*").over(Window.partitionBy())).cast("int"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("__h", key))
    ranked = hashed.withColumn("__place", place).where(F.col("__place") <= n).join(quotas, "source")
    within = ranked.withColumn("__extra", (F.col("__place") > F.col("__quota")).cast("int"))
    return within.orderBy("__extra", F.when(F.col("__extra") == 1, F.col("__h")), "source", "__place").limit(n).drop("__h", "__size", "__quota", "__place", "__extra")


def unlabeled(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isNull() | (F.trim("label") == "")) if "label" in df.columns else df


# --- labelling by a model -------------------------------------------------------------------------------------


#: Rows that are numbered together when batches are made.
HASHED_TOGETHER = 10_000


def batches(df: DataFrame, size: int = 20, key: str = "article_id") -> DataFrame:
    """Add batch_index: at most `size` rows share a batch.

    Rows are dealt by hash into groups of about HASHED_TOGETHER and numbered within them, so there is no global order;
    all batches of a group but its last are full.
    """
    groups = max(1, -(-df.count() // HASHED_TOGETHER))
    h = F.xxhash64(key)
    dealt = df.withColumns({"__group": F.pmod(h, F.lit(groups)), "__h": h})
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__h", key)) - 1
    return dealt.withColumn("batch_index", F.floor(place / size) * groups + F.col("__group")).drop("__group", "__h")


def bootstrap_labels(df: DataFrame, runners: list[tuple[str, Callable[[list[dict]], list[dict]]]], size: int = 20, prompt_version: str = "v1") -> DataFrame:
    """Labels by the first runner that answers a whole batch validly.

    A runner gets rows as dicts and returns dicts of article_id, label, confidence, rationale. A missing, repeated or
    invalid answer fails the batch for that runner; answers for other ids are ignored. If all fail, the task fails.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.to_dict("records")
        wanted = [r["article_id"] for r in rows]
        for name, runner in runners:
            try:
                answers = [a for a in runner(rows) if a.get("article_id") in set(wanted)]
            except Exception:  # noqa: BLE001  any failure of a model means the next one
                continue
            by_id = {a["article_id"]: a for a in answers}
            if len(answers) != len(wanted) or len(by_id) != len(wanted):
                continue
            checked = [(i, str(by_id[i].get("label", "")).strip().lower(), by_id[i].get("confidence"), str(by_id[i].get("rationale") or "").strip()) for i in wanted]
            if all(label in ("negative", "neutral", "positive") and isinstance(c, (int, float)) and 0 <= c <= 1 and why for _, label, c, why in checked):
                out = pd.DataFrame(checked, columns=["article_id", "label", "confidence", "rationale"])
                return out.assign(confidence=out["confidence"].astype(float), model_name=name, prompt_version=prompt_version)
        raise ValueError(f"No model labelled batch {group['batch_index'].iloc[0]} validly.")

    schema = "article_id string, label string, confidence double, rationale string, model_name string, prompt_version string"
    return batches(df, size).groupBy("batch_index").applyInPandas(run, schema)


def prompt(title, body):
    return F.format_string("Classify the sentiment of this article as negative, neutral or positive.\nTitle: %s\nBody: %s\nAnswer with JSON.", title, body)


def batch_prompts(df: DataFrame, batch: str, order: list[str], text: str) -> DataFrame:
    """One prompt a batch: its texts in order, numbered, with blank lines between."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("__text"))))
    numbered = F.transform("__items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["__text"]))
    grouped = df.groupBy(batch).agg(items.alias("__items"))
    return grouped.select(batch, F.array_join(numbered, "\n\n").alias("prompt"), F.size("__items").cast("long").alias("n_items"))
