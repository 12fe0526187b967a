"""Command line: python -m volatide COMMAND --help. Inputs and outputs are Parquet unless a path ends in .csv.

--params FILE before the command gives defaults for options: lines of `option: value`, perhaps under section names.
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.operators import checks, classify, corpus, frame, garch, labels, reconcile, stats
from volatide.operators.sentiment import daily_sentiment
from volatide.operators.volatility import canonical_prices, log_returns
from volatide.plans import flows
from volatide.schemas import SCORES
from volatide.sources import files
from volatide.streaming.news import article_stream, score_available

OPTIONS = {
    "min_body_len": 100, "max_body_chars": 300, "min_tokens": 5, "max_tokens": 220, "sample_size": 6000, "seed": 42, "train_ratio": 0.8, "val_ratio": 0.0,
    "confidence": 0.8, "threshold": 0.05, "target_type": "parkinson", "sequence_length": 15, "train_end": "2021-12-31", "val_end": "2023-12-31", "epochs": 30,
    "train_rows": 1000, "every": 21, "how": "left", "max_date": None, "limit": 0, "batch_size": 20, "prompt_version": "v1", "features": 1 << 16, "rounds": 30,
    "bins": 50, "corpus_chars": 1200, "site": "cafef", "start": None, "end": None, "batch_files": 16,
}


def _in(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else files.read_table(spark, path)


def _prices(spark: SparkSession, path: str) -> DataFrame:
    return files.read_prices(spark, path) if path.endswith(".csv") else log_returns(canonical_prices(files.read_table(spark, path)))


def _news(spark: SparkSession, path: str) -> DataFrame:
    return files.read_raw_news(spark, path) if path.endswith(".csv") else files.read_table(spark, path)


def _head(df: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows by a column, or all for a limit of 0."""
    return df.orderBy(order).limit(limit) if limit else df


def _out(df: DataFrame, path: str) -> None:
    (files.write_csv if path.endswith(".csv") else files.write_parquet)(df, path)


def preprocess(spark, a):
    print(json.dumps(flows.export_preprocessed(_news(spark, a.news), _prices(spark, a.prices), a.output, a.min_body_len)))


def ingest(spark, a):
    print(json.dumps(flows.ingest(spark, a.pages, a.site, a.output, a.start, a.end, a.limit or None, a.discover_only)))


def prepare_inputs(spark, a):
    articles = _in(spark, a.articles).withColumn("body_text", F.col("body_clean")).withColumn("article_id", F.col("url"))
    _out(_head(corpus.prepare_inputs(articles, a.max_body_chars, a.min_tokens, a.max_tokens).drop("body_text", "body_clean"), a.limit, "article_id"), a.output)


def prepare_training(spark, a):
    parts = [corpus.training_rows(_in(spark, a.articles), "primary", "url", "category", "published_at", "title", "body_clean")]
    if a.extra:
        parts.append(corpus.training_rows(_in(spark, a.extra), "extra", "url", "category", "time", "title", "content", a.max_date))
    _out(corpus.training_corpus(parts, a.corpus_chars), a.output)


def sample(spark, a):
    rows = labels.unlabeled(_in(spark, a.corpus))
    picked = labels.source_balanced_sample(rows, a.sample_size, a.seed) if a.source_balance else labels.stratified_sample(rows, a.sample_size, a.seed)
    _out(picked.withColumn("label", F.lit("")).orderBy("article_id"), a.output)


def merge_annotations(spark, a):
    merged = labels.merge_annotations(_in(spark, a.corpus), _in(spark, a.annotations), _in(spark, a.reviewed), a.confidence)
    _out(labels.labelled_corpus(labels.assign_splits(merged, train=a.train_ratio, val=a.val_ratio)), a.output)


def train(spark, a):
    rows = _in(spark, a.labeled)
    model = classify.train(rows.where("split = 'train'"), a.features, a.rounds)
    model.write().overwrite().save(a.output)
    for row in classify.accuracy(classify.predict(model, rows), ["split"]).collect():
        print(json.dumps(row.asDict()))


def infer(spark, a):
    """With a checkpoint: what has arrived in the inputs' folder since the last run, `batch_files` files at a time."""
    model = classify.validate_checkpoint(a.model)
    score = lambda df: classify.predict(model, df).select(*SCORES)
    if not a.checkpoint:
        _out(score(_in(spark, a.inputs)), a.output)
        return
    inputs = article_stream(spark, a.inputs, spark.read.parquet(a.inputs).schema, a.batch_files)
    score_available(inputs, score, a.output, a.checkpoint)


def merge_scores(spark, a):
    _out(reconcile.merge_scores(_in(spark, a.articles), _in(spark, a.scores), a.how, [F.col("title")], [F.col("sentiment_score")]), a.output)


def _runners(names: str) -> list[tuple]:
    """Labelling models, given as module:function, separated by commas; each takes rows as dicts and returns dicts."""
    found = []
    for name in names.split(","):
        module, function = name.strip().split(":")
        found.append((name.strip(), getattr(importlib.import_module(module), function)))
    return found


def bootstrap(spark, a):
    rows = _head(labels.unlabeled(_in(spark, a.corpus)), a.limit, "article_id")
    _out(labels.bootstrap_labels(rows, _runners(a.models), a.batch_size, a.prompt_version), a.output)


def validate_daily(spark, a):
    daily_rows = daily_sentiment(_in(spark, a.scores), None, a.threshold).withColumnRenamed("sentiment_volume", "n_articles")
    print(json.dumps(files.write_report(checks.daily_validation(daily_rows), a.output)))


def pipeline(spark, a):
    reports = flows.sentiment_pipeline(
        spark, a.mode, a.output, corpus_df=_in(spark, a.corpus), annotations=_in(spark, a.annotations), reviewed=_in(spark, a.reviewed), articles=_in(spark, a.articles),
        prices=None if a.prices is None else _prices(spark, a.prices), daily=_in(spark, a.news), runners=None if a.models is None else _runners(a.models),
        sample_size=a.sample_size, seed=a.seed, threshold=a.confidence, fail=a.fail_on_validation,
    )
    print(json.dumps(reports))


def plot_data(spark, a):
    """What the plots show: distributions of returns and scores, and label shares by year."""
    _out(checks.data_histogram(_prices(spark, a.prices), "log_return", a.bins), f"{a.output}/returns.parquet")
    if a.scores:
        scores = _in(spark, a.scores)
        _out(checks.data_histogram(scores, "sentiment_score", a.bins), f"{a.output}/scores.parquet")
        _out(checks.threshold_shares(scores, "sentiment_score", a.threshold), f"{a.output}/shares.parquet")


def validate(spark, a):
    returns = None if a.prices is None else _prices(spark, a.prices).withColumn("abs_return", F.abs("log_return"))
    report = checks.inference_validation(_in(spark, a.articles), _in(spark, a.scores), "Chứng khoán", "Kinh doanh", returns)
    print(json.dumps(files.write_report(report, a.output)))
    if a.fail_on_validation:
        checks.raise_for_failed(report)


def model_frame(spark, a):
    built = frame.model_frame(_prices(spark, a.prices).drop("log_return"), _in(spark, a.news), _in(spark, a.scores), _in(spark, a.articles), a.threshold, a.target_type)
    _out(frame.validate(built), a.output)


def experiment(spark, a):
    for name, df in flows.experiment(frame.validate(_in(spark, a.frame)), a.train_end, a.val_end, a.sequence_length, a.epochs).items():
        _out(df, f"{a.output}/{name}.parquet")


def robustness(spark, a):
    from volatide.operators.residual import specifications

    prices, news, scores, articles = _prices(spark, a.prices).drop("log_return"), _in(spark, a.news), _in(spark, a.scores), _in(spark, a.articles)
    build = lambda threshold, target: frame.model_frame(prices, news, scores, articles, threshold, target)
    _out(flows.robustness(build, specifications(), a.train_end, a.val_end, a.sequence_length, a.epochs), a.output)


def garch_parameters(spark, a):
    _out(garch.fit_series(_prices(spark, a.prices).where(F.col("date") <= F.lit(a.train_end).cast("date"))), a.output)


def expanding_garch(spark, a):
    _out(garch.expanding(_prices(spark, a.prices), a.train_rows, a.every), a.output)


def describe(spark, a):
    returns = _prices(spark, a.prices).withColumn("pct", F.col("log_return") * 100)
    for df in (stats.describe(returns, "pct"), stats.ljung_box(returns, "pct"), stats.ljung_box(returns.withColumn("squared", F.col("pct") * F.col("pct")), "squared")):
        for row in df.collect():  # a row or two a series
            print(json.dumps(row.asDict()))


def daily(spark, a):
    _out(daily_sentiment(_in(spark, a.scores), _in(spark, a.articles), a.threshold), a.output)


def repair_csv(spark, a):
    rows, counts = files.repair_news_csv(spark, a.news)
    files.write_csv(rows, a.output)
    print(json.dumps(counts.first().asDict()))


# Command -> (function, required inputs, optional inputs, options).
COMMANDS = {
    "ingest": (ingest, ["pages"], [], ["site", "start", "end", "limit"]),
    "preprocess": (preprocess, ["news", "prices"], [], ["min_body_len"]),
    "prepare-inputs": (prepare_inputs, ["articles"], [], ["max_body_chars", "min_tokens", "max_tokens", "limit"]),
    "prepare-training": (prepare_training, ["articles"], ["extra"], ["max_date", "corpus_chars"]),
    "sample": (sample, ["corpus"], [], ["sample_size", "seed"]),
    "merge-annotations": (merge_annotations, ["corpus", "annotations"], ["reviewed"], ["confidence", "train_ratio", "val_ratio"]),
    "bootstrap-labels": (bootstrap, ["corpus", "models"], [], ["limit", "batch_size", "prompt_version"]),
    "train": (train, ["labeled"], [], ["features", "rounds"]),
    "infer": (infer, ["inputs", "model"], ["checkpoint"], ["batch_files"]),
    "merge-scores": (merge_scores, ["articles", "scores"], [], ["how"]),
    "daily-sentiment": (daily, ["scores"], ["articles"], ["threshold"]),
    "validate": (validate, ["articles", "scores"], ["prices"], []),
    "validate-daily": (validate_daily, ["scores"], [], ["threshold"]),
    "pipeline": (pipeline, [], ["corpus", "annotations", "reviewed", "articles", "prices", "news", "models"], ["sample_size", "seed", "confidence"]),
    "plot-data": (plot_data, ["prices"], ["scores"], ["bins", "threshold"]),
    "model-frame": (model_frame, ["prices"], ["news", "scores", "articles"], ["threshold", "target_type"]),
    "experiment": (experiment, ["frame"], [], ["train_end", "val_end", "sequence_length", "epochs"]),
    "robustness": (robustness, ["prices", "scores"], ["news", "articles"], ["train_end", "val_end", "sequence_length", "epochs"]),
    "garch-parameters": (garch_parameters, ["prices"], [], ["train_end"]),
    "expanding-garch": (expanding_garch, ["prices"], [], ["train_rows", "every"]),
    "describe": (describe, ["prices"], [], []),
    "repair-csv": (repair_csv, ["news"], [], []),
}
SILENT = ("describe",)


def parameters(path: str | None) -> dict:
    """Options set in a file of `option: value` lines; section names, comments and unknown options are passed over."""
    found = {}
    for line in Path(path).read_text().splitlines() if path else []:
        name, _, value = line.split("#")[0].strip().partition(":")
        value = value.strip().strip("\"'")
        if name in OPTIONS and value:
            kind = type(OPTIONS[name])
            found[name] = kind(value) if kind in (int, float) else value
    return found


def parser(defaults: dict | None = None) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="volatide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--params", help="file of defaults")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, needed, optional, options) in COMMANDS.items():
        one = commands.add_parser(name)
        for path in needed:
            one.add_argument(f"--{path}", required=True)
        for path in optional:
            one.add_argument(f"--{path}")
        for option in options:
            kind = str if OPTIONS[option] is None else type(OPTIONS[option])
            one.add_argument(f"--{option.replace('_', '-')}", default=(defaults or {}).get(option, OPTIONS[option]), type=kind)
        if name not in SILENT:
            one.add_argument("--output", required=True)
        if name == "sample":
            one.add_argument("--source-balance", action="store_true")
        if name == "ingest":
            one.add_argument("--discover-only", action="store_true")
        if name == "pipeline":
            one.add_argument("--mode", choices=flows.MODES, required=True)
        if name in ("validate", "pipeline"):
            one.add_argument("--fail-on-validation", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    chosen = parser().parse_args(arguments)
    if chosen.params:
        chosen = parser(parameters(chosen.params)).parse_args(arguments)
    COMMANDS[chosen.command][0](spark or SparkSession.builder.appName("volatide").getOrCreate(), chosen)


if __name__ == "__main__":
    main()
