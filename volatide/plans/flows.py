"""Whole runs, from raw tables to frames and forecasts: one session, lazy until something is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.functions.dates import market_timestamp
from volatide.functions.text import clean_body
from volatide.operators import alignment, checks, classify, corpus, frame, garch, labels, reconcile, residual, stats
from volatide.operators.sentiment import daily_sentiment
from volatide.operators.volatility import log_returns
from volatide.schemas import ARTICLES_CLEAN, DAILY_NEWS_PRICES, SCORES
from volatide.sources import archive, files
from volatide.storage import cut, delete, new_folder


def preprocess(news: DataFrame, prices: DataFrame, min_body: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles_clean, daily_news_prices, diagnostics) from raw news (strings) and bars."""
    clean = news.withColumn("body_clean", clean_body(F.col("body")))
    clean = clean.withColumn("body_len", F.length("body_clean")).where(F.col("body_len") >= min_body)
    timed = clean.withColumns({"__raw": F.col("published_at"), "published_at": market_timestamp(F.col("published_at")), "date": F.to_date(F.try_to_timestamp("date"))})
    aligned = alignment.align(timed, prices.select("date"))
    articles = aligned.where("trading_date is not null").withColumn("published_at", F.col("__raw")).select(*ARTICLES_CLEAN)
    daily = alignment.news_prices(log_returns(prices), alignment.daily_news(articles)).select(*DAILY_NEWS_PRICES)
    return articles, daily, alignment.diagnostics(news, aligned, daily)


def export_preprocessed(news: DataFrame, prices: DataFrame, folder: str, min_body: int = 100) -> dict:
    """Write both tables and the report, whose counts are taken in the passes that write; the news is read once."""
    body = clean_body(F.col("body"))
    timed = news.withColumns({"body_clean": body, "body_len": F.length(body), "__raw": F.col("published_at"), "published_at": market_timestamp(F.col("published_at")), "date": F.to_date(F.try_to_timestamp("date"))})
    columns = [F.col("__raw").alias(c) if c == "published_at" else F.col(c) for c in ARTICLES_CLEAN]
    report = alignment.write_aligned(timed, log_returns(prices), f"{folder}/articles_clean.parquet", f"{folder}/daily_news_prices.parquet", F.col("body_len") >= min_body, columns, days=DAILY_NEWS_PRICES)
    rows = spark_row(news.sparkSession, report)
    return files.write_report(rows, f"{folder}/report.json")


def spark_row(spark, values: dict) -> DataFrame:
    """One row of named numbers."""
    return spark.createDataFrame([values], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))


def train(corpus_df: DataFrame, annotations: DataFrame, reviewed: DataFrame | None = None, threshold: float = 0.8, train_share: float = 0.8):
    """(model, labelled rows with splits, accuracy by split)."""
    merged = labels.merge_annotations(corpus_df, annotations, reviewed, threshold)
    split = labels.labelled_corpus(labels.assign_splits(merged, train=train_share))
    model = classify.train(split.where("split = 'train'"))
    return model, split, classify.accuracy(classify.predict(model, split), ["split"])


def infer(articles: DataFrame, prices: DataFrame, daily: DataFrame, model, fail: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored articles, validation, model frame)."""
    inputs = corpus.prepare_inputs(articles.withColumn("body_text", F.col("body_clean")))
    scored = classify.predict(model, inputs).select("url", "trading_date", "category", "sentiment_score", "sentiment_label", "prob_positive", "prob_negative", "prob_neutral")
    validation = checks.inference_validation(articles, scored, "Chứng khoán", "Kinh doanh", log_returns(prices).withColumn("abs_return", F.abs("log_return")))
    if fail:
        checks.raise_for_failed(validation)
    with_scores = reconcile.merge_scores(articles, scored, "left", [F.col("title")], [F.col("sentiment_score")])
    return with_scores, validation, frame.model_frame(prices, daily, scored)


LEDGER = "url string, status string"


def ingest(spark, pages: str, site: str, output: str, start: str | None = None, end: str | None = None, limit: int | None = None, discover_only: bool = False, require_date: bool = True) -> dict[str, int]:
    """Articles of an archive of stored pages, with a ledger, resumable; gives the counts of this run.

    A micro-batch's articles and then its part of the ledger are written under its number, so a run that was stopped goes on
    with the next batch and one that runs again replaces its own. Urls that the ledger lists as completed are skipped; an article
    outside `start` to `end` (ISO dates) is completed without being kept; a page without an article has failed.
    `discover_only` counts urls; `limit` takes the first files of the archive.
    """
    archive.register(spark)
    options = {"site": site} | ({"limit": str(limit)} if limit else {})
    if discover_only:
        return {"discovered_urls": spark.read.format("news_pages").options(**options).load(pages).select("url").distinct().count()}
    counts = dict.fromkeys(("discovered_urls", "parsed_articles", "skipped_duplicates", "date_filter_skips", "failed_pages"), 0)
    folder = new_folder(spark, "ingest")

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        batch.dropDuplicates(["url"]).write.mode("overwrite").parquet(f"{folder}/{part}")  # parsed once
        raw = spark.read.schema(archive.PAGES).parquet(f"{folder}/{part}")
        listed = spark.createDataFrame([], LEDGER)
        if files.exists(spark, f"{output}/ledger"):
            listed = spark.read.schema(f"{LEDGER}, batch int").parquet(f"{output}/ledger").where(F.col("batch") != number)
        fresh = reconcile.not_done(raw, listed)
        found = archive.articles(fresh, site, require_date)
        kept = found
        if start or end:
            kept = found.where(F.col("date").between(start or "0001-01-01", end or "9999-12-31"))
        kept.write.mode("overwrite").parquet(f"{output}/articles/{part}")
        status = fresh.select("url").join(found.select("url", F.lit("completed").alias("status")), "url", "left").fillna({"status": "failed"})
        status.write.mode("overwrite").parquet(f"{output}/ledger/{part}")
        mine, rows = spark.read.schema(LEDGER).parquet(f"{output}/ledger/{part}"), spark.read.schema("url string").parquet(f"{output}/articles/{part}").count()
        by = {r["status"]: r["n"] for r in mine.groupBy("status").agg(F.count("*").alias("n")).collect()}
        total, parsed = raw.count(), by.get("completed", 0)
        for name, n in zip(counts, (total, rows, total - sum(by.values()), parsed - rows, by.get("failed", 0)), strict=True):
            counts[name] += n
        delete(spark, f"{folder}/{part}")

    stream = spark.readStream.format("news_pages").options(**options).load(pages)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counts


MODES = ("train", "infer", "full")


def sentiment_pipeline(spark, mode: str, folder: str, *, corpus_df=None, annotations=None, reviewed=None, articles=None, prices=None, daily=None, runners=None, sample_size: int = 6000, seed: int = 42, threshold: float = 0.8, fail: bool = False) -> dict:
    """The sentiment stages in order, each written below `folder`: train, infer, or both ("full", with the model just trained).

    train: a sample of the corpus for annotation; labels by `runners` where no annotations are given; annotations and
    reviews merged and split; the classifier and its accuracy. infer: model inputs, scores, scores beside articles, the
    reports on inference and days, and the model frame. Gives the reports' rows.
    """
    if mode not in MODES:
        raise ValueError(f"Mode {mode!r} is none of {', '.join(MODES)}.")
    at = lambda name: f"{folder}/{name}"
    written = lambda df, name: (files.write_parquet(df, at(name)), spark.read.parquet(at(name)))[1]
    reports = {}
    if mode in ("train", "full"):
        if corpus_df is None or (annotations is None and runners is None):
            raise ValueError("Training needs a corpus, and annotations or a labelling model.")
        sample = written(labels.stratified_sample(labels.unlabeled(corpus_df), sample_size, seed), "annotation_sample.parquet")
        if annotations is None:
            annotations = written(labels.bootstrap_labels(sample, runners), "bootstrap_labels.parquet")
        model, split, accuracy = train(corpus_df, annotations, reviewed, threshold)
        files.write_parquet(split, at("training_labeled.parquet"))
        model.write().overwrite().save(at("model"))
        reports["accuracy"] = [row.asDict() for row in accuracy.collect()]  # a row a split
    if mode in ("infer", "full"):
        if articles is None or prices is None or daily is None:
            raise ValueError("Inference needs articles, prices and daily news.")
        model = classify.validate_checkpoint(at("model"))
        scored = written(classify.predict(model, corpus.prepare_inputs(articles.withColumn("body_text", F.col("body_clean")))).select(*SCORES), "article_sentiment_scores.parquet")
        files.write_parquet(reconcile.merge_scores(articles, scored, "left", [F.col("title")], [F.col("sentiment_score")]), at("articles_with_scores.parquet"))
        validation = checks.inference_validation(articles, scored, "Chứng khoán", "Kinh doanh", log_returns(prices).withColumn("abs_return", F.abs("log_return")))
        reports["inference"] = files.write_report(validation, at("sentiment_inference_validation.json"))
        reports["daily"] = files.write_report(checks.daily_validation(daily_sentiment(scored).withColumnRenamed("sentiment_volume", "n_articles")), at("daily_aggregation_validation.json"))
        if fail:
            checks.raise_for_failed(validation)
        files.write_parquet(frame.model_frame(prices, daily, scored), at("modeling_ready.parquet"))
    return reports


def experiment(frame_df: DataFrame, train_end: str, val_end: str, length: int = 15, epochs: int = 30, features: list[str] | None = None) -> dict[str, DataFrame]:
    """Forecasts of the test dates, with errors, Diebold-Mariano and subperiods."""
    frame_df = cut(frame_df)
    forecasts = cut(residual.hybrid_forecasts(frame_df, train_end, val_end, features, length, epochs).where("split = 'test'"))
    moods = frame_df.select("series_id", "date", F.col("mean_sentiment").alias("sentiment"))
    return {
        "forecasts": forecasts,
        "errors": residual.compare(forecasts),
        "diebold_mariano": stats.diebold_mariano(forecasts),
        "subperiods": stats.subperiods(forecasts.join(moods, ["series_id", "date"])),
    }


def robustness(build, specs: list[residual.Spec], train_end: str, val_end: str, length: int = 15, epochs: int = 30) -> DataFrame:
    """Errors, Diebold-Mariano test and gamma (of GARCH-X) of every specification on the dates after `val_end`.

    build(threshold, target) gives a frame. One is built for each threshold and target, all are written together, as series
    of their own, and so are the windows of all specifications: fits, networks and tests of all run side by side.
    """
    named = lambda df, name: df.withColumn("series_id", F.concat(F.lit(f"{name}|"), F.col("series_id")))
    of = {spec.name: f"{spec.threshold}/{spec.target}" for spec in specs}
    frames = {of[spec.name]: (spec.threshold, spec.target) for spec in specs}
    data = cut(_union([named(build(*key), name) for name, key in frames.items()]))
    only = lambda df, spec: df.where(F.startswith("series_id", F.lit(f"{of[spec.name]}|"))).withColumn("series_id", F.concat(F.lit(f"{spec.name}|"), F.substring_index("series_id", "|", -1)))
    kinds = {kind: [spec for spec in specs if spec.kind == kind] for kind in ("hybrid", "garchx", "expanding")}
    windows, found, gammas = [], [], []
    if kinds["hybrid"]:
        full = cut(garch.add_features(data, train_end))
        windows += [residual.residual_windows(only(full, spec), train_end, val_end, spec.features, length) for spec in kinds["hybrid"]]
    if kinds["expanding"]:
        full = cut(residual.with_expanding_garch(_union([only(data, spec) for spec in kinds["expanding"]]), val_end))
        windows.append(residual.residual_windows(full, train_end, val_end, None, length))
    if windows:
        found.append(residual.corrected(cut(_union(windows)), epochs).where("split = 'test'"))
    if kinds["garchx"]:
        pushed = cut(residual.garchx_forecasts(_union([only(data, spec) for spec in kinds["garchx"]]), val_end))
        found.append(pushed.withColumn("split", F.lit("test")))
        gammas = [pushed.groupBy("series_id").agg(F.max("gamma").alias("gamma"))]
    all_found = cut(_union([f.select("series_id", "date", "actual", "baseline", "hybrid") for f in found]))
    out = residual.compare(all_found).join(stats.diebold_mariano(all_found), "series_id")
    out = out.join(gammas[0], "series_id", "left") if gammas else out.withColumn("gamma", F.lit(None).cast("double"))
    return out.withColumns({"spec": F.substring_index("series_id", "|", 1), "series_id": F.substring_index("series_id", "|", -1)})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
