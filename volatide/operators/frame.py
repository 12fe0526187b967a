"""The modelling frame: bars, news controls and sentiment a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.operators.sentiment import daily_sentiment
from volatide.operators.volatility import volatility_features
from volatide.schemas import MODEL_FRAME, require_columns

ZERO_FILL = {
    "n_articles": 0, "n_categories": 0, "mean_body_len": 0.0, "mean_sentiment": 0.0, "sentiment_std": 0.0, "sentiment_volume": 0,
    "negative_share": 0.0, "neutral_share": 0.0, "positive_share": 0.0, "net_sentiment": 0.0, "sentiment_surprise": 0.0,
}


def model_frame(
    prices: DataFrame, news: DataFrame | None = None, scores: DataFrame | None = None, articles: DataFrame | None = None, threshold: float = 0.05, target: str = "parkinson", **categories
) -> DataFrame:
    """Sessions without news get zeros; macro and market sentiment stay null on days with other news only."""
    df = volatility_features(prices, target)
    if news is not None:
        df = df.join(news.select("date", *[c for c in ("n_articles", "n_categories", "mean_body_len") if c in news.columns]), "date", "left")
    if scores is not None:
        df = df.join(daily_sentiment(scores, articles, threshold, **categories), "date", "left")
    quiet = F.coalesce("sentiment_volume", F.lit(0)) == 0 if "sentiment_volume" in df.columns else F.lit(False)
    partial = {c: F.when(quiet, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in ("macro_sentiment", "market_sentiment") if c in df.columns}
    has = (F.coalesce("sentiment_volume", F.lit(0)) > 0).cast("int") if "sentiment_volume" in df.columns else F.lit(0)
    df = df.withColumns(partial | {"has_sentiment": has, "has_news": has})
    df = df.fillna({k: v for k, v in ZERO_FILL.items() if k in df.columns})
    return df.fillna({k: 1 for k in ("macro_sentiment_missing", "market_sentiment_missing") if k in df.columns})


def validate(df: DataFrame) -> DataFrame:
    return require_columns(df, MODEL_FRAME, "Model frame")


def load_or_build(spark, path: str | None, **parts) -> DataFrame:
    """The artefact if it is there (checked against the contract), else the frame built from `parts`."""
    if path is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return validate(spark.read.parquet(path))
    return validate(model_frame(**parts))
