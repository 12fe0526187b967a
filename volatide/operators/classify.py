"""Sentiment scoring: softmax over logits, a linear text classifier, and its metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.schemas import LABELS


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def score_rows(df: DataFrame, probabilities: str) -> DataFrame:
    """Label (first maximum), three probabilities, and positive minus negative."""
    p = F.col(probabilities)
    named = {f"prob_{label}": F.element_at(p, i + 1) for i, label in enumerate(LABELS)}
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(p, F.array_max(p)).cast("int"))
    return df.withColumns({**named, "sentiment_label": label, "sentiment_score": F.element_at(p, 3) - F.element_at(p, 1)})


def centroid_logits(df: DataFrame, vector: str, klass: str, sharpness: float = 4.0) -> DataFrame:
    """Add `logits`: the dot product with the mean vector of each of three classes (three rows, broadcast)."""
    parts = df.select(F.col(klass).alias("k"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("k", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centroids"))
    dot = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) * sharpness
    return df.crossJoin(F.broadcast(one)).withColumn("logits", F.transform("centroids", dot)).drop("centroids")


def text_pipeline(features: int = 1 << 16, rounds: int = 30) -> Pipeline:
    """TF-IDF and multinomial logistic regression; the last stage keeps the labels' names and order with the model."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="input_text", outputCol="__words", pattern=r"(?U)[^\w]+"),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
            IDF(inputCol="__tf", outputCol="__x"),
            LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", maxIter=rounds, regParam=0.01, family="multinomial"),
            IndexToString(inputCol="prediction", outputCol="__label", labels=list(LABELS)),
        ]
    )


def with_label_id(df: DataFrame) -> DataFrame:
    return df.withColumn("__y", (F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1).cast("double"))


def train(df: DataFrame, features: int = 1 << 16, rounds: int = 30) -> PipelineModel:
    return text_pipeline(features, rounds).fit(with_label_id(df))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    n = next(s.numClasses for s in model.stages if hasattr(s, "numClasses"))
    filled = F.concat(vector_to_array(F.col("__p")), F.array_repeat(F.lit(0.0), 3 - n)) if n < 3 else vector_to_array(F.col("__p"))
    out = model.transform(df).withColumn("__probabilities", filled)
    return score_rows(out, "__probabilities").drop("__words", "__tf", "__x", "__p", "__probabilities", "__label", "rawPrediction", "prediction")


def validate_checkpoint(path: str) -> PipelineModel:
    """The saved model, if it has exactly the three labels, in their order."""
    model = PipelineModel.load(path)
    check_labels(model, path)
    return model


def check_labels(model: PipelineModel, name: str) -> None:
    """Fail unless the last stage gives the labels, in their order, and the stage before it as many logits."""
    named = getattr(model.stages[-1], "getLabels", lambda: [])()
    if list(named) != list(LABELS):
        raise ValueError(f"{name} has labels {list(named)}; they must be {list(LABELS)}.")
    classes = [s.numClasses for s in model.stages if hasattr(s, "numClasses")]
    if classes != [len(LABELS)]:
        raise ValueError(f"{name} tells {classes} classes apart, not {len(LABELS)}.")


def confusion(df: DataFrame, gold: str = "label", predicted: str = "sentiment_label") -> DataFrame:
    return df.groupBy(gold).agg(*[F.sum((F.col(predicted) == x).cast("long")).alias(f"predicted_{x}") for x in LABELS])


def accuracy(df: DataFrame, by: list[str], gold: str = "label", predicted: str = "sentiment_label") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))
