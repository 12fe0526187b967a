"""Runs with parameters, metrics and artefacts, as rows that Spark reads: a JSON file a run, below a shared folder.

    with run(spark, folder, "experiment", {"epochs": 30}) as top:
        with top.child("baseline") as one:
            one.metrics({"errors": {"rmse": 0.1}})
            one.artefact("forecasts", forecasts)

A run is written when it ends, also when it fails; a run that was never ended leaves nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volatide.sources.files import exists, flatten_metrics

RUNS = "run_id string, parent_id string, name string, status string, started double, seconds double, params map<string,string>, metrics map<string,double>, artefacts map<string,string>"


class Run:
    def __init__(self, spark: SparkSession, folder: str, name: str, params: dict | None = None, parent: Run | None = None):
        self.spark, self.folder, self.name, self.parent = spark, folder, name, parent
        self.run_id, self.started = uuid.uuid4().hex, time.time()
        self.found: dict[str, dict] = {"params": {k: str(v) for k, v in (params or {}).items()}, "metrics": {}, "artefacts": {}}

    def params(self, values: dict) -> None:
        self.found["params"] |= {k: str(v) for k, v in values.items()}

    def metrics(self, report: dict) -> None:
        """Numbers, also nested ones, which get dotted names."""
        self.found["metrics"] |= flatten_metrics(report)

    def artefact(self, name: str, df: DataFrame) -> str:
        """Write a frame beside the run; gives its path."""
        path = f"{self.folder}/artefacts/{self.run_id}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        self.found["artefacts"][name] = path
        return path

    def child(self, name: str, params: dict | None = None) -> Run:
        return Run(self.spark, self.folder, name, params, self)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        row = {"run_id": self.run_id, "parent_id": self.parent and self.parent.run_id, "name": self.name, "status": "failed" if kind else "finished", "started": self.started, "seconds": time.time() - self.started} | self.found
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/runs")


def run(spark: SparkSession, folder: str, name: str, params: dict | None = None) -> Run:
    return Run(spark, folder, name, params)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All ended runs below the folder."""
    return spark.read.schema(RUNS).json(f"{folder}/runs") if exists(spark, f"{folder}/runs") else spark.createDataFrame([], RUNS)


def best(runs: DataFrame, metric: str, lowest: bool = True) -> DataFrame:
    """Of each name the finished run with the lowest (or highest) metric; ties go to the earlier one."""
    value = F.col("metrics")[metric]
    done = runs.where((F.col("status") == "finished") & value.isNotNull())
    order = F.struct((value if lowest else -value).alias("v"), "started", "run_id")
    return done.groupBy("name").agg(F.min_by(F.struct("run_id", value.alias("value"), "params"), order).alias("r")).select("name", "r.*")
