"""Scratch space that driver and workers share, and frames whose lineage is cut there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below the one that the cluster names in spark.checkpoint.dir.

    The setting is read from the session. Where it is unset, a temporary folder is used if driver and workers are one
    process (local masters: tests, a laptop); a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder, which operators need on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="volatide-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; it isn't made yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder.

    Checkpoint files go when Spark's cleaner finds the frame unused, if the cluster enables that.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder wherever Spark's file systems reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
