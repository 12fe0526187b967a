"""Helpers of the corpus operators: shared scratch space, checked broadcasts, batch iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volatide.storage import cut, new_folder, shared_folder  # noqa: F401

#: The words of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a small side up to which it is broadcast; beyond, the join shuffles and AQE splits hot keys.
BROADCAST_ROWS = 50_000


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `limit` rows (counted), else as it is."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


#: Bytes of rows that are sent to a Python worker at once.
BATCH_BYTES, DEFAULT_BATCH = 8 << 20, "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Batches for Python workers are bounded by bytes, since a thousand texts may be large."""
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(option) == DEFAULT_BATCH:  # unless the session asks for something else
        spark.conf.set(option, f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what a worker holds at once stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]], rows: int) -> DataFrame:
    """The frame with these columns, made from bounded batches of all of its columns; existing columns of their names are replaced."""
    new = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *fields])
    before, names = df.columns, schema.names

    def run(batches):
        for batch in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *make(batch.rename_columns(before))], names)

    # Numbered on their way in: names with dots can't be passed.
    return df.toDF(*[f"c{i}" for i in range(len(before))]).mapInArrow(run, schema)
