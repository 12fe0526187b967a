"""Linear recurrences along series, in blocks that are worked on apart.

A recurrence s[t + 1] = u[t] + b * s[t] is an affine map of its start, and so is a block of steps. Series are packed into
blocks of a fixed span of dates, one row a block. A first pass gives each block's map from its own rows, a scan over the
few maps of a series gives each block's start, and a second pass finishes the rows. So a series of any length is spread
over all tasks, and no task holds more of it than a block and the maps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volatide.storage import cut

#: Days (or units of a numeric order) that a block spans.
BLOCK = 256
CHUNK = 64


def recur(u: np.ndarray, b: float, start: np.ndarray) -> np.ndarray:
    """s of shape (n + 1, m): s[0] = start, s[t + 1] = u[t] + b * s[t]; u has shape (n, m).

    Chunks of CHUNK steps are solved at once by a triangle of powers of b, and chained by the same recurrence over their ends.
    """
    n, m = u.shape
    out = np.empty((n + 1, m))
    out[0] = start
    if n <= CHUNK:
        for t in range(n):
            out[t + 1] = u[t] + b * out[t]
        return out
    chunks = -(-n // CHUNK)
    padded = np.zeros((chunks * CHUNK, m))
    padded[:n] = u
    steps = np.arange(CHUNK)
    powers = np.where(steps[:, None] >= steps, float(b) ** np.maximum(steps[:, None] - steps, 0), 0.0)
    inner = np.einsum("ts,csm->ctm", powers, padded.reshape(chunks, CHUNK, m), optimize=True)
    starts = recur(inner[:, -1], float(b) ** CHUNK, np.asarray(start, float))[:-1]
    inner += (float(b) ** (steps + 1))[None, :, None] * starts[:, None, :]
    out[1:] = inner.reshape(-1, m)[:n]
    return out


def place(order: str, kind: str) -> Column:
    """A date's day number, a timestamp's second, or a number itself."""
    return {"date": F.unix_date(order), "timestamp": F.unix_seconds(F.col(order).cast("timestamp")), "timestamp_ntz": F.unix_seconds(F.col(order).cast("timestamp"))}.get(kind, F.col(order).cast("long"))


def numbered(df: DataFrame, order: str = "date", width: int = BLOCK, by: str = "series_id", name: str = "i") -> DataFrame:
    """Number the rows of each series from 0 in their order: numbers inside a block, and the rows of the blocks before it."""
    rows = df.withColumn("__block", F.floor(place(order, dict(df.dtypes)[order]) / width).cast("long"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(by, "__block").agg(F.count("*").alias("__n")).select(by, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__block").orderBy(order)) - 1
    return rows.withColumn(name, inside).join(ends, [by, "__block"]).withColumn(name, F.col("__before") + F.col(name)).drop("__block", "__before")


def packed(df: DataFrame, columns: list[str], order: str = "date", width: int = BLOCK, by: str = "series_id") -> DataFrame:
    """A row a block: `by`, block, at (array of `order`), an array a column, and of the block before: rows, and the last values.

    Columns of what precedes: before (rows of the series), <column>_before (its last value, null in the first block),
    and last (whether no block follows). Rows whose `order` is null are left out. Written to the shared folder.
    """
    spark = df.sparkSession
    rows = df.where(F.col(order).isNotNull()).select(by, F.col(order).alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.withColumn("block", F.floor(place("at", dict(rows.dtypes)["at"]) / width).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.repartition(parts, by, "block").groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("at", *columns))).alias("rows"))
    whole = cut(whole)
    ends = whole.select(by, "block", F.size("rows").alias("n"), F.element_at("rows", -1).alias("end"))
    along = Window.partitionBy(by).orderBy("block")
    ends = ends.select(
        by,
        "block",
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        *[F.lag(f"end.{c}").over(along).alias(f"{c}_before") for c in columns],
        F.lead("block").over(along).isNull().alias("last"),
    )
    return whole.select(by, "block", "rows.at", *[f"rows.{c}" for c in columns]).join(ends, [by, "block"])
