"""A ledger of fetch attempts as a stream with state: what is done, what failed, what is due again, what is given up.

Urls are dealt by their hash into shards, and a shard's urls are updated together: a group a url would cost a call of
Python and a frame for every one of them. What is kept of a url does not depend on the order in which attempts arrive: the
first success, the earliest `max_attempts` failures, and the number of all attempts. A url is `completed` by its first success, or `dead` if
`max_attempts` failures came before it; else it is `failed`, and due again after a delay that doubles with each failure.
A shard's timer on the watermark tells when the first of these times has come. What comes after the outcome is only counted, as `skipped`.

Updates are written by micro-batch under its number, so a batch that runs again replaces its own; the ledger is each
url's last version. The number of shards stays what it was when the checkpoint began. Attempts without a url or time are left out; an attempt whose `ok` is null has failed.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "url string, status string, attempts long, skipped long, last_error string, retry_at timestamp, done_at timestamp, due boolean, version long"
#: A shard's urls, packed: {url: [attempts, first success, failures with their errors, version, milliseconds at which it is due again]}.
STATE = "urls binary, shards int"
#: Shards of a checkpoint, unless told.
SHARDS = 64


def outcome(first_ok: int | None, failures: list[int], errors: list[str], max_attempts: int, base: int) -> tuple:
    """(status, attempts, last error, retry time, time of the outcome) of times in microseconds; `failures` are in order."""
    before = [i for i, at in enumerate(failures) if first_ok is None or at < first_ok]
    last = errors[before[-1]] if before else None
    if len(before) >= max_attempts:
        return "dead", max_attempts, errors[max_attempts - 1], None, failures[max_attempts - 1]
    if first_ok is not None:
        return "completed", len(before) + 1, last, None, first_ok
    return "failed", len(before), last, failures[before[-1]] + base * 1_000_000 * 2 ** (len(before) - 1), None


def _moments(micros: list[int | None]) -> np.ndarray:
    return np.array([np.iinfo(np.int64).min if m is None else m for m in micros], np.int64).view("datetime64[us]")


def _take(held: dict[str, list], frame: pd.DataFrame, max_attempts: int) -> set[str]:
    """Add attempts to the urls of a shard; gives the urls that they are of."""
    for url, micros, ok, error in zip(*(frame[c].tolist() for c in ("url", "micros", "ok", "error")), strict=True):
        kept = held.get(url)
        if kept is None:
            kept = held[url] = [0, None, [], 0, None]
        kept[0] += 1
        failures = kept[2]
        if ok:
            kept[1] = micros if kept[1] is None else min(kept[1], micros)
        elif len(failures) < max_attempts or (micros, error) < failures[-1]:
            insort(failures, (micros, error))
            del failures[max_attempts:]
    return set(frame["url"])


def track(attempts: DataFrame, max_attempts: int = 3, base_seconds: int = 600, late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Updates of the ledger from a stream of (url, at, ok, error)."""
    rows = attempts.where("url is not null and at is not null").select("url", F.col("at").cast("timestamp").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("error", F.lit("")).alias("error"))
    rows = rows.withWatermark("at", late).withColumns({"micros": F.unix_micros("at"), "shard": F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int")})

    def update(key, frames, state):
        held, touched = {}, set()
        if state.exists:
            packed, before = state.get
            if before != shards:
                raise ValueError(f"The checkpoint has {before} shards, not {shards}.")
            held = pickle.loads(zlib.decompress(packed))
        if not state.hasTimedOut:
            for frame in frames:
                touched |= _take(held, frame, max_attempts)
        # Milliseconds, as watermarks are.
        now = state.getCurrentWatermarkMs()
        out = []
        for url in sorted(touched.union(u for u, kept in held.items() if kept[4] is not None and kept[4] <= now)):
            total, first_ok, failures, version, _ = kept = held[url]
            status, n, error, retry, done = outcome(first_ok, [f for f, _ in failures], [e for _, e in failures], max_attempts, base_seconds)
            due = retry is not None and retry // 1000 <= now
            kept[3], kept[4] = version + 1, None if retry is None or due else retry // 1000
            out.append((url, status, n, total - n, error, retry, done, due, version + 1))
        state.update((zlib.compress(pickle.dumps(held), 1), shards))
        waiting = min((kept[4] for kept in held.values() if kept[4] is not None), default=None)
        if waiting is not None:
            state.setTimeoutTimestamp(waiting)
        if out:
            names = ["url", "status", "attempts", "skipped", "last_error", "retry_at", "done_at", "due", "version"]
            columns = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
            yield pd.DataFrame(columns | {c: _moments(columns[c]) for c in ("retry_at", "done_at")})

    return rows.groupBy("shard").applyInPandasWithState(update, LEDGER, STATE, "update", "EventTimeTimeout")


def run(attempts: DataFrame, folder: str, checkpoint: str, **options) -> None:
    """Take in what has arrived since the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    track(attempts, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: the last version of each url."""
    rows = spark.read.schema(LEDGER).parquet(folder)
    names = [c for c in rows.columns if c != "url"]
    return rows.groupBy("url").agg(F.max_by(F.struct(*names), "version").alias("r")).select("url", "r.*")


def to_fetch(urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Urls that are new or due again: not completed, dead, or waiting."""
    return urls.join(ledger.where("status <> 'failed' or not due").select("url"), "url", "left_anti")


def report(ledger: DataFrame) -> DataFrame:
    """(status, urls, attempts, skipped)."""
    return ledger.groupBy("status").agg(F.count("*").alias("urls"), F.sum("attempts").alias("attempts"), F.sum("skipped").alias("skipped"))
