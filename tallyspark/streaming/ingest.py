"""Streaming ingest: message deduplication, change windows with a quiet gap and a longest wait, keyed upserts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.streaming.tables import KeyedTable, upsert

__all__ = ["deduplicated", "debounced", "dirty_windows", "message_stream", "poll", "session_stream", "upsert", "upserted_table"]

_log = logging.getLogger(__name__)

#: Late messages are read again from so far before the cursor; deduplication makes that harmless.
LATENESS = "2 days"


def message_stream(spark: SparkSession, path: str, schema: T.StructType | str, time: str = "received_at") -> DataFrame:
    """Messages of a folder of Parquet files as a stream with event time (stored times without zone are UTC)."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(messages: DataFrame, keys: list[str], time: str = "received_at", lateness: str = LATENESS) -> DataFrame:
    """The first of equal messages that arrive within the lateness of each other."""
    return messages.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def dirty_windows(events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", gap: str = "1 hour") -> DataFrame:
    """Sessions of changes a key: a new one after a gap; the batch result of the stream's session windows."""
    w = Window.partitionBy(key).orderBy(time, order)
    new = F.col(time) - F.lag(time).over(w) > F.expr(f"interval {gap}")
    numbered = events.withColumn("session", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).cast("bigint").alias("n"))


def session_stream(changes: DataFrame, key: str, time: str, gap: str = "5 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Session windows of a change stream: one row when a key has been quiet for the gap."""
    return changes.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def debounced(changes: DataFrame, key: str, time: str = "ts", quiet_s: int = 5, longest_s: int = 30, lateness: str = "30 seconds") -> DataFrame:
    """One row for each burst of changes of a key: it ends after ``quiet_s`` without a change or ``longest_s`` after its first.

    State is (first, last, count) of the open burst, whatever its length."""

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n = state.get if state.exists else (None, None, 0)
        times = sorted(t for f in frames for t in f["t"]) if not state.hasTimedOut else []
        for t in times:
            if n and (t - last > quiet_s or t - first > longest_s):
                out.append((k[0], first, last, n))
                n = 0
            first, last, n = (t, t, 1) if not n else (first, max(last, t), n + 1)
        if state.hasTimedOut and n:
            out.append((k[0], first, last, n))
            state.remove()
        elif n:
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(int(min(last + quiet_s, first + longest_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "first_s", "last_s", "n"])

    timed = changes.withWatermark(time, lateness).select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).cast("double").alias("us")).withColumn("t", F.col("us") / 1e6)
    return timed.groupBy("key").applyInPandasWithState(step, "key string, first_s double, last_s double, n long", "first double, last double, n long", "append", "EventTimeTimeout")


def upserted_table(spark: SparkSession, target: str) -> DataFrame:
    """The rows that ``upsert`` keeps."""
    return KeyedTable.at(spark, target).read()


def poll(stream: DataFrame, stages: list[tuple[str, Callable[[DataFrame, int], None]]], checkpoint: str, minutes: int = 15, once: bool = False):
    """Runs the stages over every micro-batch of a stream, in their order, each ``minutes`` (one at least); with ``once`` over
    what is there now.  A stage that fails is told in the query's log and doesn't keep the later ones from running."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        failed = []
        for name, stage in stages:
            try:
                stage(batch, batch_id)
            except Exception as e:  # noqa: BLE001  (isolated, and told)
                failed.append(f"{name}: {e}")
        batch.unpersist()
        if failed:
            _log.warning("batch %s: %s", batch_id, "; ".join(failed))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, minutes)} minutes")).start()
