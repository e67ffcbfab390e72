"""Messages through stages, each message with a state of its own: what is still to be done, and when it is tried again.

A stage is a function of one message (parse, enrich, announce).  All stages of a new message are tried at once; one that fails
stays open in the message's state, and a timer tries the open ones again, later after each failure, until they are done or given
up.  Other messages and the other stages don't wait.  State and timers are in the stream's checkpoint: over a restart nothing is
forgotten, and a stage that is done isn't run again.  A message that is read again (sources read two days over) is known by its
key, while its state lives.

Needs the RocksDB state store (``use_state_store``).  An attempt whose batch fails is run again as a whole, so a stage with outside
effects must bear that, as any work in Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds until the next attempt, by the failures so far; the last one counts for all that follow.
BACKOFF_S = (60, 120, 300, 600, 900)
#: How long a finished message is known: sources read two days again.
REMEMBERED_S = 3 * 86_400
OUTCOMES = "key string, stage string, outcome string, attempt int, result string, state string"

Stage = Callable[[dict[str, Any]], Any]


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that message states need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Stages(StatefulProcessor):
    """The open stages of each message."""

    def __init__(self, stages: list[tuple[str, Stage]], backoff_s: tuple[float, ...], attempts: int, remembered_s: float):
        self.stages, self.backoff_s, self.attempts, self.remembered_s = stages, backoff_s, attempts, remembered_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "payload string, todo string, attempt int")
        self.finished = handle.getValueState("finished", "state string", ttlDurationMs=int(self.remembered_s * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        payloads = [p for f in rows for p in f["payload"]]
        if self.message.exists() or self.finished.exists() or not payloads:
            return
        yield self._attempt(key[0], min(payloads), [name for name, _ in self.stages], 1, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.message.exists():
            payload, todo, attempt = self.message.get()
            yield self._attempt(key[0], payload, json.loads(todo), attempt + 1, timerValues)

    def _attempt(self, key: str, payload: str, todo: list[str], attempt: int, timers: Any) -> pd.DataFrame:
        out, open_ = [], []
        for name, stage in self.stages:
            if name not in todo:
                continue
            try:
                result = stage(json.loads(payload))
                out.append([key, name, "done", attempt, None if result is None else str(result)])
            except Exception as e:  # noqa: BLE001  (isolated: it is tried again)
                last = attempt >= self.attempts
                out.append([key, name, "given_up" if last else "failed", attempt, f"{type(e).__name__}: {e}"])
                if not last:
                    open_.append(name)
        if open_:
            state = "pending"
            self.message.update((payload, json.dumps(open_), attempt))
            wait = self.backoff_s[min(attempt, len(self.backoff_s)) - 1]
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, int(wait * 1000)))
        else:
            state = "failed" if any(x[2] == "given_up" for x in out) else "done"
            self.message.clear()
            self.finished.update((state,))
        return pd.DataFrame([(*x, state) for x in out], columns=["key", "stage", "outcome", "attempt", "result", "state"]).astype({"attempt": "int32"})


def staged(messages: DataFrame, key: str, stages: list[tuple[str, Stage]], backoff_s: tuple[float, ...] = BACKOFF_S, attempts: int = 6, remembered_s: float = REMEMBERED_S) -> DataFrame:
    """(key, stage, outcome, attempt, result, state) of every attempt of a stream's messages: outcome is done, failed (tried again) or
    given_up, state what the message is then (pending, done, failed).  A stage gets the message's columns as JSON gives them."""
    rows = messages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "false"}).alias("payload"))
    return rows.groupBy("key").transformWithStateInPandas(Stages(stages, backoff_s, attempts, remembered_s), outputStructType=OUTCOMES, outputMode="Append", timeMode="ProcessingTime")
