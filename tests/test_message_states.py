"""Stages that fail are tried again by timers, over restarts, and each result comes once."""

import os
import time

from pyspark.sql import functions as F

from tallyspark.streaming import states

SCHEMA = "id long, body string"


def test_failed_stages_are_tried_again_over_a_restart(spark, tmp_path):
    tries = str(tmp_path / "tries")
    os.mkdir(tries)

    def parse(m):
        return m["body"].upper()

    def shaky(m):  # fails twice for id 2, always for id 3
        n = len([f for f in os.listdir(tries) if f.startswith(f"{m['id']}-")])
        open(f"{tries}/{m['id']}-{n}", "w").close()
        if m["id"] == 3 or m["id"] == 2 and n < 2:
            raise ValueError("not yet")
        return n

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.use_state_store(spark)
    try:
        spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "x")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")

        def start():
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            out = states.staged(stream, "id", [("parse", parse), ("shaky", shaky)], backoff_s=(0.5, 0.5), attempts=4)
            return out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()

        def outcomes():
            try:
                return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "stage", "outcome", "attempt", "result").collect()]
            except Exception:  # nothing written yet
                return []

        def until(query, enough):
            end = time.time() + 120
            while not enough(outcomes()) and time.time() < end and query.isActive:
                time.sleep(1)
            query.stop()

        until(start(), lambda got: ("2", "shaky", "failed", 1, "ValueError: not yet") in got)
        # the same messages are read again, with one that is new
        spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        until(start(), lambda got: any(o == "given_up" for _, _, o, _, _ in got) and any(k == "4" for k, *_ in got))
        got = outcomes()
        done = sorted((k, s, r) for k, s, o, _, r in got if o == "done")
        assert done == [("1", "parse", "A"), ("1", "shaky", "0"), ("2", "parse", "B"), ("2", "shaky", "2"), ("3", "parse", "C"), ("4", "parse", "D"), ("4", "shaky", "0")]
        assert sorted(a for k, s, o, a, _ in got if (k, s) == ("3", "shaky")) == [1, 2, 3, 4] and len(got) == len(set(got))
        last = {r.key: r.state for r in spark.read.parquet(f"{tmp_path}/out").groupBy("key").agg(F.max_by("state", "attempt").alias("state")).collect()}
        assert last == {"1": "done", "2": "done", "3": "failed", "4": "done"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
