"""Streams that run to their end over a folder give the batch's rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.streaming import ingest

SCHEMA = "id long, sender string, body string, received_at timestamp"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_dedup(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    spark.createDataFrame([(1, "A", "x", t), (2, "A", "x", t), (3, "A", "y", t)], SCHEMA).write.parquet(f"{tmp_path}/in")
    got = drain(ingest.deduplicated(ingest.message_stream(spark, f"{tmp_path}/in", SCHEMA), ["sender", "body"]), "dedup")
    assert sorted(r.body for r in got) == ["x", "y"]


def test_debounce_ends_bursts_by_quiet_and_by_longest_wait(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    at = [0, 3, 6, 20] + [40 + 4 * i for i in range(10)] + [1000]
    spark.createDataFrame([(i, "k", "b", t + dt.timedelta(seconds=s)) for i, s in enumerate(at)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = ingest.message_stream(spark, f"{tmp_path}/in", SCHEMA)
    got = drain(ingest.debounced(src, "sender", "received_at"), "debounce")
    assert sorted((r.n, round(r.last_s - r.first_s)) for r in got)[:4] == [(1, 0), (2, 4), (3, 6), (8, 28)]


def test_upsert_keeps_the_newest_and_repeats_safely(spark, tmp_path):
    write = ingest.upsert(f"file://{tmp_path}/t", ["k"], "v")
    a = spark.createDataFrame([(1, 1), (2, 1)], "k long, v long")
    b = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    write(a, 0), write(b, 1), write(b, 1)
    assert sorted(map(tuple, ingest.upserted_table(spark, f"file://{tmp_path}/t").collect())) == [(1, 3), (2, 1)]


def test_dirty_windows(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t), (2, 1, t + dt.timedelta(minutes=30)), (3, 1, t + dt.timedelta(hours=3))], "event_id long, user_id long, ts timestamp")
    assert sorted(r.n for r in ingest.dirty_windows(df).collect()) == [1, 2]
    assert ingest.dirty_windows(df).agg(F.sum("n")).first()[0] == 3


def test_poll_runs_its_stages_and_isolates_failures(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    spark.createDataFrame([(1, "A", "x", t), (2, "B", "y", t)], SCHEMA).write.parquet(f"{tmp_path}/in")
    seen = []

    def broken(batch, batch_id):
        raise ValueError("no")

    stages = [("store", ingest.upsert(f"file://{tmp_path}/t", ["id"], "received_at")), ("broken", broken), ("count", lambda b, i: seen.append(b.count()))]
    q = ingest.poll(ingest.message_stream(spark, f"{tmp_path}/in", SCHEMA), stages, f"{tmp_path}/state", once=True)
    q.awaitTermination(120)
    assert sum(seen) == 2 and ingest.upserted_table(spark, f"file://{tmp_path}/t").count() == 2


def test_a_stream_gives_the_rows_of_its_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(i, f"s{i % 3}", f"b{i % 4}", t + dt.timedelta(seconds=i % 5)) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in")
    got = drain(ingest.deduplicated(ingest.message_stream(spark, f"{tmp_path}/in", SCHEMA), ["sender", "body", "received_at"]), "batchwise")
    assert {(r.sender, r.body, r.received_at) for r in got} == {r[1:] for r in rows} and len(got) == len({r[1:] for r in rows})


def test_journals_are_written_once_and_strangers_kept(spark, tmp_path):
    from tallyspark.operators import journal

    path = f"{tmp_path}/journal"
    texts = spark.createDataFrame([(dt.date(2024, 1, 2), 2, "b"), (dt.date(2024, 1, 1), 1, "a")], "date date, id long, text string")
    assert journal.publish(texts, path) == "written" and journal.publish(texts, path) == "unchanged"
    assert [r.value for r in spark.read.text(f"{path}/entries").collect()] == ["a", "b"]
    assert journal.publish(texts.where("id = 1"), path) == "written"
    spark.createDataFrame([("by hand",)], "value string").write.text(f"{tmp_path}/other/entries")
    assert journal.publish(texts, f"{tmp_path}/other") == "refused"
