"""Keyed tables: commits, repeats, schemas, compaction, change feeds and what a failed write leaves."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.streaming.tables import KeyedTable


def rows(table, number=None):
    return sorted(map(tuple, table.read(number).collect()), key=repr)


def test_random_batches_equal_a_plain_table(spark, tmp_path):
    t, plain, rnd = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], "v", buckets=3, deltas=2), {}, random.Random(1)
    history = []
    for batch in range(6):
        new = [(rnd.choice([None, 1, 2]), rnd.choice("xyz"), rnd.randrange(20), f"{batch}-{i}") for i in range(6)]
        new = list({(a, b, v): (a, b, v, s) for a, b, v, s in new}.values())
        t.upsert(spark.createDataFrame(new, "a int, b string, v long, s string"), batch)
        for r in new:
            if r[:2] not in plain or r[2] >= plain[r[:2]][2]:
                plain[r[:2]] = r
        history.append(dict(plain))
        assert rows(t) == sorted(plain.values(), key=repr)
    assert t.versions() == list(range(6)) and rows(t, 2) == sorted(history[2].values(), key=repr)
    # a bucket's folders are folded once there are too many
    assert max(len(f) for f in t.version().folders.values()) <= 3
    for since in (0, 3):
        got = sorted(map(tuple, t.changes(since).collect()), key=repr)
        assert got == sorted(((*r, "update" if k in history[since] else "insert") for k, r in plain.items() if history[since].get(k) != r), key=repr)
    assert t.changes(None, 1).count() == len(history[1]) and t.changes(5).count() == 0
    gone = t.expire(2)
    assert t.versions() == [4, 5] and rows(t) == sorted(plain.values(), key=repr) and rows(t, 4) == sorted(history[4].values(), key=repr) and any(g.startswith("rows/") for g in gone)
    with pytest.raises(ValueError, match="not kept"):
        t.changes(0)


def test_repeated_and_failed_batches(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "v")
    assert t.version() is None and t.versions() == []
    a = spark.createDataFrame([(1, 1), (2, 1)], "k long, v long")
    assert (t.upsert(a, 0), t.upsert(a, 0)) == (0, 0)
    b = spark.createDataFrame([(1, 2)], "k long, v long")
    with monkeypatch.context() as m:  # the files are there, the manifest isn't
        m.setattr(KeyedTable, "_commit", lambda self, v: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(b, 1)
    assert rows(t) == [(1, 1), (2, 1)]
    assert t.upsert(b, 1) == 1 and rows(t) == [(1, 2), (2, 1)]
    assert sum(g.startswith("rows/") for g in t.expire(1)) == 1 and rows(t) == [(1, 2), (2, 1)]  # what the failed write left
    # a job that fails inside leaves the table, too
    bad = b.withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        t.upsert(bad, 2)
    assert rows(t) == [(1, 2), (2, 1)]


def test_schemas_grow_and_never_drop_rows(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "v", deltas=1)
    t.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), 0)
    t.upsert(spark.createDataFrame([(3, 2, "new"), (200, 1, "more")], "k long, v long, note string"), 1)
    got = {r.k: (r.v, r.note) for r in t.read().collect()}
    assert len(got) == 101 and got[3] == (2, "new") and got[4] == (1, None) and t.read().columns == ["k", "v", "note"]
    t.upsert(spark.createDataFrame([(5, 9)], "k long, v long"), 2)
    assert t.read().count() == 101 and {r.k: r.v for r in t.read().collect()}[5] == 9
    with pytest.raises(ValueError, match="column v is bigint"):
        t.upsert(spark.createDataFrame([(5, "9")], "k long, v string"), 3)
    assert t.read().count() == 101
    empty = spark.createDataFrame([], "k long, v long")
    assert t.upsert(empty, 4) == 3 and t.read().count() == 101
    with pytest.raises(ValueError, match="no table"):
        KeyedTable.at(spark, f"file://{tmp_path}/none")
    first = KeyedTable(spark, f"file://{tmp_path}/none", ["k"], "v")
    assert first.upsert(empty, 0) == 0 and first.read().count() == 0 and first.read().columns == ["k", "v"]
