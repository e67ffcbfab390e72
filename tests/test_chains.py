"""Chains of a batch: work that doesn't grow with their length, references that join them, and the joins' rules message by message."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import batches, matching
from tallyspark.plans import merging
from tests.test_batches import INCOMING, STORED, TYPES, one_by_one, random_rows, table

BASE = {"bank": "b", "direction": "debit", "amount": Decimal(500), "currency": "INR", "transaction_date": dt.date(2024, 1, 2), "transaction_time_s": 36000, "received_time": False, "counterparty": "Shop", "account_mask": None, "reference_number": None, "balance": None, "email_type": "other"}
NAMES = [*(x.split()[0] for x in STORED.split(", ")), "seq"]


def assert_as_one_by_one(got, messages, stored):
    want, rows = one_by_one(messages, stored)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got.decisions.collect()), key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])
    assert sorted((tuple(r[n] for n in NAMES) for r in got.table.collect()), key=repr) == sorted((tuple(r[n] for n in NAMES) for r in rows), key=repr)


def test_jobs_do_not_grow_with_the_longest_chain(spark):
    def jobs(n):
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            m = [BASE | {"seq": k, "by_email": k % 2 == 0, "transaction_time_s": None, "balance": Decimal(k)} for k in range(1, n + 1)]
            got = batches.merge_batch(table(spark, m, INCOMING)[0], table(spark, [], STORED)[0], TYPES)
            assert got.decisions.where("action = 'insert'").count() == n
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) < 2 * jobs(2)


def test_a_chain_of_hundreds_equals_the_loop(spark):
    s, m = random_rows(11, 60, 300, (500,), 90)
    got = batches.merge_batch(table(spark, m, INCOMING)[0], table(spark, s, STORED)[0], TYPES)
    assert_as_one_by_one(got, m, s)


def test_references_join_the_chains_of_many_events(spark):
    n = 24
    # row k holds the reference of message k and lies in the event of message k + 1; a message without a date has its reference only
    s = [BASE | {"id": k, "source": "sms", "amount": Decimal(100 + k), "reference_number": f"R{k} ", "currency": "USD"} for k in range(1, n)]
    m = [BASE | {"seq": 3 * k, "by_email": True, "amount": Decimal(99 + k + (k % 5 != 0)), "reference_number": f" R{k}", "currency": "USD" if k % 2 else None, "transaction_date": None if k % 7 == 0 else BASE["transaction_date"]} for k in range(1, n)]
    m += [BASE | {"seq": 3 * k + 1, "by_email": k % 2 == 0, "amount": Decimal(101 + k), "reference_number": f"R{k}", "currency": "USD"} for k in range(1, n)]
    got = batches.merge_batch(table(spark, m, INCOMING)[0], table(spark, s, STORED)[0], TYPES)
    assert_as_one_by_one(got, m, s)
    assert got.rounds > n


def test_lone_messages_are_decided_as_by_the_joins(spark):
    rnd, schema = random.Random(4), ", card_mask string, identifies_by string, channel string, raw_description string"

    def row(amount):
        at = rnd.choice([36000, 36030, 36500, 36700, 79200, 79260, 100, 86390, 44000, None])
        return {"bank": rnd.choice(["b"] * 9 + [None]), "direction": "debit", "amount": Decimal(amount), "currency": rnd.choice([None, "INR"]), "transaction_date": dt.date(2024, 1, rnd.choice([2, 2, 2, 3, 1])), "transaction_time_s": at, "received_time": rnd.random() < 0.2,
                "counterparty": rnd.choice([None, "", "Caf\xe9 नम", "caf\xe9*", "CAF\xc9", "Fuel"]), "account_mask": rnd.choice([None, None, "XX-1111", "12*1", "0000 1111", "n/a", "x11"]), "reference_number": rnd.choice([None, None, None, f" R{amount}", f"R{amount}", " "]), "balance": rnd.choice([None, None, Decimal("10.10"), Decimal(20)]), "email_type": rnd.choice(["alias", "other", None]),
                "card_mask": rnd.choice(["XX12", "4XXX 0012", "12XX", "XX13", None]), "identifies_by": rnd.choice(["card_mask", "card_mask", "none", None]), "channel": rnd.choice([None, "upi"]), "raw_description": rnd.choice([None, "a b", " a "])}

    amounts = range(1000, 1250)
    m = [row(a) | {"seq": a, "by_email": rnd.random() < 0.5} for a in amounts]
    s = [row(a) | {"id": 10 * a + k, "source": rnd.choice(["sms", "email", "sms+email", "statement", None])} for a in amounts for k in range(4)]
    incoming, stored = table(spark, m, INCOMING + schema)[0].localCheckpoint(), table(spark, s, STORED + schema)[0].localCheckpoint()
    got = batches.merge_batch(incoming, stored, TYPES)
    want = matching.find_matches(incoming, stored, TYPES, slots=True).localCheckpoint()
    rows = {tuple(r) for r in got.decisions.select("seq", "path", "action", F.when(F.col("action") == "match", F.col("id")), "reason").collect()}
    assert rows == {tuple(r) for r in want.select("seq", "path", "action", "id", "reason").collect()} and got.rounds == 1
    assert len({(r[1], r[2], r[4]) for r in rows}) >= 9
    changed = matching.applied(stored.drop("source", "received_time"), incoming, matching.changes(incoming, stored, want)).drop("enriched")
    after = got.table.where("seq is null").select(changed.columns)
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(map(tuple, changed.collect()), key=repr)


def test_customers_of_a_batch_do_not_come_to_the_driver(spark, sf):
    from tallyspark.sources.adapter import FinanceTables

    t = FinanceTables(spark, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [o_custkey" in plan(t["transactions"])
    merged = plan(merging.batch_merged(t))
    assert "SortMergeJoin [o_custkey" in merged and "BroadcastHashJoin [o_custkey" not in merged


def test_rows_without_a_reference_are_dealt_over_tasks(spark):
    m, s = table(spark, [BASE | {"seq": 1, "by_email": True}], INCOMING)[0], table(spark, [BASE | {"id": 1, "source": "sms"}], STORED)[0]
    _, r = batches.chains(m.withColumn("_id", F.col("seq") + 10), s.withColumn("_id", F.col("id")))
    keys = r._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(_ref" in keys and r.count() == 1
