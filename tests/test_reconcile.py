"""Evidence, tiers and contention of statement reconciliation."""

import datetime as dt
from decimal import Decimal

from tallyspark.operators import statements


def test_reconcile_weighs_evidence_and_rivals_of_every_offset(spark):
    d, m = dt.date(2024, 1, 10), Decimal("5.00")
    day = lambda n: d + dt.timedelta(days=n)
    rows = [(1, 1, d, None, Decimal(9), "a"), (2, 2, d, "AAAAAA", None, "b"), (3, 3, d, "CCCCCC", None, "paid DDDDDD"), (4, 4, d, None, None, "x"), (5, 4, day(1), None, None, "y"), (6, 5, d, "EEEEEE", None, "paid FFFFFF now")]
    txns = [(11, 1, d, None, Decimal(8), "a"), (12, 2, d, "BBBBBB", None, "b"), (13, 3, d, "DDDDDD", None, "q"), (14, 3, d, None, None, "q"), (15, 4, d, None, None, "q"), (16, 5, day(1), "FFFFFF", None, "q")]
    stmt = spark.createDataFrame([(i, a, "debit", on, m, r, b, t) for i, a, on, r, b, t in rows], "stmt_idx long, account_id long, direction string, date date, amount decimal(12,2), reference_number string, balance decimal(12,2), narration string")
    stored = spark.createDataFrame([(i, a, "debit", m, on, r, b, t) for i, a, on, r, b, t in txns], "id long, account_id long, direction string, amount decimal(12,2), transaction_date date, reference_number string, balance decimal(12,2), raw_description string")
    got = {r.stmt_idx: (r.id, r.status) for r in statements.reconcile(stmt, stored).collect()}
    # balances contradict; references differ; the strong one of two; a rival a day away; references differ on another day
    assert got == {1: (None, "missing"), 2: (None, "missing"), 3: (13, "date"), 4: (None, "ambiguous"), 5: (None, "ambiguous"), 6: (None, "missing")}


def test_references_match_on_any_date_and_hold_back_other_amounts(spark):
    d, m = dt.date(2024, 1, 10), Decimal("5.00")
    stmt = spark.createDataFrame([(1, 1, "debit", d, m, " R1", None, None), (2, 1, "debit", d, m, "R2", None, None), (3, 1, "debit", d, m, "R3", None, None), (4, 1, "credit", d, m, "R1", None, None)], STMT)
    stored = spark.createDataFrame([(11, 1, "debit", m, dt.date(2024, 3, 1), "R1", None, None), (12, 1, "debit", Decimal("6.00"), d, "R2", None, None), (13, 2, "debit", m, d, "R3", None, None)], STORED)
    assert {r.stmt_idx: (r.id, r.status) for r in statements.reconcile(stmt, stored).collect()} == {1: (11, "reference"), 2: (None, "ambiguous"), 3: (None, "missing"), 4: (None, "missing")}


STMT = "stmt_idx long, account_id long, direction string, date date, amount decimal(12,2), reference_number string, balance decimal(12,2), narration string"
STORED = "id long, account_id long, direction string, amount decimal(12,2), transaction_date date, reference_number string, balance decimal(12,2), raw_description string"


def plain_reconcile(stmt, stored):
    """The passes row by row: rows are (number, account, direction, date, amount, reference, balance, narration)."""
    same = lambda s, t: s[1:3] == t[1:3]
    near, told, evidence, who = {}, {}, {}, {s[0]: s[7] for s in stmt}
    for s in stmt:
        near[s[0]], told[s[0]], evidence[s[0]] = {}, [], []
        for t in stored:
            if not same(s, t):
                continue
            equal = s[5] is not None and s[5] == t[5]
            if equal:
                (told if s[4] == t[4] else evidence)[s[0]].append(t[0])
            off = (t[3] - s[3]).days
            contradict = s[6] is not None and t[6] is not None and s[6] != t[6]
            if s[4] == t[4] and abs(off) <= 1 and (equal or (not contradict and (s[5] is None or t[5] is None))):
                near[s[0]][t[0]] = off
    out = {s: (ids[0], "reference") for s, ids in told.items() if len(ids) == 1 and sum(ids[0] in x for x in told.values()) == 1}
    used = {i for i, _ in out.values()}
    left = {s: c for s, c in near.items() if s not in out and c}
    reach = {i: {s for s, c in left.items() if i in c} for c in left.values() for i in c}
    held = {i for i, of in reach.items() if len(of) > 1 and (None in {who[s] for s in of} or len({who[s] for s in of}) > 1)}
    for status, offset in (("date", 0), ("date-1", -1), ("date+1", 1)):
        picks = {}
        for s, c in left.items():
            open_ = [i for i, o in c.items() if o == offset and i not in used]
            if s not in out and len(open_) == 1:
                picks[s] = open_[0]
        for s, i in picks.items():
            if i in held:
                out[s] = (None, "ambiguous")
            elif s == min(k for k, v in picks.items() if v == i):
                out[s] = (i, status)
        used |= set(picks.values())
    return {s[0]: out.get(s[0], (None, "ambiguous" if near[s[0]] or told[s[0]] or evidence[s[0]] else "missing")) for s in stmt}


def frames(spark, stmt, stored):
    return spark.createDataFrame([(i, a, d, on, m, r, b, t) for i, a, d, on, m, r, b, t in stmt], STMT), spark.createDataFrame([(i, a, d, m, on, r, b, None) for i, a, d, on, m, r, b, _ in stored], STORED)


def test_reconcile_equals_a_plain_version(spark):
    import random

    for seed in (3, 4):
        rnd = random.Random(seed)
        row = lambda i: (i, rnd.randrange(4), rnd.choice(["debit", "debit", "credit"]), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(12)), Decimal(rnd.choice([5, 6, 7])), rnd.choice([None, None, *(f"REF{k:04}" for k in range(25))]), rnd.choice([None, None, Decimal(1), Decimal(2)]), rnd.choice([None, "of one kind", "of one kind"]))  # noqa: B023, E731
        stmt, stored = [row(i) for i in range(150)], [row(1000 + i) for i in range(130)]
        want = plain_reconcile(stmt, stored)
        assert {r.stmt_idx: (r.id, r.status) for r in statements.reconcile(*frames(spark, stmt, stored)).collect()} == want
        assert {s for _, s in want.values()} == {"reference", "date", "date-1", "date+1", "ambiguous", "missing"}


def test_equal_rows_share_out_what_they_reach(spark):
    d, m = dt.date(2024, 1, 10), Decimal("5.00")
    stmt = [(i, 1, "debit", d, m, None, None, " the same ") for i in (1, 2, 3)] + [(4, 2, "debit", d, m, None, None, "one"), (5, 2, "debit", d, m, None, None, "other")]
    stored = [(11, 1, "debit", d, m, None, None, None), (12, 1, "debit", dt.date(2024, 1, 9), m, None, None, None), (13, 2, "debit", d, m, None, None, None)]
    got = {r.stmt_idx: (r.id, r.status) for r in statements.reconcile(*frames(spark, stmt, stored)).collect()}
    assert got == {1: (11, "date"), 2: (12, "date-1"), 3: (None, "ambiguous"), 4: (None, "ambiguous"), 5: (None, "ambiguous")}


def test_a_hot_group_is_no_task_of_its_own(spark):
    from pyspark.sql import functions as F

    n = 320  # more than 100,000 pairs of one account, direction and amount
    rows = spark.range(n).select(F.col("id").alias("stmt_idx"), F.lit(1).cast("long").alias("account_id"), F.lit("debit").alias("direction"), F.lit("2024-01-10").cast("date").alias("date"), F.lit(5).cast("decimal(12,2)").alias("amount"), F.when(F.col("id") < 20, F.concat(F.lit("REF"), F.col("id"))).alias("reference_number"), F.lit(None).cast("decimal(12,2)").alias("balance"), F.lit("x").alias("narration"))
    stored = rows.select(F.col("stmt_idx").alias("id"), "account_id", "direction", "amount", F.col("date").alias("transaction_date"), "reference_number", "balance", F.lit(None).cast("string").alias("raw_description"))
    got = statements.reconcile(rows, stored)
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"reference": 20, "ambiguous": n - 20}
    assert "Python" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
