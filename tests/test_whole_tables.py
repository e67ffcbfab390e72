"""Queries over whole tables give every row its result: checked by brute force, without the queries' own SQL."""

import datetime as dt
import re
from collections import Counter, defaultdict

from tallyspark.operators import investments, ledger
from tallyspark.plans import catalogue
from tallyspark.sources.adapter import FinanceTables

Q = catalogue.queries()


def posted(spark, sf):
    return ledger.postings(catalogue._projected(FinanceTables(spark, sf))).collect()


def test_every_transaction_gets_its_examples(spark, sf):
    rows = FinanceTables(spark, sf)["transactions"].select("id", "direction", "counterparty", "created_at", "category", "category_method").collect()
    plain = {r.id: re.sub("[^a-z0-9]", "", (r.counterparty or "").lower()) for r in rows}
    newest = sorted((r for r in rows if r.category is not None and r.category_method in ("manual", "rule")), key=lambda r: (r.created_at, r.id), reverse=True)
    recent = {d: [r.id for r in newest if r.direction == d][:200] for d in ("credit", "debit")}
    want = {}
    for r in rows:
        mine = plain[r.id]
        hits = [i for i in recent.get(r.direction, []) if mine and plain[i] and (mine in plain[i] or plain[i] in mine)]
        want |= {(r.id, i): place for place, i in enumerate(hits[:5], 1)}
    assert {t % 50 for t, _ in want} > {3}
    assert {(r.target, r.id): r.place for r in Q["similar_examples_all"](spark, sf).collect()} == want


def test_every_negative_posting_gets_its_verdicts(spark, sf):
    rows = posted(spark, sf)
    times = Counter((p.account, p.date, p.amount_paise) for p in rows if p.account.startswith("Expenses:") and p.amount_paise < 0)
    groups, want = defaultdict(list), {}
    for p in rows:
        if p.leg == 1 and p.amount_paise < 0:
            groups[p.account, p.date, p.amount_paise] += [p.id * 10 + 1, p.id * 10 + 2]
            want[p.id * 10 + 9] = "fatal"
    for key, ids in groups.items():
        want |= {i: "accepted" if n < times[key] else "fatal" for n, i in enumerate(sorted(ids))}
    assert any(i // 10 % 50 >= 5 for i in want)
    assert {r.id: r.verdict for r in Q["diagnosis_verdicts_all"](spark, sf).collect()} == want


def test_every_posting_gets_its_line(spark, sf):
    def line(p):
        whole, paise = divmod(abs(p.amount_paise), 100)
        return f"    {p.account:<48} {'-' if p.amount_paise < 0 else ''}{whole}.{paise:02} {p.commodity}"

    assert sorted((r.id, r.leg, r.line) for r in Q["ledger_lines_all"](spark, sf).collect()) == sorted((p.id, p.leg, line(p)) for p in posted(spark, sf))


def test_a_long_account_keeps_its_line_in_spark_and_sql(spark):
    import duckdb

    account = "Assets:Bank:" + "x" * 50
    data = [(1, 0, account, dt.date(2024, 1, 1), "INR", -1234)]
    mine = ledger.journal_lines(spark.createDataFrame(data, "id long, leg int, account string, date date, commodity string, amount_paise long")).first().line
    sql = catalogue._SQL["ledger_lines_all"].replace(f"({catalogue._POST})", f"(SELECT 1 AS id, 0 AS leg, '{account}' AS account, 'INR' AS commodity, -1234 AS amount_paise)")
    assert mine == f"    {account} -12.34 INR" == duckdb.sql(sql).fetchall()[0][2]


def test_positions_count_every_valuation(spark, sf):
    raw = investments.classify(FinanceTables(spark, sf)["raw_lots"]).collect()
    units, navs = defaultdict(list), defaultdict(set)
    for r in raw:
        if r.instrument is not None:
            units[r.instrument].append(r.units), navs[r.instrument].add(r.nav)
    got = {r.instrument: (r.quantity, r.unit_price) for r in Q["investment_positions_all"](spark, sf).collect()}
    only = lambda s: int(next(iter(s))) if len(s) == 1 and None not in s else None
    assert got == {i: (int(sum(u)), only(navs[i])) for i, u in units.items()}
