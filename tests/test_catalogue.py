"""Every registered query against its SQL on the same tables, by DuckDB."""

import duckdb
import pytest

from tallyspark.plans import catalogue
from tallyspark.sources.adapter import TABLES

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"card_reconcile", "portfolio_disposals", "disposal_resolution", "pii_redact", "portfolio_tokens", "names_redacted"}


def test_scopes_partition_all_rows(spark, sf):
    from tallyspark.sources.adapter import FinanceTables

    rows = QUERIES["scope_partition"](spark, sf).collect()
    assert sum(r["n"] for r in rows) == FinanceTables(spark, sf)["transactions"].count()


def test_net_is_the_sum_of_the_lines(spark, sf):
    lines = QUERIES["cashflow_buckets"](spark, sf).collect()
    net = QUERIES["cashflow_net"](spark, sf).first()
    total = {b: sum(r["total_paise"] for r in lines if r["bucket"] == b) for b in ("income", "expense", "investment")}
    assert (net["income"], net["expense"], net["net_invested"]) == (total["income"], total["expense"], total["investment"])
    assert net["net_cash_retained"] == net["income"] + net["transfers_in"] - net["expense"] - net["net_invested"]


def test_entries_balance_and_nothing_is_lost(spark, sf):
    from pyspark.sql import functions as F

    from tallyspark.operators import ledger
    from tallyspark.sources.adapter import FinanceTables

    t = FinanceTables(spark, sf)
    rows = ledger.projected(t["transactions"], t["accounts"], t["fx_rates"], catalogue.CUTOVER)
    posted = ledger.postings(rows)
    assert posted.groupBy("id", "commodity").agg(F.sum("amount_paise").alias("s")).where("s <> 0").isEmpty()
    assert posted.select("id").distinct().count() + rows.where("reason is not null").count() == t["transactions"].where(F.col("transaction_date") > catalogue.CUTOVER).count()
