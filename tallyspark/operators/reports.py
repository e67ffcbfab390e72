"""Outside reports as rows: JSON of budgets, allocations, recurring payments, income, liabilities and assets.

A payload that is no object, or lacks the part, gives no rows; money that is no number is '0', else text with two places.
The names of parts and fields are fixed values: the reports' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    value = F.bround(c.try_cast("decimal(28,8)"), 2).cast("decimal(20,2)")
    return F.coalesce(value.cast("string"), F.lit("0"))


def _entries(df: DataFrame, key: str, column: str, part: str, value: str) -> DataFrame:
    doc = F.from_json(column, f"{part} map<string,{value}>")
    return df.select(key, F.explode(F.map_entries(doc[part])).alias("e")).select(key, F.col("e.key").alias("name"), F.col("e.value").alias("v")).where("v is not null")


def budget(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row a month; what was spent is the sum over its accounts, without those that are no number."""
    rows = _entries(df, key, column, "budgetsByMonth", "struct<forecast:string,availableThisMonth:string,endOfMonthBalance:string,accounts:array<struct<actual:string>>>")
    spent = F.aggregate(F.coalesce(F.col("v.accounts"), F.array().cast("array<struct<actual:string>>")), F.lit(0).cast("decimal(28,8)"), lambda acc, a: (acc + F.coalesce(a["actual"].try_cast("decimal(28,8)"), F.lit(0))).cast("decimal(28,8)"))
    return rows.select(key, F.col("name").alias("month"), money(F.col("v.forecast")).alias("forecast"), money(spent.cast("string")).alias("actual"), money(F.col("v.availableThisMonth")).alias("available"), money(F.col("v.endOfMonthBalance")).alias("end_balance"))


def allocation(df: DataFrame, key: str, column: str) -> DataFrame:
    """Named targets with their wanted and present share."""
    doc = F.from_json(column, "allocation_targets array<struct<name:string,target:string,current:string>>")
    rows = df.select(key, F.explode(doc["allocation_targets"]).alias("t")).where("trim(coalesce(t.name, '')) <> ''")
    return rows.select(key, F.trim("t.name").alias("name"), money(F.col("t.target")).alias("target"), money(F.col("t.current")).alias("current"))


def recurring(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sequences of payments: period, days between them (null where that is no whole number) and how many."""
    doc = F.from_json(column, "transaction_sequences array<struct<key:string,period:string,interval:string,transactions:array<string>>>")
    rows = df.select(key, F.explode(doc["transaction_sequences"]).alias("s"))
    return rows.select(key, F.coalesce(F.trim("s.key"), F.lit("")).alias("sequence"), F.nullif(F.trim("s.period"), F.lit("")).alias("period"), F.col("s.interval").try_cast("bigint").alias("interval_days"), F.coalesce(F.size("s.transactions"), F.lit(0)).cast("bigint").alias("n"))


def income_statement(df: DataFrame, key: str, column: str, sections: tuple[str, ...] = ("income", "interest", "expenses", "tax", "pnl")) -> DataFrame:
    """One row for each year, section and account."""
    maps = ",".join(f"{s}:map<string,string>" for s in sections)
    rows = _entries(df, key, column, "yearly", f"struct<{maps}>")
    none = F.array().cast("array<struct<section:string,account:string,amount:string>>")

    def lines_of(section: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(F.col(f"v.{section}")), lambda e: F.struct(F.lit(section).alias("section"), F.trim(e["key"]).alias("account"), e["value"].alias("amount"))), none)

    lines = F.concat(*[lines_of(s) for s in sections])
    return rows.select(key, F.col("name").alias("year"), F.explode(lines).alias("l")).where("l.account <> ''").select(key, "year", "l.section", "l.account", money(F.col("l.amount")).alias("amount"))


def liabilities(df: DataFrame, key: str, column: str) -> DataFrame:
    rows = _entries(df, key, column, "liability_breakdowns", "struct<drawn_amount:string,repaid_amount:string,interest_amount:string,balance_amount:string,apr:string>")
    return rows.select(key, F.col("name").alias("account"), *[money(F.col(f"v.{c}")).alias(c) for c in ("drawn_amount", "repaid_amount", "interest_amount", "balance_amount", "apr")])


def assets(df: DataFrame, key: str, column: str) -> DataFrame:
    return _entries(df, key, column, "asset_breakdowns", "struct<marketAmount:string>").select(key, F.col("name").alias("account"), money(F.col("v.marketAmount")).alias("market_amount"))
