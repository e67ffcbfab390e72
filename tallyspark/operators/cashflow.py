"""Cash-basis reports over transactions: buckets, transfers in, uncategorized, expense detail, footnotes, net and trend.

Inputs are DataFrames of transactions and accounts (see ``sources.adapter``); dates are inclusive, undated rows are in no
range, a null currency means INR, and amounts leave as whole hundredths (bigint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.expressions import inr_or_null, is_blank, month_key, non_inr, paise, signed, unblank
from tallyspark.functions.vocabulary import LABELS, bucket_sql, known_slugs

BANK_TYPES, CARD_TYPES = ["bank_account", "debit_card"], ["credit_card"]


def in_scope(txns: DataFrame, accounts: DataFrame, scope: str) -> DataFrame:
    """Rows of account scope bank, card or unaccounted (no account, a dangling one, or an unknown type): the three partition all rows."""
    types = {"bank": BANK_TYPES, "card": CARD_TYPES, "unaccounted": BANK_TYPES + CARD_TYPES}[scope]
    own = accounts.where(F.col("type").isin(types)).select(F.col("id").alias("_scope_id"))
    return txns.join(own, F.col("account_id") == F.col("_scope_id"), "left_anti" if scope == "unaccounted" else "left_semi")


def dated(txns: DataFrame, start: str, end: str) -> DataFrame:
    return txns.where(F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def flow() -> Column:
    return F.sum(signed(F.col("direction"), F.col("amount")))


def rows() -> Column:
    return F.count(F.lit(1)).cast("bigint").alias("n")


def label(slug: Column) -> Column:
    known = F.coalesce(*[F.when(slug == s, F.lit(name)) for s, name in LABELS.items()], F.initcap(F.replace(slug, F.lit("_"), F.lit(" "))))
    return F.when(slug.isNull(), "(uncategorized)").when((slug != "unknown") & ~slug.isin(known_slugs()), F.concat(F.lit("unmapped: "), slug)).otherwise(known)


def buckets(txns: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """Lines of the income, expense and investment buckets over the bank scope; only investment lines split by direction."""
    grouped = in_scope(dated(txns, start, end).where(inr_or_null(F.col("currency"))), accounts, "bank")
    lines = grouped.withColumn("bucket", F.expr(bucket_sql("category", True))).where(F.col("bucket").isin("income", "expense", "investment"))
    kind = F.when(F.col("bucket") == "investment", F.when(F.col("direction") == "debit", "contribution").otherwise("redemption"))
    out = lines.groupBy("bucket", F.col("category").alias("slug"), kind.alias("kind")).agg(flow().alias("f"), rows())
    return out.select("bucket", "slug", label(F.col("slug")).alias("label"), "kind", paise(F.when(F.col("bucket") == "income", F.col("f")).otherwise(-F.col("f"))).alias("total_paise"), "n")


def transfers_in(txns: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    own = in_scope(dated(txns, start, end).where(inr_or_null(F.col("currency")) & (F.col("category") == "repayment")), accounts, "bank")
    return own.groupBy(unblank(F.col("counterparty")).alias("counterparty")).agg(paise(flow()).alias("total_paise"), rows())


def is_uncategorized() -> Column:
    return is_blank(F.col("category")) | (F.col("category") == "unknown") | ~F.col("category").isin(known_slugs())


def uncategorized(txns: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    own = in_scope(dated(txns, start, end).where(is_uncategorized()), accounts, "bank")
    return own.groupBy(unblank(F.col("category")).alias("slug")).agg(paise(flow()).alias("total_paise"), rows()).withColumn("label", label(F.col("slug")))


def expense_detail(txns: DataFrame, start: str, end: str) -> DataFrame:
    own = dated(txns, start, end).where(inr_or_null(F.col("currency")) & (F.expr(bucket_sql("category", False)) == "expense"))
    return own.groupBy(F.col("category").alias("slug")).agg(paise(-flow()).alias("total_paise"), rows())


def scoped(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every row with its scope, in one join: what the one-pass reports read."""
    kind = accounts.select(F.col("id").alias("_id"), F.when(F.col("type").isin(BANK_TYPES), "bank").when(F.col("type").isin(CARD_TYPES), "card").alias("_scope"))
    return txns.join(kind, F.col("account_id") == F.col("_id"), "left").withColumn("scope", F.coalesce("_scope", F.lit("unaccounted"))).drop("_id", "_scope")


def footnotes(txns: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """What the headline leaves out, in one pass of conditional aggregates."""
    inside = F.coalesce(F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    bank, amount = F.col("scope") == "bank", signed(F.col("direction"), F.col("amount"))
    internal, family, lost = inside & bank & (F.col("category") == "self_transfer"), inside & (F.col("category") == "family"), inside & (F.col("scope") == "unaccounted")
    undated = F.col("transaction_date").isNull()

    def n(c: Column, name: str) -> Column:
        return F.count_if(c).cast("bigint").alias(name)

    def total(c: Column, value: Column, name: str) -> Column:
        return paise(F.sum(F.when(c, value))).alias(name)

    return scoped(txns, accounts).agg(
        n(internal, "internal_count"), total(internal, F.col("amount"), "internal_gross"), total(internal, amount, "internal_net"),
        n(inside & bank & non_inr(F.col("currency")), "non_inr_count"), n(undated, "undated_count"), total(undated, amount, "undated_net"),
        n(lost, "unaccounted_count"), total(lost, amount, "unaccounted_net"), n(family, "family_count"), total(family, amount, "family_net"))


def net(txns: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """Income + transfers in - expense - net investment, and the parts."""
    own = in_scope(dated(txns, start, end).where(inr_or_null(F.col("currency"))), accounts, "bank").withColumn("bucket", F.expr(bucket_sql("category", True)))

    def part(bucket: str, sign: int, name: str) -> Column:
        return paise(F.sum(F.when(F.col("bucket") == bucket, signed(F.col("direction"), F.col("amount")) * sign))).alias(name)

    out = own.agg(part("income", 1, "income"), part("transfers_in", 1, "transfers_in"), part("expense", -1, "expense"), part("investment", -1, "net_invested"))
    return out.withColumn("net_cash_retained", F.col("income") + F.col("transfers_in") - F.col("expense") - F.col("net_invested"))


def trend(txns: DataFrame, accounts: DataFrame, months: int, today: str) -> DataFrame:
    """Income, expense, net invested and salary count of each of the last months; months without rows are zeros."""
    spark, day = txns.sparkSession, F.lit(today).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.trunc(F.add_months(day, 1 - months), "MM"), F.trunc(day, "MM"), F.expr("interval 1 month"))).alias("m")).select(month_key(F.col("m")).alias("month"))
    own = in_scope(txns.where(F.col("transaction_date").between(F.trunc(F.add_months(day, 1 - months), "MM"), day)), accounts, "bank")
    own = own.withColumn("month", month_key(F.col("transaction_date"))).withColumn("bucket", F.expr(bucket_sql("category", True)))
    inr, amount = inr_or_null(F.col("currency")), signed(F.col("direction"), F.col("amount"))
    sums = own.groupBy("month").agg(
        F.sum(F.when(inr & (F.col("bucket") == "income"), amount)).alias("i"), F.sum(F.when(inr & (F.col("bucket") == "expense"), -amount)).alias("e"),
        F.sum(F.when(inr & (F.col("bucket") == "investment"), -amount)).alias("v"), F.count_if(F.col("category") == "salary").alias("s"))
    return spine.join(sums, "month", "left").select("month", paise(F.col("i")).alias("income"), paise(F.col("e")).alias("expense"), paise(F.col("v")).alias("net_invested"), F.coalesce("s", F.lit(0)).cast("bigint").alias("salary_count"))


def by_magnitude(lines: DataFrame, total: str, label: str) -> DataFrame:
    """Report lines with the largest first, whatever their sign; labels break ties."""
    return lines.orderBy(F.abs(F.col(total)).desc(), F.col(label).asc_nulls_first())
