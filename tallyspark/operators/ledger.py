"""Double-entry projection: FX decisions, opening balances, postings, skipped rows and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import paise
from tallyspark.functions.vocabulary import EXPENSE_SLUGS, INCOME_SLUGS
from tallyspark.operators.asof import as_of


def fx_as_of(txns: DataFrame, rates: DataFrame) -> DataFrame:
    """id, currency and the latest rate on or before each row's date (null: none)."""
    return as_of(txns.select("id", "currency", "transaction_date"), "currency", "transaction_date", rates, "currency", "date", "rate", "rate")


def normalized_commodity(c: Column) -> Column:
    """Upper-case letters and digits that start with a letter; INR for blank, null where nothing valid is left."""
    bare = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "INR").when(bare.rlike("^[A-Z]"), bare)


def account_name(type_: Column, bank: Column, label: Column) -> Column:
    return F.when(type_ == "credit_card", F.concat(F.lit("Liabilities:Card:"), F.initcap(bank), F.lit(":"), label)).otherwise(F.concat(F.lit("Assets:Bank:"), F.initcap(bank), F.lit(":"), label))


def contra_account(category: Column) -> Column:
    slug = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("unknown"))
    words = F.replace(F.initcap(F.replace(slug, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.when(slug.isin([s for s in INCOME_SLUGS if s not in ("refund", "cashback_rewards", "investment_redemption", "repayment")]), F.concat(F.lit("Income:"), words)).when(
        slug.isin(EXPENSE_SLUGS + ["refund", "cashback_rewards"]), F.concat(F.lit("Expenses:"), words)).when(
        slug.isin("investment", "investment_redemption"), "Assets:Investments:Unallocated").when(slug == "repayment", "Equity:Transfers In").when(
        slug == "self_transfer", "Equity:Transfers").when(slug == "credit_card_payment", "Liabilities:Credit Card").when(slug == "family", "Expenses:Family").otherwise("Equity:Unknown")


def projected(txns: DataFrame, accounts: DataFrame, rates: DataFrame, cutover: str) -> DataFrame:
    """Dated rows after the cutover with their accounts, commodity, rate and the reason why they can't be posted (null: they can)."""
    a = accounts.select(F.col("id").alias("_a"), "type", F.col("bank").alias("_bank"), "label")
    t = txns.where(F.col("transaction_date") > F.lit(cutover).cast("date")).join(a, F.col("account_id") == F.col("_a"), "left").withColumn("commodity", normalized_commodity(F.col("currency")))
    r = fx_as_of(t.select("id", F.col("commodity").alias("currency"), "transaction_date"), rates).select(F.col("id").alias("_f"), "rate")
    priced = rates.select(F.col("currency").alias("_p")).distinct()
    t = t.join(r, F.col("id") == F.col("_f"), "left").join(priced, F.col("commodity") == F.col("_p"), "left")
    reason = F.when(F.col("account_id").isNull(), "orphan").when(F.col("_a").isNull(), "unknown_account").when(F.col("commodity").isNull(), "invalid_currency").when(
        (F.col("commodity") != "INR") & F.col("_p").isNull(), "non_inr").when((F.col("commodity") != "INR") & F.col("rate").isNull(), "missing_fx_rate").when(
        (F.col("category") == "credit_card_payment") & (F.col("type") == "credit_card"), "card_side_payment")
    return t.withColumn("reason", reason).withColumn("own_account", account_name(F.col("type"), F.col("_bank"), F.col("label"))).withColumn("contra", contra_account(F.col("category")))


def postings(rows: DataFrame) -> DataFrame:
    """Two postings an entry; every entry adds up to nothing in each commodity."""
    sign = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    legs = F.array(F.struct(F.lit(0).alias("leg"), F.col("own_account").alias("account"), sign.alias("amount")), F.struct(F.lit(1).alias("leg"), F.col("contra").alias("account"), (-sign).alias("amount")))
    return rows.where("reason is null").select("id", F.col("transaction_date").alias("date"), "commodity", F.explode(legs).alias("p")).select("id", "date", "p.leg", "p.account", "commodity", paise(F.col("p.amount")).alias("amount_paise"))


def balances(posted: DataFrame) -> DataFrame:
    return posted.groupBy("account", "commodity").agg(F.sum("amount_paise").cast("bigint").alias("balance_paise"), F.count(F.lit(1)).cast("bigint").alias("n"))


def skipped(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def opening_balances(accounts: DataFrame, snapshots: DataFrame, txns: DataFrame, cutover: str) -> DataFrame:
    """The newest balance on or before the cutover (used if it is in rupees), else the newest running balance; what is owed is negative."""
    day = F.lit(cutover).cast("date")
    s = snapshots.where((F.col("as_of_date") <= day) & (F.col("currency") == "INR") & F.col("account_id").isNotNull()).groupBy(F.col("account_id").alias("_s")).agg(F.max_by("value", F.struct("as_of_date", "id")).alias("snap"))
    r = txns.where((F.col("transaction_date") <= day) & F.col("balance").isNotNull()).groupBy(F.col("account_id").alias("_t")).agg(F.max_by("balance", F.struct("transaction_date", "id")).alias("running"))
    out = accounts.join(s, F.col("id") == F.col("_s"), "left").join(r, F.col("id") == F.col("_t"), "left")
    value = F.coalesce(F.col("snap").cast("decimal(16,2)"), F.col("running").cast("decimal(16,2)"))
    return out.where(value.isNotNull()).select(F.col("id").alias("account_id"), paise(F.when(F.col("type") == "credit_card", -value).otherwise(value)).alias("opening_paise"), F.when(F.col("snap").isNotNull(), "snapshot").otherwise("running").alias("origin"))


def valuation_deltas(snapshots: DataFrame) -> DataFrame:
    """Changes of each portfolio's value between its dates (newest row of a date, foreign ones count as nothing); no zero changes."""
    v = snapshots.where("portfolio_key is not null").groupBy("portfolio_key", "as_of_date").agg(F.max_by(F.struct("value", "currency"), "id").alias("s"))
    v = v.select("portfolio_key", "as_of_date", F.when(F.col("s.currency") == "INR", F.col("s.value")).otherwise(F.lit(0)).cast("decimal(16,2)").alias("value"))
    delta = F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("portfolio_key").orderBy("as_of_date")), F.lit(0).cast("decimal(16,2)"))
    return v.withColumn("delta", delta).where("delta <> 0").select("portfolio_key", "as_of_date", paise(F.col("delta")).alias("delta_paise"))


def journal_lines(posted: DataFrame) -> DataFrame:
    """Text of each posting: account padded to a column, amount with two places and the commodity."""
    whole = F.format_string("    %-48s %s %s", F.col("account"), (F.col("amount_paise").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string"), F.col("commodity"))
    return posted.select("id", "leg", whole.alias("line"))
