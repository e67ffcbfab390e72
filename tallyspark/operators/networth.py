"""Net worth: the latest balance of each source, current totals and groups, a forward-filled monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import month_key, paise
from tallyspark.functions.vocabulary import STALE_DAYS
from tallyspark.operators import evidence, uploads


def source_key() -> Column:
    """Account and category, else portfolio and category, else manual item (all rows without any share one)."""
    return F.when(F.col("account_id").isNotNull(), F.concat_ws("|", F.lit("acct"), F.col("account_id"), F.col("category"))).when(
        F.col("portfolio_key").isNotNull(), F.concat_ws("|", F.lit("inv"), F.col("portfolio_key"), F.col("category"))).otherwise(F.concat_ws("|", F.lit("man"), F.col("manual_item_id")))


def active_snapshots(snapshots: DataFrame, accounts: DataFrame, items: DataFrame) -> DataFrame:
    """Snapshots whose account or manual item isn't switched off; a missing parent keeps account-less rows only."""
    a = accounts.select(F.col("id").alias("_a"), F.col("active").alias("_aa"), F.col("label").alias("account_label"))
    m = items.select(F.col("id").alias("_m"), F.col("active").alias("_ma"), F.col("name").alias("item_name"))
    out = snapshots.join(a, F.col("account_id") == F.col("_a"), "left").join(m, F.col("manual_item_id") == F.col("_m"), "left")
    return out.where(F.coalesce("_aa", F.lit(True)) & F.coalesce("_ma", F.lit(True))).drop("_a", "_aa", "_m", "_ma")


def current(snapshots: DataFrame, accounts: DataFrame, items: DataFrame, uploads: DataFrame, today: str) -> DataFrame:
    """Each source's latest balance by (as_of_date, id); the currency is tested on the winner, so a newer foreign row hides its source."""
    day = F.lit(today).cast("date")
    own = active_snapshots(snapshots, accounts, items).where(F.col("as_of_date") <= day)
    w = Window.partitionBy("source").orderBy(F.col("as_of_date").desc(), F.col("id").desc())
    best = own.withColumn("source", source_key()).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("currency") == "INR"))
    u = uploads.select(F.col("id").alias("_u"), "portfolio_ok", "investor_name")
    best = best.join(u, F.col("cas_upload_id") == F.col("_u"), "left")
    limit = F.coalesce(*[F.when(F.col("category") == c, F.lit(d)) for c, d in STALE_DAYS.items()], F.lit(9999))
    return best.select(
        "source", "id", F.coalesce("account_label", "item_name", "investor_name", "portfolio_key", F.lit("Unknown")).alias("label"), "category", "kind", paise(F.col("value")).alias("value_paise"), "as_of_date",
        (F.datediff(day, F.col("as_of_date")) > limit).alias("stale"), F.coalesce(F.col("_u").isNotNull() & ~F.col("portfolio_ok"), F.lit(False)).alias("unreconciled"))


def totals(rows: DataFrame) -> DataFrame:
    value = F.col("value_paise")
    out = rows.agg(F.coalesce(F.sum(F.when(F.col("kind") == "asset", value)), F.lit(0)).cast("bigint").alias("assets"), F.coalesce(F.sum(F.when(F.col("kind") == "liability", value)), F.lit(0)).cast("bigint").alias("liabilities"), F.coalesce(F.bool_or("stale"), F.lit(False)).alias("has_stale"))
    return out.withColumn("net_worth", F.col("assets") - F.col("liabilities"))


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "kind").agg(F.sum("value_paise").cast("bigint").alias("total_paise"), F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if("stale").cast("bigint").alias("stale"))


def breakdown(rows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Holdings of the current investment snapshots by asset class and label."""
    ids = rows.where(F.col("category") == "investment").select(F.col("id").alias("_s"))
    return holdings.join(ids, F.col("snapshot_id") == F.col("_s"), "left_semi").groupBy("asset_class", "label").agg(paise(F.sum("value")).alias("value_paise"))


def monthly_trend(snapshots: DataFrame, accounts: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """Net worth at each month's end from the first balance on, balances carried forward.

    A balance counts from its month until its source's next one: each contributes a step at its start and one back at its
    successor's, so the series is one running sum over months and no source is spread over the months it is unchanged."""
    day = F.lit(today).cast("date")
    own = active_snapshots(snapshots, accounts, items).where(F.col("as_of_date") <= day).withColumn("source", source_key()).withColumn("m", F.trunc("as_of_date", "MM"))
    last = own.groupBy("source", "m").agg(F.max_by(F.struct("kind", "value", "currency"), F.struct("as_of_date", "id")).alias("s"))
    signed = F.when(F.col("s.currency") != "INR", F.lit(0)).when(F.col("s.kind") == "asset", F.col("s.value")).when(F.col("s.kind") == "liability", -F.col("s.value")).otherwise(F.lit(0)).cast("decimal(16,2)")
    steps = last.withColumn("v", signed).withColumn("before", F.coalesce(F.lag("v").over(Window.partitionBy("source").orderBy("m")), F.lit(0).cast("decimal(16,2)")))
    monthly = steps.groupBy("m").agg(F.sum(F.col("v") - F.col("before")).alias("step"))
    spine = own.agg(F.min("m").alias("first")).where("first is not null").select(F.explode(F.sequence("first", F.trunc(day, "MM"), F.expr("interval 1 month"))).alias("m"))
    filled = spine.join(monthly, "m", "left")
    running = F.sum(F.coalesce("step", F.lit(0).cast("decimal(16,2)"))).over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    return filled.select(month_key(F.col("m")).alias("month"), paise(running).alias("value_paise"))


def backfill(bank_uploads: DataFrame, card_uploads: DataFrame) -> DataFrame:
    """The balances of all stored statements, bank and card: one for each account, category and date (the newest upload's)."""
    cards = evidence.card_snapshots(card_uploads).groupBy("account_id", "kind", "category", "as_of_date").agg(F.max_by("value_paise", "id").alias("value_paise"))
    return uploads.bank_snapshots(bank_uploads).drop("upload_id").unionByName(cards)


def grouped(rows: DataFrame) -> DataFrame:
    """Sources of each category and kind as an array, by label without regard to case, then id."""
    sort = F.array_sort(F.collect_list(F.struct(F.lower("label").alias("low"), F.col("id").alias("id"), F.col("label").alias("label"))))
    return rows.groupBy("category", "kind").agg(sort.alias("rows")).orderBy("category", "kind")


def holdings_by_class(snapshots: DataFrame, holdings: DataFrame, total: Column) -> DataFrame:
    """Value of each asset class; what a snapshot's total has beyond its holdings is of class other."""
    held = holdings.groupBy(F.col("snapshot_id").alias("_s")).agg(F.sum("value").alias("held"))
    rest = snapshots.join(held, F.col("id") == F.col("_s")).select(F.lit("other").alias("asset_class"), (total - F.col("held")).cast("decimal(20,2)").alias("v")).where("v > 0")
    return holdings.select("asset_class", F.col("value").cast("decimal(20,2)").alias("v")).unionByName(rest).groupBy("asset_class").agg(paise(F.sum("v")).alias("value_paise"))


def manual_history(snapshots: DataFrame) -> DataFrame:
    """Values of each manual item as an array, newest first."""
    return snapshots.where("manual_item_id is not null").groupBy(F.col("manual_item_id").alias("item")).agg(F.sort_array(F.collect_list(F.struct("as_of_date", "id", "value")), False).alias("history"))
