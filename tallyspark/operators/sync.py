"""Reload policy and diagnosis of a projected ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quiet time, longest wait, periodic reload (seconds), and minutes to wait after failures in a row.
QUIET_S, LONGEST_S, RELOAD_S, BACKOFF_MIN = 5, 30, 6 * 3600, [1, 2, 5, 10, 15]


def backoff_minutes(failures: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in BACKOFF_MIN]), F.greatest(F.lit(1), F.least(failures, F.lit(len(BACKOFF_MIN)))).cast("int"))


def eligibility(state: DataFrame, now: str = "now_s") -> DataFrame:
    """``state`` (next_attempt_s, force, last_attempt_s, desired, applied, first_dirty_s, last_dirty_s) with due and reason."""
    n = F.col(now)
    reason = F.when(F.coalesce(n < F.col("next_attempt_s"), F.lit(False)), "backoff").when(F.col("force"), "force_reload").when(F.coalesce(n - F.col("last_attempt_s") >= RELOAD_S, F.lit(False)), "periodic_reload").when(
        F.col("desired") <= F.col("applied"), "caught_up").when(F.coalesce(n - F.col("first_dirty_s") >= LONGEST_S, F.lit(False)), "max_latency").when(F.coalesce(n - F.col("last_dirty_s") < QUIET_S, F.lit(False)), "debounce").otherwise("dirty")
    return state.withColumn("reason", reason).withColumn("due", ~F.col("reason").isin("backoff", "caught_up", "debounce"))


def expected_reversals(postings: DataFrame) -> DataFrame:
    """How often each (account, date, amount) of a negative expense posting is expected."""
    own = postings.where(F.col("account").startswith("Expenses:") & (F.col("amount_paise") < 0))
    return own.groupBy("account", "date", "amount_paise").agg(F.count(F.lit(1)).cast("bigint").alias("times"))


def parse_finding(details: Column) -> Column:
    """(account, date, amount in paise) of a diagnosis text; nulls where it doesn't follow the template."""
    part = lambda i: F.regexp_extract(details, r"<b>(-?[0-9.]+)</b> got debited from <b>([^<]+)</b> on (\d{2} [A-Z][a-z]{2} \d{4})", i)
    amount = F.nullif(part(1), F.lit("")).try_cast("decimal(16,4)")
    return F.struct(F.nullif(F.trim(part(2)), F.lit("")).alias("account"), F.try_to_date(part(3), "dd MMM yyyy").alias("date"), (amount * 100).cast("bigint").alias("amount_paise"))


def classify_findings(findings: DataFrame, postings: DataFrame) -> DataFrame:
    """accepted or fatal for each finding (id, details): a finding uses up one expected reversal, later ones are fatal."""
    f = findings.withColumn("f", parse_finding(F.col("details"))).select("id", "f.account", "f.date", "f.amount_paise")
    numbered = f.withColumn("n", F.row_number().over(Window.partitionBy("account", "date", "amount_paise").orderBy("id")))
    e = expected_reversals(postings).select(F.col("account").alias("_a"), F.col("date").alias("_d"), F.col("amount_paise").alias("_m"), "times")
    hit = numbered.join(e, (F.col("account") == F.col("_a")) & (F.col("date") == F.col("_d")) & (F.col("amount_paise") == F.col("_m")), "left")
    return hit.select("id", F.when(F.coalesce(F.col("n") <= F.col("times"), F.lit(False)), "accepted").otherwise("fatal").alias("verdict"))


def rolled_up(balances: DataFrame, names: DataFrame) -> DataFrame:
    """The balance of each name: its own account's, else the sum of its direct children's."""
    exact = balances.select(F.col("account").alias("_e"), "commodity", "balance_paise")
    parent = balances.select(F.regexp_replace("account", ":[^:]+$", "").alias("_e"), "commodity", "balance_paise").groupBy("_e", "commodity").agg(F.sum("balance_paise").cast("bigint").alias("children"))
    own = names.join(exact, F.col("name") == F.col("_e"), "left").drop("_e")
    kids = parent.select(F.col("_e"), F.col("commodity").alias("_c"), "children")
    return own.join(kids, (F.col("name") == F.col("_e")) & F.coalesce(F.col("commodity"), F.lit("INR")).eqNullSafe(F.col("_c")), "left").select("name", F.coalesce("commodity", "_c").alias("commodity"), F.coalesce("balance_paise", "children").alias("balance_paise"))
