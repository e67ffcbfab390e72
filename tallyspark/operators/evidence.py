"""Evidence tests between statement rows, messages and stored rows, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import normalize_counterparty, paise, parse_amount

# Endings of message types that report a card payment received.
PAYMENT_SUFFIXES = ["_cc_bill_paid", "_cc_bill_paid_alert", "_cc_credit_alert", "_cc_payment", "_cc_payment_alert", "_cc_payment_received_alert", "_cc_repayment_received_alert", "_cc_upi_payment_alert", "sbi_payment_ack"]
#: References shorter than this are no evidence inside a text.
SHORTEST_REFERENCE = 6


def is_payment_received(email_type: Column) -> Column:
    return F.coalesce(email_type.rlike("(" + "|".join(PAYMENT_SUFFIXES) + ")$"), F.lit(False))


def settles_statement(txns: DataFrame) -> DataFrame:
    """Rows that may settle an open card statement."""
    return txns.where((F.col("direction") == "credit") & F.col("account_id").isNotNull() & is_payment_received(F.col("email_type")))


def reference_in(reference: Column, text: Column) -> Column:
    """Whether a reference stands in a text with no letter or digit next to it; references are letters and digits here, others never fit."""
    ok = reference.rlike(f"^[A-Za-z0-9]{{{SHORTEST_REFERENCE},}}$")
    return F.coalesce(ok & F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9])"), F.when(ok, reference).otherwise("-"), F.lit("(?![A-Za-z0-9])"))), F.lit(False))


def significant_tokens(text: Column, leave_out: list[str]) -> Column:
    """Distinct words of four letters or more, in capitals, without those listed."""
    return F.array_except(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.upper), F.array(*[F.lit(w) for w in leave_out]).cast("array<string>"))


def compatible(stmt_ref: Column, stmt_text: Column, stmt_balance: Column, stmt_channel: Column, ref: Column, text: Column, balance: Column, channel: Column, shifted: Column, leave_out: list[str]) -> Column:
    """Whether a stored row can be a statement's: equal references; no contradicting balances and a reference missing; or, on the
    same date, one reference inside the other's text or (both UPI) a distinctive word in common."""
    both = F.coalesce(stmt_ref != "", F.lit(False)) & F.coalesce(ref != "", F.lit(False))
    shared = (stmt_channel == "upi") & (channel == "upi") & F.arrays_overlap(significant_tokens(text, leave_out), significant_tokens(stmt_text, leave_out))
    return F.when(both & (stmt_ref == ref), True).when(F.coalesce(stmt_balance != balance, F.lit(False)), False).when(~both, True).when(shifted, False).otherwise(
        reference_in(ref, stmt_text) | reference_in(stmt_ref, text) | F.coalesce(shared, F.lit(False)))


def shortened_reference(a: Column, b: Column) -> Column:
    """Whether one reference is the other's beginning or end, four characters at least."""
    x, y = (F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "") for c in (a, b))
    return (F.least(F.length(x), F.length(y)) >= 4) & (x.startswith(y) | y.startswith(x) | x.endswith(y) | y.endswith(x))


def half_of_day(time_s: Column, date: Column, received_s: Column) -> Column:
    """Seconds of the day of a 12-hour time: of its two readings the one nearest before the message's arrival (at most five
    minutes after it or twelve hours before); unchanged where neither fits.  ``received_s``: local seconds since 1970."""
    hour, base = F.floor(time_s / 3600), F.unix_date(date).cast("bigint") * 86400
    am = F.when(hour == 12, time_s - 43200).otherwise(time_s)
    options = F.transform(F.array(am, am + 43200), lambda t: F.struct(F.abs(base + t - received_s).alias("gap"), t.alias("t"), (base + t - received_s).alias("d")))
    fits = F.filter(options, lambda o: (o["d"] <= 300) & (o["d"] >= -43200))
    best = F.array_min(F.transform(fits, lambda o: F.struct(o["gap"].alias("gap"), o["t"].alias("t"))))
    return F.when(hour.between(1, 12), F.coalesce(best["t"], time_s)).otherwise(time_s)


def similar_examples(txns: DataFrame, targets: DataFrame, window: int = 200, most: int = 5) -> DataFrame:
    """(target, id) of up to ``most`` trusted rows of the target's direction among the newest ``window``, whose counterparty
    contains the target's or stands in it, newest first.  Both windows are the feature; ids break ties."""
    trusted = txns.where(F.col("category").isNotNull() & F.col("category_method").isin("manual", "rule"))
    recent = None
    for d in ("credit", "debit"):
        part = trusted.where(F.col("direction") == d).select("id", "direction", "created_at", normalize_counterparty(F.col("counterparty")).alias("cp")).orderBy(F.desc("created_at"), F.desc("id")).limit(window)
        recent = part if recent is None else recent.unionByName(part)
    t = targets.select("target", F.col("direction").alias("_d"), normalize_counterparty(F.col("counterparty")).alias("_cp")).where("_cp <> ''")
    hit = F.broadcast(recent.where("cp <> ''")).join(t, (F.col("direction") == F.col("_d")) & (F.col("cp").contains(F.col("_cp")) | F.col("_cp").contains(F.col("cp"))))
    w = Window.partitionBy("target").orderBy(F.desc("created_at"), F.desc("id"))
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("target", "id", F.col("r").alias("place"))


def card_snapshots(uploads: DataFrame) -> DataFrame:
    """Balances that card statements emit: nothing owed where paid or not positive, else what is left, dated at creation."""
    due = parse_amount(F.col("total_amount_due"))
    value = F.when((F.col("payment_status") == "paid") | (due <= 0), 0).otherwise(F.greatest(due - F.coalesce("payment_paid_amount", F.lit(0)), F.lit(0)))
    return uploads.where(due.isNotNull()).select("account_id", F.lit("liability").alias("kind"), F.lit("cc_outstanding").alias("category"), F.col("created_on").alias("as_of_date"), paise(value.cast("decimal(16,2)")).alias("value_paise"), "id")


def default_cards(accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """A primary card for card accounts with a number and without any card."""
    bare = accounts.where((F.col("type") == "credit_card") & (F.coalesce("account_number", F.lit("")) != ""))
    return bare.join(cards.select(F.col("account_id").alias("_a")), F.col("id") == F.col("_a"), "left_anti").select(F.col("id").alias("account_id"), F.col("account_number").alias("card_mask"), F.lit("self").alias("label"), F.lit(True).alias("is_primary"))


def self_transfer_verdicts(txns: DataFrame) -> DataFrame:
    """Each self-transfer row: paired, or why not (no reference, legs, amount or currency mismatch, account)."""
    own = txns.where(F.col("category") == "self_transfer").withColumn("ref", F.nullif(F.trim(F.coalesce("reference_number", F.lit(""))), F.lit("")))
    cur = F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("INR"))
    g = own.where("ref is not null").groupBy("ref").agg(F.count_if(F.col("direction") == "debit").alias("d"), F.count_if(F.col("direction") == "credit").alias("c"), F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.min(cur).alias("c1"), F.max(cur).alias("c2"), F.bool_and(F.col("account_id").isNotNull()).alias("known")).withColumnRenamed("ref", "_r")
    why = F.when(F.col("ref").isNull(), "no_reference").when((F.col("d") != 1) | (F.col("c") != 1), "legs").when(F.col("lo") != F.col("hi"), "amount_mismatch").when(F.col("c1") != F.col("c2"), "currency_mismatch").when(~F.col("known"), "account").otherwise("paired")
    return own.join(g, F.col("ref") == F.col("_r"), "left").select("id", why.alias("verdict"))


def price_directives(rows: DataFrame) -> DataFrame:
    """One (date, commodity, rate) for each priced foreign row's date."""
    own = rows.where((F.col("commodity") != "INR") & F.col("rate").isNotNull() & F.col("reason").isNull())
    return own.groupBy(F.col("transaction_date").alias("date"), "commodity").agg(F.max("rate").alias("rate"))


def scope_completeness(rows: DataFrame) -> DataFrame:
    """How much of each account is projected: none, excluded, partial or included."""
    g = rows.where("account_id is not null").groupBy("account_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(F.col("reason").isNull()).cast("bigint").alias("posted"))
    return g.select("account_id", "n", "posted", F.when(F.col("posted") == 0, "excluded").when(F.col("posted") < F.col("n"), "partial").otherwise("included").alias("scope"))


def card_of_payment(payments: DataFrame, cards: DataFrame) -> DataFrame:
    """The liability that a bank-side card payment names: its exact mask if one card has it, else ambiguous or unresolved."""
    masks = cards.groupBy(F.trim("card_mask").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), F.max("account_id").alias("card_account"))
    j = payments.join(masks, F.trim("card_mask") == F.col("_m"), "left")
    return j.select("id", F.when(F.col("_n") == 1, F.col("card_account")).alias("card_account"), F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous_mask").otherwise("unresolved").alias("status"))


def holdings_of(documents: DataFrame, key: str) -> DataFrame:
    """Holdings of nested documents (``accounts`` with ``holdings``, ``folios`` with ``schemes``), numbered within (scope, source, instrument)."""
    demat = documents.select(key, F.posexplode("accounts").alias("p", "a")).select(key, "p", F.col("a.source_ref").alias("source_ref"), F.posexplode("a.holdings").alias("q", "h"))
    folio = documents.select(key, F.posexplode("folios").alias("p", "a")).select(key, "p", F.col("a.source_ref").alias("source_ref"), F.posexplode("a.schemes").alias("q", "h"))
    both = demat.select(key, F.lit("demat").alias("scope"), "source_ref", "p", "q", F.col("h.isin").alias("isin"), F.col("h.quantity").alias("quantity"), F.col("h.value").alias("value")).unionByName(
        folio.select(key, F.lit("folio").alias("scope"), "source_ref", "p", "q", F.col("h.isin").alias("isin"), F.col("h.units").alias("quantity"), F.col("h.value").alias("value")))
    own = both.where(F.trim(F.coalesce("isin", F.lit(""))) != "").withColumn("instrument", F.upper(F.trim("isin")))
    w = Window.partitionBy(key, "scope", "source_ref", "instrument").orderBy("p", "q")
    return own.withColumn("occurrence", F.row_number().over(w) - 1).select(key, "scope", "source_ref", "instrument", "occurrence", F.col("quantity").try_cast("decimal(20,6)").alias("quantity"), F.col("value").try_cast("decimal(16,2)").alias("value"))
