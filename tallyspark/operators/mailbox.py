"""E-mails and text messages beside their rules and transactions: listings, links, gates and what becomes of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.listing import bounded_text

#: Links of a kind that an e-mail shows.
MOST_LINKS = 10
# Roles whose credits are announced but not booked, and the direction of a declined payment.
NOTIFY_ONLY, DECLINED = ["provisional", "restatement"], "declined"


def summaries(emails: DataFrame, most: int = 80) -> DataFrame:
    """E-mails with the error text cut to ``most`` characters and a flag where it was longer."""
    text, cut = bounded_text(F.col("error"), most)
    return emails.select("id", "rule_id", "status", "received_at", text.alias("error"), cut.alias("error_truncated"))


def with_rules(emails: DataFrame, rules: DataFrame, bank: str | None = None) -> DataFrame:
    """E-mails with their rule's bank; with ``bank`` only those whose rule is of it, else also those without a rule."""
    r = rules.select(F.col("id").alias("_r"), F.col("bank").alias("rule_bank"))
    if bank is not None:
        r = r.where(F.col("rule_bank") == bank)
    return emails.join(r, F.col("rule_id") == F.col("_r"), "left" if bank is None else "inner").drop("_r")


def with_transactions(messages: DataFrame, txns: DataFrame) -> DataFrame:
    """Messages with the transaction they name (by their own reference, not the transaction's); dangling ones stay."""
    t = txns.select(F.col("id").alias("_t"), F.col("amount").alias("txn_amount"), F.col("bank").alias("txn_bank"))
    return messages.join(t, F.col("transaction_id") == F.col("_t"), "left").drop("_t")


def having_transaction(emails: DataFrame, links: DataFrame, where: Column) -> DataFrame:
    """E-mails of which one linked transaction meets the whole condition."""
    hit = links.where(where & F.col("email_id").isNotNull()).select(F.col("email_id").alias("_e"))
    return emails.join(hit, F.col("id") == F.col("_e"), "left_semi")


def first_links(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """Ids linked to each e-mail in their order, ``most`` at most (which is the feature), and whether there are more."""
    w = Window.partitionBy("email_id").orderBy("id")
    near = links.where("email_id is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    g = near.groupBy("email_id").agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    return g.select("email_id", F.slice("_ids", 1, most).alias("ids"), (F.size("_ids") > most).alias("truncated"))


def stored_once(arrivals: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Arrivals with their code: 201 for the first of equal keys, 204 for a duplicate (nulls are equal to each other)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return arrivals.withColumn("code", F.when(n == 1, 201).otherwise(204).cast("bigint"))


def message_outcome(role: Column, direction: Column, settle: Column) -> Column:
    """What a parsed text message becomes: declined payments and credits that are only announced make no row; ``settle``
    lifts that gate for a provisional one alone."""
    gated = F.coalesce(role.isin(NOTIFY_ONLY), F.lit(False)) & (direction == "credit") & ~(settle & F.coalesce(role == "provisional", F.lit(False)))
    return F.when(gated, "notify_only").when(direction == DECLINED, "declined").otherwise("merge")


def next_status(status: Column, parsed: Column, matched: Column, outcome: Column, error: Column) -> Column:
    """The state of a message after its parse: failed with an error, skipped where no parser read it, enriched where it
    met a stored row, parsed otherwise; only pending and failed messages move."""
    moved = F.when(error.isNotNull(), "failed").when(~parsed, "skipped").when((outcome == "merge") & matched, "enriched").otherwise("parsed")
    return F.when(status.isin("pending", "failed"), moved).otherwise(status)


def failed_again(emails: DataFrame, rules: DataFrame) -> DataFrame:
    """Failed e-mails to be read again with the bank of their rule; those whose rule is gone are told apart."""
    out = with_rules(emails.where("status = 'failed'"), rules)
    return out.select("id", "rule_bank", F.when(F.col("rule_bank").isNull(), "no_rule").otherwise("reparse").alias("action"))


def counters(emails: DataFrame, messages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: e-mails, failed ones, text messages that wait or failed, enabled rules."""
    e = emails.agg(F.count(F.lit(1)).cast("bigint").alias("emails"), F.count_if(F.col("status") == "failed").cast("bigint").alias("failed_emails"))
    m = messages.agg(F.count_if(F.col("status").isin("pending", "error")).cast("bigint").alias("open_messages"))
    r = rules.agg(F.count_if(F.coalesce("enabled", F.lit(False))).cast("bigint").alias("enabled_rules"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(e).join(one(m), "_one").join(one(r), "_one").drop("_one")


def sender_fits(rule_sender: Column, sender: Column) -> Column:
    """Whether a rule's sender is the message's: an address must be the sender's address (in angle brackets or bare), other
    text stands in it; an empty rule fits all; case counts nowhere."""
    rule, own = F.lower(F.trim(F.coalesce(rule_sender, F.lit("")))), F.lower(F.coalesce(sender, F.lit("")))
    bare = F.trim(F.when(own.rlike(r"<[^<>]*>\s*$"), F.regexp_extract(own, r"<([^<>]*)>\s*$", 1)).otherwise(own))
    return F.when(rule == "", True).when(rule.rlike(r"^[^@\s]+@[^@\s]+$"), bare == rule).otherwise(own.contains(rule))


def rule_of_sender(emails: DataFrame, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """(email, rule) by sender and subject.  Rules are a table that people edit: it is sent to all tasks only up to
    ``most_rules`` rows."""
    r = rules.select(F.col("id").alias("_r"), F.col("sender").alias("_rs"), F.lower(F.trim(F.coalesce("subject", F.lit("")))).alias("_rj"))
    small = F.broadcast(r) if r.limit(most_rules + 1).count() <= most_rules else r
    hit = emails.join(small, sender_fits(F.col("_rs"), F.col("sender")) & F.lower(F.coalesce("subject", F.lit(""))).contains(F.col("_rj")))
    return hit.select(F.col("id").alias("email_id"), F.col("_r").alias("rule_id"))


def announcements(outcomes: DataFrame, batch: str, most: int = 5) -> DataFrame:
    """How a batch of booked messages is announced: each by itself up to ``most``, else as one summary."""
    n = F.count(F.lit(1)).over(Window.partitionBy(batch))
    return outcomes.withColumn("announce", F.when(n > most, "summary").otherwise("single"))
