"""Categorization: rule cascade, merchant rules, polarity guard and reference-pair self-transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import has_marker, is_small, mask_digits, normalize_counterparty, normalize_text
from tallyspark.functions.vocabulary import CARD_IMPOSSIBLE, CARD_PAYMENT_MARKERS, CARD_REFUND_MARKERS, EXPENSE_SLUGS, FEE_REVERSAL_MARKERS, INCOME_SLUGS
from tallyspark.operators.substrings import containing


def is_fd(counterparty: Column, bank: Column) -> Column:
    """The parser's fixed-deposit label: the row's own bank and ' FD'."""
    b = F.lower(F.trim(F.coalesce(bank, F.lit(""))))
    return (b != "") & (F.lower(F.trim(F.coalesce(counterparty, F.lit("")))) == F.concat(b, F.lit(" fd")))


def narration() -> Column:
    return normalize_text(F.concat_ws(" ", F.when(F.col("counterparty") != "", F.col("counterparty")), F.when(F.col("raw_description") != "", F.col("raw_description"))))


def merchant_match(txns: DataFrame, rules: DataFrame, few: int = 1_000) -> DataFrame:
    """The first rule by (priority, longest pattern, id) that stands in a row's narration and that its direction allows.

    Up to ``few`` rules are sent to all tasks and tested against every row; more are found by an index of their q-grams.  The
    best one is kept by an aggregate, not by sorting the pairs."""
    r = rules.where("active").select("id", F.lower(F.trim("pattern")).alias("pattern"), F.col("category").alias("rule_category"), "priority").where("pattern <> ''").withColumnRenamed("id", "rule_id")
    spent = F.col("text").contains("spent on") & F.col("text").contains("credit card") & (F.col("rule_category") == "credit_card_payment")
    wrong = ((F.col("direction") == "credit") & F.col("rule_category").isin(EXPENSE_SLUGS)) | ((F.col("direction") == "debit") & F.col("rule_category").isin(INCOME_SLUGS))
    rows = txns.select(F.col("id"), F.lower(F.coalesce("direction", F.lit(""))).alias("direction"), narration().alias("text"))
    hits = rows.join(F.broadcast(r), F.col("text").contains(F.col("pattern"))) if is_small(r, few) else containing(rows, "text", r, "pattern")
    hits = hits.where(~spent & ~wrong)
    best = hits.groupBy("id", "direction").agg(F.min_by(F.struct("rule_id", "rule_category"), F.struct("priority", -F.length("pattern"), "rule_id")).alias("b"))
    slug = F.when((F.col("b.rule_category") == "investment") & (F.col("direction") == "credit"), "investment_redemption").otherwise(F.col("b.rule_category"))
    return best.select("id", F.col("b.rule_id").alias("rule_id"), slug.alias("merchant_slug"))


def categorize(txns: DataFrame, accounts: DataFrame, rules: DataFrame, self_tokens: tuple[str, ...] = ("self",)) -> DataFrame:
    """id, slug and confidence of the first rule that fires (null: none)."""
    kinds = accounts.select(F.col("id").alias("_a"), F.col("type").alias("account_type"))
    hits = merchant_match(txns, rules).select(F.col("id").alias("_m"), "merchant_slug")
    t = txns.join(kinds, F.col("account_id") == F.col("_a"), "left").join(hits, F.col("id") == F.col("_m"), "left")
    text, direction, email = narration(), F.lower(F.coalesce("direction", F.lit(""))), F.lower(F.coalesce("email_type", F.lit("")))
    credit = direction == "credit"
    card_credit = credit & F.coalesce(F.col("account_type") == "credit_card", F.lit(False))
    cp = normalize_counterparty(F.col("counterparty"))
    own_name = F.lit(False)
    for token in self_tokens:
        own_name = own_name | cp.contains(token)
    steps = [
        (is_fd(F.col("counterparty"), F.col("bank")), F.when(credit, "investment_redemption").otherwise("investment"), 0.95),
        ((F.lower(F.coalesce("channel", F.lit(""))) == "interest") & (direction != "debit"), F.lit("interest"), 1.0),
        (email.contains("cc_refund"), F.lit("refund"), 0.9),
        (email.contains("cc_payment") | email.contains("cc_bill_paid") | email.contains("cc_smartpay"), F.lit("credit_card_payment"), 0.95),
        (credit & has_marker(text, FEE_REVERSAL_MARKERS), F.lit("fees_charges"), 0.9),
        (card_credit & has_marker(text, CARD_REFUND_MARKERS), F.lit("refund"), 0.9),
        (card_credit & (has_marker(text, CARD_PAYMENT_MARKERS) | text.startswith("payment ")), F.lit("credit_card_payment"), 0.95),
        (F.col("merchant_slug").isNotNull(), F.col("merchant_slug"), 0.9),
        (own_name, F.lit("self_transfer"), 0.9),
        (card_credit, F.lit("credit_card_payment"), 0.7),
    ]
    slug, confidence = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], F.lit(steps[0][2]))
    for when, value, sure in steps[1:]:
        slug, confidence = slug.when(when, value), confidence.when(when, F.lit(sure))
    return t.select("id", slug.alias("slug"), confidence.cast("double").alias("confidence"))


def guard_polarity(slug: Column, direction: Column, account_type: Column) -> Column:
    """The slug that a direction allows: impossible and unknown ones become the direction's default."""
    card = F.coalesce(account_type == "credit_card", F.lit(False))
    return F.when((direction == "debit") & (slug.isin(INCOME_SLUGS) | (slug == "unknown")), "expense").when(
        (direction == "credit") & card & (slug.isin(EXPENSE_SLUGS + CARD_IMPOSSIBLE) | (slug == "unknown")), "credit_card_payment").when(
        (direction == "credit") & ~card & (slug.isin(EXPENSE_SLUGS) | (slug == "unknown")), "repayment").otherwise(slug)


def reference_self_transfers(txns: DataFrame) -> DataFrame:
    """Ids of rows that share an exact reference with one of the opposite direction on a provably different account."""
    legs = txns.where(F.col("direction").isin("credit", "debit") & (F.trim(F.coalesce("reference_number", F.lit(""))) != "") & ~is_fd(F.col("counterparty"), F.col("bank")))
    legs = legs.select("id", "direction", "account_id", mask_digits(F.col("account_mask")).alias("digits"), "reference_number")
    a, b = legs.alias("a"), legs.alias("b")
    x, y = F.col("a.digits"), F.col("b.digits")
    by_mask = (F.length(x) >= 3) & (F.length(y) >= 3) & ~x.endswith(y) & ~y.endswith(x)
    apart = F.when(F.col("a.account_id").isNotNull() & F.col("b.account_id").isNotNull(), F.col("a.account_id") != F.col("b.account_id")).otherwise(by_mask)
    return a.join(b, (F.col("a.reference_number") == F.col("b.reference_number")) & (F.col("a.direction") != F.col("b.direction")) & apart, "left_semi").select("id")


def paired_legs(txns: DataFrame) -> DataFrame:
    """Self-transfer pairs: exactly one debit and one credit of category self_transfer under a trimmed reference."""
    own = txns.where((F.col("category") == "self_transfer") & (F.trim(F.coalesce("reference_number", F.lit(""))) != ""))
    g = own.groupBy(F.trim("reference_number").alias("reference")).agg(
        F.count_if(F.col("direction") == "debit").alias("d"), F.count_if(F.col("direction") == "credit").alias("c"), F.count(F.lit(1)).alias("all"),
        F.max(F.when(F.col("direction") == "debit", F.col("id"))).alias("debit_id"), F.max(F.when(F.col("direction") == "credit", F.col("id"))).alias("credit_id"))
    return g.where("d = 1 and c = 1 and all = 2").select("reference", "debit_id", "credit_id")


def needs_work(txns: DataFrame, most: int) -> DataFrame:
    """The oldest rows without a final category."""
    return txns.where(F.col("category_method").isNull() | (F.col("category_method") == "pending_llm") | ((F.col("category_method") == "llm") & (F.col("category") == "unknown"))).select("id", "category_method").orderBy("id").limit(most)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
