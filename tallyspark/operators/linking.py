"""Linking transactions to accounts and cards by masks.

Masks agree by position from the right, so an equi-join needs a key: a usable mask has at least three trailing digits,
and two masks that agree share those last three unless the stored one hides some there.  Stored masks are therefore
joined on (bank, last three characters).  Those with a wildcard among them are sent to all tasks if there are few; many are
joined by an index of visible positions: masks come in few shapes (which positions show a digit), and for each pair of shapes
two masks that agree have equal digits where both show one.  The exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.expressions import is_small, mask_matches, normalize_mask, trailing_digits


def _usable(mask: Column) -> Column:
    return trailing_digits(mask) >= 3


def mask_candidates(masks: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, bank_key, mask) joined with stored (bank_key, stored, ...) where the masks agree; only usable masks ask."""
    ask = masks.where(_usable(F.col("mask"))).withColumn("k", F.right(F.col("mask"), F.lit(3)))
    keyed = stored.where("stored <> ''").withColumn("sk", F.when(trailing_digits(F.col("stored")) >= 3, F.right(F.col("stored"), F.lit(3))))
    exact = ask.join(keyed.where("sk is not null").withColumnRenamed("bank_key", "sb"), (F.col("bank_key") == F.col("sb")) & (F.col("k") == F.col("sk")))
    few = keyed.where("sk is null").withColumnRenamed("bank_key", "sb")
    loose = ask.join(F.broadcast(few), F.col("bank_key") == F.col("sb")) if is_small(few) else by_shape(ask, few)
    return exact.unionByName(loose).where(mask_matches(F.col("mask"), F.col("stored"))).drop("k", "sk", "sb")


#: Shapes of masks on one side up to which masks meet by shape; each is a probe for every mask of the other side.
SHAPES = 200


def shape(mask: Column) -> Column:
    """Which positions of a mask show a digit."""
    return F.regexp_replace(mask, "[0-9]", "D")


def _shown(mask: Column, other: Column) -> Column:
    """The mask's digits at the positions, from the right, at which it and a mask of the other shape show one."""
    at = F.sequence(F.lit(1), F.greatest(F.least(F.length(mask), F.length(other)), F.lit(1)))
    return F.array_join(F.transform(at, lambda i: F.when((F.substring(other, -i, F.lit(1)) == "D") & (F.substring(mask, -i, F.lit(1)) != "X"), F.substring(mask, -i, F.lit(1))).otherwise("")), "")


def by_shape(ask: DataFrame, stored: DataFrame) -> DataFrame:
    """Masks joined with the stored ones of their bank (``sb``) that show the same digits where both show any.

    The shapes of both sides are collected, ``SHAPES`` of a side at most; with more of them the join is on the bank alone."""
    asked, kept = ([r[0] for r in df.select(shape(F.col(c))).distinct().limit(SHAPES + 1).collect()] for df, c in ((ask, "mask"), (stored, "stored")))
    if len(asked) > SHAPES or len(kept) > SHAPES:
        return ask.join(stored, F.col("bank_key") == F.col("sb"))
    each = lambda shapes: F.explode(F.array(*map(F.lit, shapes)).cast("array<string>"))
    a = ask.withColumn("_with", each(kept)).withColumn("_at", F.concat_ws("|", shape(F.col("mask")), "_with", _shown(F.col("mask"), F.col("_with")))).drop("_with")
    s = stored.withColumn("_with", each(asked)).withColumn("_st", F.concat_ws("|", "_with", shape(F.col("stored")), _shown(F.col("stored"), F.col("_with")))).drop("_with")
    return a.join(s, (F.col("bank_key") == F.col("sb")) & (F.col("_at") == F.col("_st"))).drop("_at", "_st")


def _unique(hits: DataFrame, values: list[str]) -> DataFrame:
    """The only match of each id; several matches are refused."""
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.max(v).alias(v) for v in values]).where("n = 1").drop("n")


def expected_type(email_type: Column) -> Column:
    e = F.lower(F.coalesce(email_type, F.lit("")))
    return F.when(e.contains("_cc_"), "credit_card").when(e.contains("_dc_"), "debit_card").when(e.contains("_account_"), "bank_account")


def link(txns: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """id, account_id, card_id and the step that linked each row: linked before, card, card_account, account, bank or null.

    Steps go in that order, each one takes a unique match only, and an ambiguous step falls through to the next."""
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    acc = accounts.select(F.col("id").alias("hit_account"), key(F.col("bank")).alias("bank_key"), normalize_mask(F.col("account_number")).alias("stored"), F.col("type").alias("hit_type"))
    card = cards.join(accounts.select(F.col("id").alias("_a"), "bank"), F.col("account_id") == F.col("_a")).select(F.col("account_id").alias("hit_account"), F.col("id").alias("hit_card"), key(F.col("bank")).alias("bank_key"), normalize_mask(F.col("card_mask")).alias("stored"))
    open_ = txns.where("account_id is null").select("id", key(F.col("bank")).alias("bank_key"), normalize_mask(F.col("card_mask")).alias("cm"), normalize_mask(F.col("account_mask")).alias("am"),
                                                    (F.coalesce("card_mask", F.lit("")) == "").alias("_nc"), (F.coalesce("account_mask", F.lit("")) == "").alias("_na"), expected_type(F.col("email_type")).alias("want"))
    by_card = open_.select("id", "bank_key", F.col("cm").alias("mask"))
    step1 = _unique(mask_candidates(by_card, card), ["hit_account", "hit_card"]).select(F.col("id").alias("i1"), F.col("hit_account").alias("a1"), F.col("hit_card").alias("c1"))
    stored = acc.select("hit_account", "bank_key", "stored")
    step2 = _unique(mask_candidates(by_card, stored), ["hit_account"]).select(F.col("id").alias("i2"), F.col("hit_account").alias("a2"))
    step3 = _unique(mask_candidates(open_.select("id", "bank_key", F.col("am").alias("mask")), stored), ["hit_account"]).select(F.col("id").alias("i3"), F.col("hit_account").alias("a3"))
    # without any mask: the only account of the bank, or of the bank and the type that the message implies
    per_type = acc.groupBy("bank_key", "hit_type").agg(F.count(F.lit(1)).alias("n"), F.max("hit_account").alias("a"))
    per_bank = acc.groupBy("bank_key").agg(F.count(F.lit(1)).alias("n"), F.max("hit_account").alias("a")).withColumn("hit_type", F.lit(None).cast("string"))
    sole = per_type.unionByName(per_bank).where("n = 1").select(F.col("bank_key").alias("bk"), F.col("hit_type").alias("ht"), F.col("a").alias("a4"))
    out = open_.join(step1, F.col("id") == F.col("i1"), "left").join(step2, F.col("id") == F.col("i2"), "left").join(step3, F.col("id") == F.col("i3"), "left")
    out = out.join(sole, (F.col("bank_key") == F.col("bk")) & F.col("want").eqNullSafe(F.col("ht")) & F.col("_nc") & F.col("_na"), "left")
    step = F.when(F.col("a1").isNotNull(), "card").when(F.col("a2").isNotNull(), "card_account").when(F.col("a3").isNotNull(), "account").when(F.col("a4").isNotNull(), "bank")
    found = out.select("id", F.coalesce("a1", "a2", "a3", "a4").alias("account_id"), F.col("c1").alias("card_id"), step.alias("step"))
    before = txns.where("account_id is not null").select("id", "account_id", F.lit(None).cast("bigint").alias("card_id"), F.lit("linked before").alias("step"))
    return found.unionByName(before)
