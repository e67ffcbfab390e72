"""Duplicate matching of incoming messages against stored transactions.

Every path is an equi-join on (bank, direction, amount, currency) or on the reference, with the time window as a range
condition, and a decision by counts over each message's candidates; ambiguity defers.  Messages are matched against the
stored table; ``batches.merge_batch`` merges the messages of one batch in their order.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import mask_digits, mask_matches, normalize_counterparty, normalize_mask, trailing_digits
from tallyspark.operators.evidence import shortened_reference

WINDOW_S, RECEIVED_WINDOW_S = 600, 60


def seconds(date: Column, time: Column) -> Column:
    """Seconds since 1970 of a date and seconds of the day."""
    return F.unix_date(date).cast("bigint") * 86400 + time


def by_reference(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """seq, action (match, defer), reason and id by (bank, direction, trimmed reference); messages without a hit are left out."""
    a = incoming.where(F.trim(F.coalesce("reference_number", F.lit(""))) != "").select("seq", F.col("bank").alias("b"), F.col("direction").alias("d"), F.trim("reference_number").alias("r"), F.col("amount").alias("am"), F.col("balance").alias("bal"))
    s = stored.where("reference_number is not null").select("id", "bank", "direction", F.trim("reference_number").alias("ref"), "amount", "balance")
    hits = a.join(s, (F.col("b") == F.col("bank")) & (F.col("d") == F.col("direction")) & (F.col("r") == F.col("ref")))
    g = hits.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.bool_or(F.col("am") != F.col("amount")).alias("amount_off"), F.bool_or(F.coalesce(F.col("bal") != F.col("balance"), F.lit(False))).alias("balance_off"))
    reason = F.when(F.col("n") > 1, "multiple_candidates").when(F.col("amount_off"), "reference_amount_mismatch").when(F.col("balance_off"), "reference_balance_mismatch")
    return g.select("seq", F.when(reason.isNull(), "match").otherwise("defer").alias("action"), reason.alias("reason"), F.when(reason.isNull(), F.col("id")).alias("id"), F.col("n").cast("bigint").alias("candidates"))


def counterparty_match(a: Column, b: Column) -> Column:
    x, y = normalize_counterparty(a), normalize_counterparty(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


#: Rows that show the same are dealt into parts of about so many; parts meet parts as one row each.
PART = 1024
_KIND = ["bank", "direction", "amount", "currency", "transaction_date", "mask", "tier", "shown"]


def _ways(df: DataFrame, p: str, told: bool, kept: Column) -> DataFrame:
    """A row for each way to be known without a time: by counterparty (tier 3), by a card that is said to show the event (2), by
    nothing where that is said (1); what rows are compared by and ``kept`` ({p}one)."""
    way = lambda tier, shown: F.struct(F.lit(tier).alias("tier"), shown.alias("shown"))
    ways = [F.when(F.col(f"_{p}name") != "", way(3, F.col(f"_{p}name")))]
    if told:
        ways += [F.when(F.col(f"_{p}card").isNotNull(), way(2, F.col(f"_{p}card"))), F.when(F.col(f"{p}identifies_by") == "none", way(1, F.lit("")))]
    made = {"currency": F.coalesce(f"{p}currency", F.lit("INR")), "mask": F.col(f"_{p}mask"), "tier": F.col("w.tier"), "shown": F.col("w.shown")}
    rows = df.withColumn("w", F.explode(F.array(*ways))).select(*[made.get(c, F.col(f"{p}{c}")).alias(f"{p}{c}") for c in _KIND], kept.alias(f"{p}one"))
    return rows.where(" and ".join(f"{p}{c} is not null" for c in _KIND))


def _kinds(ways: DataFrame, p: str) -> DataFrame:
    return ways.groupBy(*[f"{p}{c}" for c in _KIND]).agg(F.count(F.lit(1)).alias("_size"))


def _dealt(ways: DataFrame, kinds: DataFrame, p: str) -> DataFrame:
    """Rows of these kinds with their part, of which there are more where a kind has more rows."""
    kinds = kinds.select("_size", *[F.col(f"{p}{c}").alias(f"_{c}") for c in _KIND])
    same = functools.reduce(operator.and_, [F.col(f"{p}{c}") == F.col(f"_{c}") for c in _KIND])
    return ways.join(kinds, same).select(*ways.columns, F.pmod(F.xxhash64(f"{p}one"), F.ceil(F.col("_size") / PART)).alias(f"{p}part"))


def _parts(dealt: DataFrame, p: str) -> DataFrame:
    return dealt.groupBy(*[f"{p}{c}" for c in _KIND], f"{p}part").agg(F.collect_list(f"{p}one").alias(f"{p}ones"))


def _untimed_candidates(i: DataFrame, s: DataFrame, told: bool, asks: Column, has: Column) -> DataFrame:
    """Fields of ``asks`` and ``has`` of messages without a time and the stored rows of their date, by the best tier that a message has.

    Rows are compared once for all that show the same; pairs are made last, from parts dealt over tasks, and neither joined nor moved."""
    i, s = _ways(i, "i_", told, asks), _ways(s, "", told, has)
    x, y, m, n = F.col("shown"), F.col("i_shown"), F.col("mask"), F.col("i_mask")
    last = lambda p: F.when(F.col(f"{p}tier") == 2, F.right(F.col(f"{p}shown"), F.lit(1))).otherwise("")
    keys = functools.reduce(operator.and_, [F.col(f"i_{c}") == F.col(c) for c in _KIND if c not in ("mask", "shown")], last("i_") == last(""))  # cards end in a digit
    shown = F.when(F.col("tier") == 3, x.contains(y) | y.contains(x)).when(F.col("tier") == 2, mask_matches(y, x)).otherwise(True)
    meet = keys & ((m == "") | (n == "") | mask_matches(n, m)) & shown
    kinds = _kinds(s, "")
    # the sizes are asked for here too, so that kinds are counted once for both uses
    i = _dealt(i, _kinds(i, "i_").join(kinds.where("_size > 0").drop("_size"), meet, "left_semi"), "i_")
    best = i.groupBy(F.col("i_one.seq").alias("_q")).agg(F.max("i_tier").alias("_best"))
    i = i.join(best, F.col("i_one.seq").eqNullSafe(F.col("_q")) & (F.col("i_tier") == F.col("_best")))
    spark = i.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = _parts(i, "i_").join(_parts(_dealt(s, kinds, ""), ""), meet)
    met = met.select(F.xxhash64(*[f"{p}{c}" for p in ("i_", "") for c in [*_KIND, "part"]]).alias("_to"), "i_ones", "ones").repartition(tasks, "_to")
    return met.select("ones", F.inline("i_ones")).select("*", F.inline("ones")).drop("ones")


def fuzzy_candidates(incoming: DataFrame, stored: DataFrame, slots: bool = False, parts: bool = False) -> DataFrame:
    """(seq, id, ...) of stored rows that can be the message's event: equal keys, within the time window, no mask that rules
    it out, narrowed by counterparty where a time is missing or several are left.

    With ``parts`` messages without a time (of a seq all or none) meet the rows that show the same as one: for keys that many rows
    of a day share; where few do, its joins cost more than they spare."""
    cur = lambda c: F.coalesce(c, F.lit("INR"))
    i = incoming.where("transaction_date is not null").select(*[F.col(c).alias(f"i_{c}") for c in incoming.columns])
    s = stored.where("transaction_date is not null")
    keys = (F.col("i_bank") == F.col("bank")) & (F.col("i_direction") == F.col("direction")) & (F.col("i_amount") == F.col("amount")) & (cur(F.col("i_currency")) == cur(F.col("currency")))
    at, other = seconds(F.col("i_transaction_date"), F.col("i_transaction_time_s")), seconds(F.col("transaction_date"), F.col("transaction_time_s"))
    window = F.when(F.col("i_received_time") | (F.col("received_time") & F.col("transaction_time_s").isNotNull()), RECEIVED_WINDOW_S).otherwise(WINDOW_S)
    own = F.when(F.col("i_received_time"), RECEIVED_WINDOW_S).otherwise(WINDOW_S)
    day = F.unix_date(F.col("transaction_date"))
    dates = day.between(F.floor((at - own) / 86400), F.floor((at + own) / 86400))
    near = F.when(F.col("i_transaction_time_s").isNull(), F.col("transaction_date") == F.col("i_transaction_date")).otherwise(dates & F.coalesce(F.abs(at - other) <= window, F.lit(True)))
    # what pairs compare is made once a row
    told = "identifies_by" in incoming.columns and "identifies_by" in stored.columns
    card = lambda p, m=normalize_mask: F.when((F.col(f"{p}identifies_by") == "card_mask") & (trailing_digits(m(F.col(f"{p}card_mask"))) > 0), m(F.col(f"{p}card_mask")))
    made = lambda df, p: df.withColumns({f"_{p}mask": normalize_mask(F.col(f"{p}account_mask")), f"_{p}name": normalize_counterparty(F.col(f"{p}counterparty")), **({f"_{p}card": card(p)} if told else {})})
    i, s = made(i, "i_"), made(s, "")
    m, n = F.col("_i_mask"), F.col("_mask")
    x, y = F.col("_name"), F.col("_i_name")
    cp = (x != "") & (y != "") & (x.contains(y) | y.contains(x))
    # without a time: by counterparty, else by the card that both say shows the event, else where both say that nothing does
    tier = F.when(cp, 3)
    if told:
        a, b = F.col("_i_card"), F.col("_card")
        by_card = (F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & mask_matches(a, b)  # both end in a digit
        tier = tier.when(F.coalesce(by_card, F.lit(False)), 2).when((F.col("identifies_by") == "none") & (F.col("i_identifies_by") == "none"), 1)
    tier = tier.otherwise(0)
    untimed = F.col("transaction_time_s").isNull() | F.col("i_transaction_time_s").isNull()
    joined = i.where("i_transaction_time_s is not null") if parts else i
    pairs = lambda asked: asked.join(s, keys & near).where((m == "") | (n == "") | mask_matches(m, n))
    # pairs are told twice and never shuffled: added up a message where they meet, then kept by what their message has
    tally = pairs(joined).groupBy(F.col("i_seq").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(cp).alias("_cp"), F.bool_or(untimed).alias("_untimed"), F.max(tier).alias("_best"))
    seen = pairs(joined.join(tally, F.col("i_seq").eqNullSafe(F.col("_q"))))
    rule = F.when(F.col("_untimed"), (F.col("_best") > 0) & (tier == F.col("_best"))).when((F.col("_n") > 1) & F.col("_cp"), cp).otherwise(F.lit(True))
    asks = [F.col("i_seq").alias("seq"), F.col("i_balance").alias("balance_in"), *([F.col("i_by_email").alias("by_email")] if slots else [])]
    has = ["id", "balance", *(["source"] if slots else [])]
    found = seen.where(rule).select(*asks, *has)
    if parts:
        found = found.unionByName(_untimed_candidates(i.where("i_transaction_time_s is null"), s, told, F.struct(*asks), F.struct(*has)))
    own = [F.col("source").isin("sms+email") | (F.col("source") == F.when(F.col("by_email"), "email").otherwise("sms"))] if slots else []
    return found.select("seq", "id", "balance_in", "balance", *[(~F.coalesce(x, F.lit(False))).alias("open") for x in own])


def decide(incoming: DataFrame, candidates: DataFrame, slots: bool = False) -> DataFrame:
    """match, insert or defer by balances: a different known balance rules a candidate out, one equal balance is the event.  With
    ``slots`` a message without a balance needs a row that no message of its channel has."""
    return _decided(incoming, candidates, slots).drop("near")


def _decided(incoming: DataFrame, candidates: DataFrame, slots: bool) -> DataFrame:
    """``decide`` with ``near``: whether the message has candidates at all, ruled out or not."""
    can = F.col("balance_in").isNull() | F.col("balance").isNull() | (F.bround("balance", 2) == F.bround("balance_in", 2))
    if_can = lambda x: F.when(can, x)
    g = candidates.groupBy("seq").agg(F.count_if(can).alias("n"), F.count_if(can & F.col("balance").isNotNull() & F.col("balance_in").isNotNull()).alias("equal"), F.max(if_can(F.when(F.col("balance").isNotNull(), F.col("id")))).alias("equal_id"),
                                      F.count_if(can & F.col("balance").isNull()).alias("bare"), F.max(if_can(F.col("id"))).alias("any_id"), F.bool_or(F.col("balance_in").isNotNull()).alias("known"), *([F.bool_or(if_can(F.col("open"))).alias("open")] if slots else []))
    g = g.withColumnRenamed("seq", "_seq")
    out = incoming.select("seq").join(g, F.col("seq") == F.col("_seq"), "left")
    sure = F.when(F.col("known"), F.when(F.col("equal") == 1, F.col("equal_id"))).otherwise(F.when((F.col("n") == 1) & (F.col("bare") == 1) & (F.col("open") if slots else F.lit(True)), F.col("any_id")))
    action = F.when(F.coalesce("n", F.lit(0)) == 0, "insert").when(sure.isNotNull(), "match").otherwise("defer")
    alone = "source_slot_filled" if slots else "balance_ambiguous"
    reason = F.when(action == "defer", F.when(F.col("known"), "balance_ambiguous").when(F.col("n") > 1, "multiple_candidates").otherwise(alone))
    return out.select("seq", action.alias("action"), F.when(action == "match", sure).alias("id"), reason.alias("reason"), F.coalesce("n", F.lit(0)).cast("bigint").alias("candidates"), F.col("_seq").isNotNull().alias("near"))


def twelve_hours_apart(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The only stored row with equal keys and counterparty whose time is the message's read in the other half of the day."""
    i = incoming.where("transaction_date is not null and transaction_time_s is not null").select("seq", *[F.col(c).alias(f"i_{c}") for c in ("bank", "direction", "amount", "currency", "transaction_date", "transaction_time_s", "counterparty")])
    s = stored.where("transaction_date is not null and transaction_time_s is not null")
    cur = lambda c: F.coalesce(c, F.lit("INR"))
    keys = (F.col("i_bank") == F.col("bank")) & (F.col("i_direction") == F.col("direction")) & (F.col("i_amount") == F.col("amount")) & (cur(F.col("i_currency")) == cur(F.col("currency"))) & (F.col("i_transaction_date") == F.col("transaction_date"))
    hour = F.floor(F.col("transaction_time_s") / 3600)
    half = F.when(F.col("i_transaction_time_s") >= 43200, hour.between(1, 11)).otherwise(hour == 12)
    gap = F.abs(F.abs(F.col("i_transaction_time_s") - F.col("transaction_time_s")) - 43200) <= WINDOW_S
    hits = i.join(s, keys & half & gap & counterparty_match(F.col("counterparty"), F.col("i_counterparty")))
    return hits.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n = 1").select("seq", "id")


def enrichment(incoming: DataFrame, stored: DataFrame, matches: DataFrame) -> DataFrame:
    """What a matched message changes: an e-mail fills or replaces, a text message only fills; less information never replaces more."""
    fields = ["counterparty", "account_mask", "reference_number"]
    m = matches.where("action = 'match'").select(F.col("seq").alias("_s"), F.col("id").alias("_t"))
    i = incoming.select("seq", "by_email", *[F.col(f).alias(f"new_{f}") for f in fields])
    s = stored.select("id", *[F.col(f).alias(f"old_{f}") for f in fields])
    rows = m.join(i, F.col("_s") == F.col("seq")).join(s, F.col("_t") == F.col("id"))
    changes = []
    for f in fields:
        old, new = F.col(f"old_{f}"), F.col(f"new_{f}")
        less = F.lower(old).contains(F.lower(new)) & (F.length(new) < F.length(old))
        use = new.isNotNull() & (F.trim(new) != "") & (old.isNull() | (F.col("by_email") & (old != new) & ~less))
        changes.append(F.when(use, F.struct(F.lit(f).alias("field"), old.alias("old"), new.alias("new"))))
    return rows.select("seq", "id", F.explode(F.array_compact(F.array(*changes))).alias("c")).select("seq", "id", "c.field", "c.old", "c.new")


# Message types whose stored times may be twelve hours off.
TWELVE_HOUR_TYPES = ["icici_cc_transaction_alert"]


def other_half(incoming: DataFrame, stored: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The only stored row of a type with ambiguous hours that is the message read twelve hours off (across midnight too), with
    equal keys and counterparty: a time from noon on meets hours 1 to 11 before it, one before noon the hour of noon after it."""
    types = TWELVE_HOUR_TYPES if types is None else types
    i = incoming.where("transaction_date is not null and transaction_time_s is not null").select("seq", *[F.col(c).alias(f"i_{c}") for c in ("bank", "direction", "amount", "currency", "transaction_date", "transaction_time_s", "counterparty", "balance")])
    late = F.col("i_transaction_time_s") >= 43200
    i = i.withColumn("_at", seconds(F.col("i_transaction_date"), F.col("i_transaction_time_s")) + F.when(late, -43200).otherwise(43200))
    # the shifted time can lie within the window of two dates
    i = i.withColumn("_day", F.explode(F.array_distinct(F.array(F.floor((F.col("_at") - WINDOW_S) / 86400), F.floor((F.col("_at") + WINDOW_S) / 86400)))))
    s = stored.where("transaction_date is not null and transaction_time_s is not null").where(F.col("email_type").isin(types))
    cur = lambda c: F.coalesce(c, F.lit("INR"))
    keys = (F.col("i_bank") == F.col("bank")) & (F.col("i_direction") == F.col("direction")) & (F.col("i_amount") == F.col("amount")) & (cur(F.col("i_currency")) == cur(F.col("currency"))) & (F.unix_date("transaction_date") == F.col("_day"))
    hour = F.floor(F.col("transaction_time_s") / 3600)
    half = F.when(F.col("i_transaction_time_s") >= 43200, hour.between(1, 11)).otherwise(hour == 12)
    near = F.abs(seconds(F.col("transaction_date"), F.col("transaction_time_s")) - F.col("_at")) <= WINDOW_S
    hits = i.join(s, keys & half & near & counterparty_match(F.col("counterparty"), F.col("i_counterparty")))
    g = hits.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.bool_or(F.coalesce(F.col("i_balance") != F.col("balance"), F.lit(False))).alias("balance_off"))
    return g.where("n = 1").select("seq", "id", "balance_off")


def find_matches(incoming: DataFrame, stored: DataFrame, types: list[str] | None = None, slots: bool = False) -> DataFrame:
    """What becomes of each message: match (with the row and how it was found), insert or defer (with the reason).

    A reference that is stored decides by itself; else the rows within the time window do, if there are any; else the
    other half of the day, where a different balance makes it a new event."""
    ref = by_reference(incoming, stored).select(F.col("seq").alias("_q"), F.col("action").alias("_ra"), F.col("reason").alias("_rr"), F.col("id").alias("_ri"), F.col("candidates").alias("_rn"))
    fuzzy = _decided(incoming, fuzzy_candidates(incoming, stored, slots), slots).select(F.col("seq").alias("_f"), F.col("action").alias("_fa"), F.col("reason").alias("_fr"), F.col("id").alias("_fi"), "near")
    half = other_half(incoming, stored, types).select(F.col("seq").alias("_h"), F.col("id").alias("_hi"), "balance_off")
    j = incoming.select("seq").join(ref, F.col("seq") == F.col("_q"), "left").join(fuzzy, F.col("seq") == F.col("_f"), "left").join(half, F.col("seq") == F.col("_h"), "left")
    path = F.when(F.col("_ra").isNotNull(), "reference").when(F.col("near"), "fuzzy").when(F.col("_hi").isNotNull(), "other_half").otherwise("none")
    action = F.when(path == "reference", F.col("_ra")).when(path == "fuzzy", F.col("_fa")).when((path == "other_half") & ~F.col("balance_off"), "match").otherwise("insert")
    found = F.when(path == "reference", F.col("_ri")).when(path == "fuzzy", F.col("_fi")).when(action == "match", F.col("_hi"))
    reason = F.when(path == "reference", F.col("_rr")).when(path == "fuzzy", F.col("_fr")).when((path == "other_half") & F.col("balance_off"), "alias_balance_mismatch")
    return j.select("seq", path.alias("path"), action.alias("action"), found.alias("id"), reason.alias("reason"))


FIELDS = ["counterparty", "card_mask", "account_mask", "reference_number", "channel", "balance", "raw_description", "transaction_date", "transaction_time_s"]
_MASKS = ["card_mask", "account_mask"]


def _value(field: str, old: Column, new: Column, by_email: Column, earlier: Column) -> tuple[Column, Column]:
    """(whether the field changes, whether it is only filled) under the rules of ``changes``."""
    differs = new.isNotNull() & old.isNotNull() & (old != new)
    if field in _MASKS:
        a, b = mask_digits(old), mask_digits(new)
        differs = differs & (a != b) & ~((F.length(b) < F.length(a)) & a.endswith(b))
    elif field == "counterparty":
        a, b = normalize_counterparty(old), normalize_counterparty(new)
        differs = differs & ~((b != "") & a.contains(b) & (a != b))
    elif field == "raw_description":
        a, b = F.trim(old), F.trim(new)
        differs = differs & ~((b != "") & a.contains(b) & (a != b))
    elif field == "transaction_time_s":
        differs = differs & earlier
    elif field == "transaction_date":
        differs = differs & (new < old)
    fills = new.isNotNull() & old.isNull()
    return fills | (by_email & differs), fills


def changes(incoming: DataFrame, stored: DataFrame, matches: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(seq, id, field, kind, old, new) of what matched messages change, values as text.

    Any message fills what is missing; an e-mail also replaces, but not a time or date by a later one, a text by a part of it,
    a mask by fewer of its last digits or by another way to write it."""
    fields = [f for f in (fields or FIELDS) if f in incoming.columns and f in stored.columns]
    m = matches.where("action = 'match'").select(F.col("seq").alias("_s"), F.col("id").alias("_t"))
    i = incoming.select("seq", "by_email", *[F.col(f).alias(f"new_{f}") for f in fields])
    s = stored.select("id", *[F.col(f).alias(f"old_{f}") for f in fields])
    rows = m.join(i, F.col("_s") == F.col("seq")).join(s, F.col("_t") == F.col("id"))
    at = lambda side: seconds(F.coalesce(F.col(f"{side}_transaction_date"), F.col("old_transaction_date"), F.col("new_transaction_date")), F.col(f"{side}_transaction_time_s"))
    earlier = at("new") < at("old")
    out = []
    for f in fields:
        old, new = F.col(f"old_{f}"), F.col(f"new_{f}")
        use, fills = _value(f, old, new, F.col("by_email"), earlier)
        out.append(F.when(use, F.struct(F.lit(f).alias("field"), F.when(fills, "filled").otherwise("overwritten").alias("kind"), old.cast("string").alias("old"), new.cast("string").alias("new"))))
    return rows.select("seq", "id", F.explode(F.array_compact(F.array(*out))).alias("c")).select("seq", "id", "c.*")


def applied(stored: DataFrame, incoming: DataFrame, changed: DataFrame, order: str = "seq") -> DataFrame:
    """Stored rows after their changes (of several messages for one field the first counts); an enriched row has both sources."""
    first = changed.groupBy(F.col("id").alias("_i"), "field").agg(F.min_by("new", order).alias("new"))
    wide = first.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("_new"))
    j = stored.join(wide, F.col("id") == F.col("_i"), "left")
    types = dict(stored.dtypes)
    cols = []
    for c in stored.columns:
        if c in FIELDS:
            cols.append(F.when(F.map_contains_key(F.coalesce("_new", F.create_map().cast("map<string,string>")), c), F.element_at("_new", c).cast(types[c])).otherwise(F.col(c)).alias(c))
        elif c == "source":
            cols.append(F.when(F.col("_i").isNotNull(), "sms+email").otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols, F.col("_i").isNotNull().alias("enriched"))


def booked(incoming: DataFrame, stored: DataFrame, decisions: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The stored table after a batch: matched rows enriched, and a new row for every message to insert; of several new ones
    with one bank, direction and reference the first stands (its message is what the others would have met)."""
    changed = changes(incoming, stored, decisions)
    after = applied(stored, incoming, changed).drop("enriched")
    new = incoming.join(decisions.where("action = 'insert'").select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left_semi")
    ref = F.nullif(F.trim(F.coalesce("reference_number", F.lit(""))), F.lit(""))
    n = F.row_number().over(Window.partitionBy("bank", "direction", ref, F.when(ref.isNull(), F.col("seq"))).orderBy("seq"))
    new = new.withColumn("_n", n).where("_n = 1").withColumn("source", F.when(F.col("by_email"), "email").otherwise("sms"))
    kinds = dict(stored.dtypes)
    have = set(new.columns)
    return after.withColumn("seq", F.lit(None).cast("bigint")).unionByName(new.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns], "seq"))


def resolved_duplicates(choices: DataFrame, tokens: DataFrame, qualifies: DataFrame) -> DataFrame:
    """What becomes of a person's choices (seq, id, action, token) about deferred messages: stale where the token isn't what the
    data gives now, refused where the target can't be the message, else merged or created."""
    now = tokens.select(F.col("seq").alias("_s"), F.col("id").alias("_t"), F.col("token").alias("_now"))
    fit = qualifies.select(F.col("seq").alias("_q"), F.col("id").alias("_i"), "qualifies")
    j = choices.join(now, (F.col("seq") == F.col("_s")) & (F.col("id") == F.col("_t")), "left").join(fit, (F.col("seq") == F.col("_q")) & (F.col("id") == F.col("_i")), "left")
    stale = ~F.col("token").eqNullSafe(F.col("_now"))
    return j.select("seq", "id", F.when(stale, "stale").when(F.col("action") == "create_new", "created").when(F.coalesce("qualifies", F.lit(False)), "merged").otherwise("refused").alias("outcome"))


def slot_claims(matches: DataFrame, incoming: DataFrame) -> DataFrame:
    """(seq, id, claimed): of the messages of one channel that match a row, the first takes its slot."""
    i = incoming.select(F.col("seq").alias("_s"), F.when(F.col("by_email"), "email").otherwise("sms").alias("slot"))
    m = matches.where("action = 'match'").select("seq", "id").join(i, F.col("seq") == F.col("_s"))
    return m.select("seq", "id", "slot", (F.row_number().over(Window.partitionBy("id", "slot").orderBy("seq")) == 1).alias("claimed"))


def explicit_matches(pairs: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether rows that a person picked (seq, id) can be the message: equal keys, no contradicting balance, the same time
    window or day, and among the automatic candidates or with a shortened reference."""
    cur = lambda c: F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("INR"))
    i = incoming.select(F.col("seq").alias("_s"), *[F.col(c).alias(f"i_{c}") for c in ("bank", "direction", "amount", "currency", "balance", "reference_number", "transaction_date", "transaction_time_s")])
    j = pairs.join(i, F.col("seq") == F.col("_s")).join(stored, "id")
    auto = fuzzy_candidates(incoming, stored).select(F.col("seq").alias("_a"), F.col("id").alias("_b"), F.lit(True).alias("_auto"))
    j = j.join(auto, (F.col("seq") == F.col("_a")) & (F.col("id") == F.col("_b")), "left")
    same = F.col("bank").eqNullSafe(F.col("i_bank")) & (F.col("direction") == F.col("i_direction")) & (F.col("amount") == F.col("i_amount")) & (cur(F.col("currency")) == cur(F.col("i_currency")))
    both = F.col("transaction_time_s").isNotNull() & F.col("i_transaction_time_s").isNotNull()
    gap = F.abs(seconds(F.col("transaction_date"), F.col("transaction_time_s")) - seconds(F.col("i_transaction_date"), F.col("i_transaction_time_s")))
    time = F.when(both, gap <= WINDOW_S).otherwise(F.col("transaction_date") == F.col("i_transaction_date"))
    fine = same & F.coalesce(time, F.lit(False)) & ~F.coalesce(F.bround("balance", 2) != F.bround("i_balance", 2), F.lit(False))
    return j.select("seq", "id", F.coalesce(fine & (F.coalesce("_auto", F.lit(False)) | shortened_reference(F.col("reference_number"), F.col("i_reference_number"))), F.lit(False)).alias("qualifies"))


def preview_token(incoming: DataFrame, stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, id, token): a digest of everything a person's decision rests on, which tells when any of it has changed since."""
    i = incoming.select(F.col("seq").alias("_s"), "amount", "balance", "reference_number")
    s = stored.select(F.col("id").alias("_t"), F.col("amount").alias("_am"), F.col("balance").alias("_bal"), F.col("source").alias("_src"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    j = pairs.join(i, F.col("seq") == F.col("_s")).join(s, F.col("id") == F.col("_t"))
    return j.select("seq", "id", F.sha2(F.concat_ws("|", *[text(c) for c in ("seq", "id", "amount", "balance", "reference_number", "_am", "_bal", "_src")]), 256).alias("token"))


def batch_repeats(incoming: DataFrame) -> DataFrame:
    """(seq, first_seq) of messages that repeat an earlier one of their batch: its bank, direction, reference and amount."""
    w = Window.partitionBy("bank", "direction", F.trim("reference_number"), "amount").orderBy("seq")
    own = incoming.where("trim(coalesce(reference_number, '')) <> ''").withColumn("first_seq", F.first("seq").over(w))
    return own.where("seq <> first_seq").select("seq", "first_seq")
