"""What people and scheduled jobs change: rules, categories, links, manual items, audit rows, sync state and one-off repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import normalize_counterparty, normalize_text
from tallyspark.functions.formatting import canonical_slug
from tallyspark.functions.vocabulary import known_slugs

_EMPTY = lambda c: F.coalesce(F.col(c), F.lit(""))


# ---- rules and categories


def rule_changes(changes: DataFrame, slugs: list[str]) -> DataFrame:
    """Requested merchant rules with their normalized pattern and verdict: blank_pattern, invalid_slug, unknown_category or ok."""
    pattern = normalize_text(F.col("pattern"))
    valid = F.coalesce(F.col("category").rlike("^[a-z][a-z0-9_]{1,40}$"), F.lit(False))
    verdict = F.when(pattern == "", "blank_pattern").when(~valid, "invalid_slug").when(~F.col("category").isin(slugs), "unknown_category").otherwise("ok")
    return changes.withColumn("pattern", pattern).withColumn("verdict", verdict)


def upserted_rules(rules: DataFrame, changes: DataFrame, slugs: list[str]) -> DataFrame:
    """Rules after the accepted changes (the last one of a pattern counts): category and priority replaced, switched on."""
    ok = rule_changes(changes, slugs).where("verdict = 'ok'").groupBy("pattern").agg(F.max_by(F.struct("category", "priority"), "change_id").alias("c"))
    new = ok.select("pattern", "c.category", F.lit(True).alias("active"), "c.priority")
    kept = rules.select("pattern", "category", "active", "priority").join(new.select(F.col("pattern").alias("_p")), F.col("pattern") == F.col("_p"), "left_anti")
    return kept.unionByName(new)


def assigned(requests: DataFrame, slugs: list[str]) -> DataFrame:
    """Manual categories: applied (blank clears, an unknown slug only with ``create``), else rejected; by hand is always final."""
    text = F.trim(_EMPTY("raw"))
    slug = canonical_slug(text)
    ok = (text == "") | (slug.isNotNull() & (slug.isin(slugs) | F.coalesce("create", F.lit(False))))
    return requests.select("id", ok.alias("applied"), F.when(ok & (text != ""), slug).alias("category"), F.when(ok, "manual").alias("category_method"), F.when(ok, "resolved").alias("review_status"))


def needs_work(txns: DataFrame, vocabulary: int, limit: int, model: bool = True) -> DataFrame:
    """The next rows to categorize, oldest ids first (``limit`` is the feature): never evaluated; for the model pass also those
    that wait for it and its own unknowns from an older vocabulary."""
    open_ = F.col("category_method").isNull()
    if model:
        stale = (F.col("category") == "unknown") & (F.col("category_method") == "llm") & (F.col("vocab_version").isNull() | (F.col("vocab_version") < vocabulary))
        open_ = open_ | (F.col("category_method") == "pending_llm") | stale
    return txns.where(open_).orderBy("id").limit(limit)


def requeued(txns: DataFrame, vocabulary: int) -> DataFrame:
    """How many unknowns of the model each older vocabulary left, which a raise to ``vocabulary`` requeues."""
    return txns.where((F.col("category") == "unknown") & (F.col("category_method") == "llm") & (F.coalesce("vocab_version", F.lit(0)) < vocabulary)).groupBy("vocab_version").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def requeue(txns: DataFrame, vocabulary: int) -> DataFrame:
    """Transactions after the vocabulary was raised to ``vocabulary``: the model's unknowns of older ones wait for the model again,
    without category; all other rows stay as they are."""
    stale = F.coalesce((F.col("category") == "unknown") & (F.col("category_method") == "llm") & (F.coalesce("vocab_version", F.lit(0)) < vocabulary), F.lit(False))
    return txns.withColumns({"category": F.when(~stale, F.col("category")), "category_method": F.when(stale, "pending_llm").otherwise(F.col("category_method"))})


def with_categories(categories: DataFrame, slugs: list[str], vocabulary: int) -> tuple[DataFrame, int]:
    """The categories (slug, active) with those of ``slugs`` that are new, active, and the vocabulary, raised by one for each."""
    wanted = categories.sparkSession.createDataFrame([(s, True) for s in dict.fromkeys(slugs)], "slug string, active boolean")
    new = wanted.join(categories.select(F.col("slug").alias("_s")), F.col("slug") == F.col("_s"), "left_anti")
    return categories.unionByName(new, allowMissingColumns=True), vocabulary + new.count()


def to_notify(reviews: DataFrame, attempts: int, limit: int = 50) -> DataFrame:
    """The next pending reviews to announce, in order of ids: fewer than ``attempts`` tries so far; ``limit`` is the feature."""
    return reviews.where((F.col("review_status") == "pending") & (F.coalesce("tries", F.lit(0)) < attempts)).orderBy("id").limit(limit)


def input_digest(txn_type: Column) -> Column:
    """SHA-256 over what the categorizer reads of a row, as JSON with sorted keys and no spaces."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = {"account_type": F.coalesce(txn_type, F.lit("")), "amount": text("amount"), "bank": text("bank"), "channel": text("channel"), "counterparty": normalize_counterparty(F.col("counterparty")),
             "currency": F.coalesce("currency", F.lit("INR")), "direction": text("direction"), "email_type": text("email_type"), "raw_description": normalize_text(F.col("raw_description"))}
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(parts.items())])), 256)


def model_verdict(slug: Column, confidence: Column, direction: Column, account_type: Column, told: Column, threshold: float = 0.6) -> list[Column]:
    """(category, method, confidence, review) of a model's answer: nothing to read is unknown without review; no answer or a weak
    one is unknown and pending; an answer that the direction rules out falls back to unknown with at most 0.4, and pends."""
    weak = slug.isNull() | (slug == "needs_review") | (F.coalesce(confidence, F.lit(0.0)) < threshold)
    against = (slug.isin("salary", "refund", "investment_redemption") & (direction == "debit")) | (slug.isin("groceries", "rent", "dining", "investment") & (direction == "credit"))
    category = F.when(~told, "unknown").when(weak | against, "unknown").otherwise(slug)
    sure = F.when(~told, 0.0).when(weak, F.coalesce(confidence, F.lit(0.0))).when(against, F.least(confidence, F.lit(0.4))).otherwise(confidence)
    return [category.alias("category"), F.lit("llm").alias("method"), sure.alias("confidence"), F.when(told & (weak | against), "pending").alias("review")]


# ---- links


def relinked(requests: DataFrame, txns: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, account_id, card_id, error) of requested links: a card brings its account; errors are card_not_found,
    card_account_mismatch, account_not_found and bank_mismatch; requests about unknown transactions are left out."""
    t = txns.select(F.col("id").alias("_t"), F.col("bank").alias("_tb"))
    c = cards.select(F.col("id").alias("_c"), F.col("account_id").alias("_ca"))
    a = accounts.select(F.col("id").alias("_a"), F.col("bank").alias("_ab"))
    j = requests.join(t, F.col("id") == F.col("_t")).join(c, F.col("card_id") == F.col("_c"), "left").withColumn("_want", F.coalesce("account_id", "_ca")).join(a, F.col("_want") == F.col("_a"), "left")
    error = F.when(F.col("card_id").isNotNull() & F.col("_c").isNull(), "card_not_found").when(F.col("_ca").isNotNull() & (F.col("_ca") != F.col("_want")), "card_account_mismatch").when(
        F.col("_want").isNotNull() & F.col("_a").isNull(), "account_not_found").when(F.col("_ab") != F.col("_tb"), "bank_mismatch")
    return j.select("id", F.when(error.isNull(), F.col("_want")).alias("account_id"), F.when(error.isNull(), F.col("card_id")).alias("card_id"), error.alias("error"))


def linkable(txns: DataFrame, accounts: DataFrame, account_id: int) -> DataFrame:
    """Rows without an account of the bank that one account belongs to: what linking that account looks at."""
    bank = accounts.where(F.col("id") == account_id).select(F.col("bank").alias("_b"))
    return txns.where("account_id is null").join(bank, F.lower(F.trim("bank")) == F.lower(F.trim("_b")), "left_semi")


# ---- manual items


def manual_edits(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What becomes of edits (snapshot_id, as_of_date) of manual balances: not_found, collision with another balance of the item
    on that date, or moved."""
    own = snapshots.where("manual_item_id is not null").select(F.col("id").alias("_s"), F.col("manual_item_id").alias("_m"), F.col("as_of_date").alias("_was"))
    j = edits.join(own, F.col("snapshot_id") == F.col("_s"), "left")
    other = snapshots.where("manual_item_id is not null").groupBy(F.col("manual_item_id").alias("_om"), F.col("as_of_date").alias("_od")).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    j = j.join(other, (F.col("_m") == F.col("_om")) & (F.col("as_of_date") == F.col("_od")), "left")
    clash = F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("snapshot_id")) | (F.col("_hi") != F.col("snapshot_id"))) & (F.col("as_of_date") != F.col("_was"))
    return j.select("snapshot_id", F.when(F.col("_s").isNull(), "not_found").when(clash, "collision").otherwise("moved").alias("outcome"))


def manual_balances(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual balances after changes, one for each item and date: a change replaces what stands there (the last one counts)."""
    both = snapshots.where("manual_item_id is not null").select("manual_item_id", "as_of_date", "value", F.lit(0).alias("_fresh"), "id").unionByName(changes.select("manual_item_id", "as_of_date", "value", F.lit(1).alias("_fresh"), "id"))
    return both.groupBy("manual_item_id", "as_of_date").agg(F.max_by("value", F.struct("_fresh", "id")).alias("value"))


# ---- audit and bulk loads


def audit_log(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs with how they ended: the first completion of a run counts; one without is running."""
    e = ends.groupBy(F.col("run_id").alias("_r")).agg(F.min_by(F.struct("status", "ended_at"), F.struct("ended_at", "status")).alias("e"))
    return starts.join(e, F.col("run_id") == F.col("_r"), "left").select("run_id", "operation", "started_at", F.coalesce("e.status", F.lit("running")).alias("status"), "e.ended_at")


def recent_runs(log: DataFrame, limit: int = 50, operation: str | None = None, status: str | None = None) -> DataFrame:
    """The newest runs, 200 at most (which is the feature)."""
    for name, value in (("operation", operation), ("status", status)):
        log = log if value is None else log.where(F.col(name) == value)
    return log.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(max(1, min(limit, 200)))


def landing(rows: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a bulk load that land: the first of each key, unless the key is stored."""
    # stored keys stand before the rows of theirs, so that one sort finds both
    both = rows.withColumn("_stored", F.lit(False)).unionByName(stored.select(*keys).withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    # by hash first: most comparisons of a sort end there
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(F.col("_stored").desc(), order)
    kinds = dict(rows.dtypes)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not _stored").select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns])


def repaired(txns: DataFrame) -> DataFrame:
    """One-off repairs: references of mandate payments are no identities and go; categories without a method are by hand."""
    mandate = (F.col("channel") == "nach") | F.col("email_type").contains("nach")
    by_hand = F.col("category").isNotNull() & (F.col("category") != "") & F.col("category_method").isNull()
    return txns.withColumn("reference_number", F.when(~F.coalesce(mandate, F.lit(False)), F.col("reference_number"))).withColumn("category_method", F.when(by_hand, "manual").otherwise(F.col("category_method")))


def tracked(uploads: DataFrame, today: str) -> DataFrame:
    """Card statements of the month without a payment state, with due date and amount, start as unpaid."""
    fresh = F.col("created_on") >= F.trunc(F.lit(today).cast("date"), "MM")
    full = (_EMPTY("due_date") != "") & (_EMPTY("total_amount_due") != "")
    return uploads.withColumn("payment_status", F.when(full & fresh & F.col("payment_status").isNull(), "unpaid").otherwise(F.col("payment_status")))


# ---- sync state


def caught_up(states: DataFrame) -> DataFrame:
    """States after a run to ``target``: applied stops at what is desired, and a run that reached it clears the dirty marks."""
    done = F.col("target") >= F.col("desired")
    return states.select("id", F.least("target", "desired").alias("applied"), "desired", F.when(~done, F.col("first_dirty_s")).alias("first_dirty_s"), F.when(~done, F.col("last_dirty_s")).alias("last_dirty_s"), (~done & F.col("force")).alias("force"), done.alias("caught_up"))


def after_attempt(states: DataFrame, minutes: Column) -> DataFrame:
    """States after an attempt: same content needs no reload; a healthy reload clears failures; a failed one counts and waits."""
    same = F.col("body_hash").eqNullSafe(F.col("remote_hash"))
    failures = F.when(same | F.col("healthy"), 0).otherwise(F.col("failures") + 1).cast("bigint")
    action = F.when(same, "no_op").when(F.col("healthy"), "reloaded").otherwise("failed")
    return states.select("id", action.alias("action"), failures.alias("failures"), F.when(action == "failed", F.col("now_s") + minutes * 60).cast("bigint").alias("next_attempt_s"), F.when(action == "failed", F.col("remote_hash")).otherwise(F.col("body_hash")).alias("remote_hash"))


def auto_rules(sources: DataFrame, rules: DataFrame, senders: list[str], now_s: Column, cooldown_s: int = 86_400) -> DataFrame:
    """Managed rules to add: each known sender for each active source polled longer ago than the cooldown, where none exists."""
    due = sources.where(F.col("active") & (F.col("last_polled_s").isNull() | (now_s - F.col("last_polled_s") >= cooldown_s)))
    want = due.select(F.col("id").alias("source_id"), F.explode(F.array(*[F.lit(s) for s in senders])).alias("sender"))
    have = rules.select(F.col("source_id").alias("_s"), F.lower("sender").alias("_n"))
    return want.join(have, (F.col("source_id") == F.col("_s")) & (F.col("sender") == F.col("_n")), "left_anti")


def revisions(changes: DataFrame, by: str = "commit_id", width: int = 10_000, levels: int = 3) -> DataFrame:
    """Each commit's revision after it: every changed row counts one, and a commit's rows count together.  Running sums are taken
    within stretches of ``width`` commit ids, over the stretches of a stretch of those, and so on for ``levels``, so a task holds
    ``width`` sums (the last window those of all ids by ``width`` to the power of ``levels``)."""
    g = changes.groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("changed"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))
    sums = [g.select(F.col(by).alias("_k0"), F.col("changed").alias("_n"))]
    for k in range(1, levels + 1):
        sums.append(sums[-1].groupBy(F.floor(F.col(f"_k{k - 1}") / width).alias(f"_k{k}")).agg(F.sum("_n").alias("_n")))
    start = sums[-1].select(f"_k{levels}", (F.sum("_n").over(Window.orderBy(f"_k{levels}")) - F.col("_n")).alias("_start"))
    for k in reversed(range(levels)):
        within = F.sum("_n").over(Window.partitionBy("_up").orderBy(f"_k{k}")) - F.col("_n")
        own = sums[k].withColumn("_up", F.floor(F.col(f"_k{k}") / width)).withColumn("_in", within)
        start = own.join(start.withColumnRenamed("_start", "_above"), F.col("_up") == F.col(f"_k{k + 1}")).select(f"_k{k}", (F.col("_above") + F.col("_in")).alias("_start"))
    return g.join(start, F.col(by) == F.col("_k0")).select(by, "changed", "first_s", "last_s", (F.col("_start") + F.col("changed")).cast("bigint").alias("revision"))
