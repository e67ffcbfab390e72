"""Card statements: reconciliation with stored rows, payments of a cycle, reminders and payment tracking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import mask_matches, normalize_mask, paise
from tallyspark.functions.udfs import contains_whole_token, normalized_narration
from tallyspark.operators.statements import cycles, parsed, whole_groups
from tallyspark.operators.uploads import stored_masks

#: Days after its due date for which an open statement is still reminded of.
STALE_DAYS = 7


def fits_account(mask: Column, masks: Column) -> Column:
    """Whether a stored row's mask can be one of the account's cards; unknown on either side fits."""
    return (mask == "") | (F.size(masks) <= 0) | F.exists(masks, lambda m: mask_matches(mask, m))


def names_one_card(mask: Column, masks: Column) -> Column:
    """Whether a mask agrees with at least one of the account's cards, and all it agrees with can be one card."""
    own = F.filter(masks, lambda m: mask_matches(mask, m))
    return (F.size(own) > 0) & F.forall(own, lambda a: F.forall(own, lambda b: mask_matches(a, b)))


def judged_pairs(rows: DataFrame, txns: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(stmt_idx, id, offset and what decides) of stored rows with the account, direction and amount within a day: fits (the
    card is the account's), same (both masks name one card), other (the masks contradict), named (the narration names the
    counterparty, or is the stored one, and the cards don't contradict)."""
    masks = stored_masks(accounts, cards).groupBy(F.col("account_id").alias("_ma")).agg(F.array_sort(F.collect_set("mask")).alias("_masks"))
    s = rows.select("stmt_idx", F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.col("amount").alias("_m"), F.col("date").alias("_date"), normalize_mask(F.col("card_number")).alias("_sm"), F.trim(F.coalesce("narration", F.lit(""))).alias("told"), F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("offset"))
    s = s.withColumn("_on", F.date_add("_date", F.col("offset")))
    t = txns.select("id", "account_id", "direction", "amount", "transaction_date", "card_mask", "counterparty", "raw_description")
    j = s.join(t, (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("direction")) & (F.col("_m") == F.col("amount")) & (F.col("_on") == F.col("transaction_date"))).join(masks, F.col("account_id") == F.col("_ma"), "left")
    all_masks, own = F.coalesce("_masks", F.array().cast("array<string>")), normalize_mask(F.col("card_mask"))
    j = j.withColumn("_tm", own).withColumn("_all", all_masks).withColumn("_told", normalized_narration(F.col("told"))).withColumn("_cp", normalized_narration(F.col("counterparty"))).withColumn("_was", normalized_narration(F.col("raw_description")))
    sm, tm, every = F.col("_sm"), F.col("_tm"), F.col("_all")
    other = (sm != "") & (tm != "") & ~mask_matches(sm, tm)
    named = (F.col("_told") != "") & (contains_whole_token(F.col("_told"), F.col("_cp")) | ((F.col("_was") != "") & (F.col("_was") == F.col("_told")))) & ~other
    return j.select("account_id", "direction", "amount", "stmt_idx", "id", "offset", "told", fits_account(tm, every).alias("fits"), (mask_matches(sm, tm) & names_one_card(sm, every) & names_one_card(tm, every)).alias("same"), other.alias("other"), named.alias("named"))


_STATUS = {0: "date", -1: "date-1", 1: "date+1"}


def assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """Statement rows of one account, direction and amount assigned to stored rows.

    In statement order each takes the first card that fits on its date, the day before, or the day after.  A row that others
    with another narration can reach too is contested, unless its card is sure and theirs is another.  Contested rows that
    reach each other's stored rows keep them, dealt anew, where every one of them names just one and is the only row to
    name it; else they are ambiguous, as is a row with candidates and no pick."""
    by_row = {s: p.sort_values(["offset", "id"], key=lambda c: c.map({0: 0, -1: 1, 1: 2}) if c.name == "offset" else c) for s, p in pairs.groupby("stmt_idx")}
    facts = {(r.stmt_idx, r.id): r for r in pairs.itertuples()}
    reach = {s: set(p.id) for s, p in by_row.items()}
    reached: dict[int, set[int]] = {}
    for s, ids in reach.items():
        for i in ids:
            reached.setdefault(i, set()).add(s)
    told = {s: p.told.iloc[0] for s, p in by_row.items()}
    taken: dict[int, int] = {}
    used: set[int] = set()
    for s in sorted(by_row):
        pick = next((int(r.id) for r in by_row[s].itertuples() if r.fits and r.id not in used), None)
        if pick is not None:
            taken[s] = pick
            used.add(pick)
    contested = set()
    for s, i in taken.items():
        rivals = reached[i] - {s}
        if facts[s, i].same:
            rivals = {r for r in rivals if not facts[r, i].other}
        if len({told[r] for r in rivals | {s}}) > 1:
            contested.add(s)
    # groups of contested rows that reach a stored row in common
    left, groups = set(contested), []
    while left:
        group, edge = set(), {left.pop()}
        while edge:
            group |= edge
            near = {r for s in edge for i in reach[s] for r in reached[i]} & left
            left -= near
            edge = near
        groups.append(group)
    for group in groups:
        won = {taken[s] for s in group}
        named = {s: [i for i in reach[s] if facts[s, i].named] for s in group}
        sure = len(group) > 1 and all(len(n) == 1 and n[0] in won for n in named.values()) and {n[0] for n in named.values()} == won
        if sure and all(sum(facts[r, i].named for r in reached[i]) == 1 for i in won):
            for s in group:
                taken[s] = named[s][0]
            contested -= group
    out = [(s, taken[s], _STATUS[facts[s, taken[s]].offset]) if s in taken and s not in contested else (s, None, "ambiguous") for s in sorted(by_row)]
    return pd.DataFrame(out, columns=["stmt_idx", "id", "status"]).astype({"id": "Int64"})


def reconcile(rows: DataFrame, txns: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(stmt_idx, id, status) of every card statement row; rows without candidates are missing.

    A row whose stored rows no other row can reach takes the first that fits, by windows alone.  The others meet within one
    account, direction and amount, and a task holds a batch of such groups at a time."""
    keys = ["account_id", "direction", "amount"]

    def each(pairs: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([assign(p) for _, p in pairs.groupby(keys)])

    pairs = judged_pairs(rows, txns, accounts, cards).repartition(*keys)
    pairs = pairs.withColumn("_reach", F.count(F.lit(1)).over(Window.partitionBy(*keys, "id"))).withColumn("_most", F.max("_reach").over(Window.partitionBy(*keys, "stmt_idx")))
    order = F.when(F.col("offset") == 0, 0).when(F.col("offset") == -1, 1).otherwise(2)
    alone = pairs.where("_most = 1").groupBy("stmt_idx").agg(F.min(F.when(F.col("fits"), F.struct(order.alias("o"), F.col("id").alias("id")))).alias("p"))
    alone = alone.select("stmt_idx", F.col("p.id").alias("id"), F.when(F.col("p").isNull(), "ambiguous").otherwise(F.element_at(F.array(*[F.lit(v) for v in ("date", "date-1", "date+1")]), F.coalesce(F.col("p.o"), F.lit(0)) + 1)).alias("status"))
    met = whole_groups(pairs.where("_most > 1").drop("_reach", "_most"), keys, each, "stmt_idx long, id long, status string")
    found = alone.unionByName(met)
    return rows.select(F.col("stmt_idx").alias("_s")).join(found, F.col("_s") == F.col("stmt_idx"), "left").select(F.col("_s").alias("stmt_idx"), "id", F.coalesce("status", F.lit("missing")).alias("status"))


def preview(rows: DataFrame, txns: DataFrame, days: int = 7) -> DataFrame:
    """Stored rows that a reconciliation looks at: those of the account around the statement's dates, and those of its rows'
    references whatever their date; each once."""
    span = rows.groupBy(F.col("account_id").alias("_a")).agg(F.date_sub(F.min("date"), days).alias("_lo"), F.date_add(F.max("date"), days).alias("_hi"))
    near = txns.join(span, (F.col("account_id") == F.col("_a")) & F.col("transaction_date").between(F.col("_lo"), F.col("_hi"))).select("id")
    refs = rows.where("trim(coalesce(reference_number, '')) <> ''").select(F.col("account_id").alias("_a"), F.trim("reference_number").alias("_r")).distinct()
    named = txns.join(refs, (F.col("account_id") == F.col("_a")) & (F.trim("reference_number") == F.col("_r"))).select("id")
    return near.unionByName(named).distinct()


# ---- payments and reminders


def payments_panel(uploads: DataFrame, settled: DataFrame, pending: DataFrame) -> DataFrame:
    """For each statement with a due date: how many credits settle its cycle and for how much, how many announced ones of the
    cycle wait that no settled one equals (amount, within three days), and what remains of its total."""
    w = cycles(uploads)
    inside = lambda d: (F.col("account_id") == F.col("_a")) & (F.col(d) >= F.col("start")) & (F.col("end").isNull() | (F.col(d) < F.col("end")))
    c = settled.select(F.col("account_id").alias("_a"), F.col("date").alias("_d"), F.col("amount").alias("_m"))
    hit = w.select("id", "account_id", "start", "end").join(c, inside("_d"))
    paid = hit.groupBy(F.col("id").alias("_p")).agg(F.count(F.lit(1)).cast("bigint").alias("settled"), F.sum("_m").alias("paid"))
    p = pending.select(F.col("id").alias("_pid"), F.col("account_id").alias("_a"), F.col("date").alias("_d"), F.col("amount").alias("_m"))
    open_ = w.select("id", "account_id", "start", "end").join(p, inside("_d"))
    s = hit.select(F.col("id").alias("_sid"), F.col("_d").alias("_sd"), F.col("_m").alias("_sm"))
    near = open_.join(s, (F.col("id") == F.col("_sid")) & (F.col("_m") == F.col("_sm")) & (F.abs(F.datediff("_d", "_sd")) <= 3), "left_anti")
    waits = near.groupBy(F.col("id").alias("_w")).agg(F.count(F.lit(1)).cast("bigint").alias("pending"))
    out = w.join(paid, F.col("id") == F.col("_p"), "left").join(waits, F.col("id") == F.col("_w"), "left")
    rest = F.greatest(F.col("amount_due") - F.coalesce("payment_paid_amount", F.lit(0)), F.lit(0))
    return out.select("id", F.coalesce("settled", F.lit(0)).alias("settled"), paise(F.col("paid")).alias("settled_paise"), F.coalesce("pending", F.lit(0)).alias("pending"), F.when(F.col("amount_due").isNotNull(), paise(rest)).alias("remaining_paise"))


def reminder_run(uploads: DataFrame, today: str, offsets: tuple[int, ...] = (7, 3, 1, 0), sent: str = "sent_offsets", stale_days: int = STALE_DAYS) -> DataFrame:
    """What a reminder run does with the latest open statement of each account: its state after (late once the due date is past,
    paid where nothing is due), whether it is announced (once a run), and the offsets that are done.  Statements stale for
    more than a week, or without due date or amount, stay out."""
    day = F.lit(today).cast("date")
    own = parsed(uploads).where(F.col("payment_status").isin("unpaid", "partially_paid", "late") & F.col("due").isNotNull())
    latest = own.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("due").desc(), F.col("id").desc()))).where("_r = 1")
    fresh = latest.where((F.datediff(day, "due") <= stale_days) & F.col("amount_due").isNotNull())
    status = F.when(F.col("amount_due") <= 0, "paid").when(day > F.col("due"), "late").otherwise(F.col("payment_status"))
    done = F.coalesce(F.col(sent), F.array().cast("array<int>"))
    todo = F.filter(F.array(*[F.lit(o) for o in offsets]), lambda o: ~F.array_contains(done, o))
    passed = F.filter(todo, lambda o: (status == "late") & (o > 0))
    reached = F.filter(todo, lambda o: ~((status == "late") & (o > 0)) & (F.datediff(F.col("due"), day) <= o))
    moved = F.when(status == "paid", done).otherwise(F.array_sort(F.array_union(done, F.array_union(passed, reached))))
    return fresh.select("account_id", F.col("id").alias("statement_id"), status.alias("status"), ((status != "paid") & (F.size(reached) > 0)).alias("announce"), moved.alias("sent"))


def tracking(uploads: DataFrame, txns: DataFrame) -> DataFrame:
    """Payment state of every statement with a due date, taken anew from the credits of its cycle: paid amount, state (a statement
    that nothing was due on is paid; without an amount it has none)."""
    w = cycles(uploads)
    c = txns.where(F.col("direction") == "credit").select(F.col("account_id").alias("_a"), F.coalesce("transaction_date", F.to_date("created_at")).alias("_d"), F.col("amount").alias("_m"))
    hit = w.join(c, (F.col("account_id") == F.col("_a")) & (F.col("_d") >= F.col("start")) & (F.col("end").isNull() | (F.col("_d") < F.col("end"))), "left")
    g = hit.groupBy("id", "amount_due").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_paid"))
    status = F.when(F.col("amount_due").isNull(), F.lit(None)).when((F.col("amount_due") <= 0) | (F.col("_paid") >= F.col("amount_due")), "paid").when(F.col("_paid") > 0, "partially_paid").otherwise("unpaid")
    return g.select("id", paise(F.col("_paid")).alias("paid_paise"), status.alias("payment_status"))
