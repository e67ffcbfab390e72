"""Statements: parsed uploads, billing cycles, outstanding amounts, candidate matching and greedy reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import paise, parse_amount, parse_day_first
from tallyspark.operators import evidence


def parsed(uploads: DataFrame) -> DataFrame:
    """Uploads with due (date) and amount_due (decimal); what doesn't parse is null."""
    return uploads.withColumn("due", parse_day_first(F.col("due_date"))).withColumn("amount_due", parse_amount(F.col("total_amount_due")))


def cycles(uploads: DataFrame) -> DataFrame:
    """Half-open payment windows [start, end) of uploads with a due date: from the day after the previous due date of the
    account (its own creation where there is none) to the day after its own; the latest is open."""
    w = Window.partitionBy("account_id").orderBy("due", "id")
    own = parsed(uploads).where("due is not null")
    start = F.coalesce(F.date_add(F.lag("due").over(w), 1), F.col("created_on"))
    end = F.when(F.lead("due").over(w).isNotNull(), F.date_add("due", 1))
    return own.select("id", "account_id", "due", "amount_due", "payment_status", "payment_paid_amount", start.alias("start"), end.alias("end"))


def cycle_payments(windows: DataFrame, txns: DataFrame) -> DataFrame:
    """Credits of each cycle, dated rows by date and undated ones by creation, and the status they amount to."""
    t = txns.where(F.col("direction") == "credit").select(F.col("account_id").alias("_a"), F.coalesce("transaction_date", F.to_date("created_at")).alias("_d"), "amount")
    hit = windows.join(t, (F.col("account_id") == F.col("_a")) & (F.col("_d") >= F.col("start")) & (F.col("end").isNull() | (F.col("_d") < F.col("end"))), "left")
    g = hit.groupBy("id", "account_id", "amount_due").agg(F.sum("amount").alias("paid"), F.count("amount").cast("bigint").alias("payments"))
    paid = F.coalesce("paid", F.lit(0))
    status = F.when(F.col("amount_due").isNull(), F.lit(None)).when(paid >= F.col("amount_due"), "paid").when(paid > 0, "partially_paid").otherwise("unpaid")
    return g.select("id", "account_id", paise(F.col("paid")).alias("paid_paise"), "payments", status.alias("status"))


def outstanding(uploads: DataFrame, today: str) -> DataFrame:
    """The latest statement of each account (by due date, first id on ties) with what is still owed."""
    latest = parsed(uploads).where("due is not null").withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("due").desc(), "id"))).where("_r = 1")
    owed = F.when((F.col("payment_status") == "paid") | (F.col("amount_due") <= 0), 0).otherwise(F.greatest(F.col("amount_due") - F.coalesce("payment_paid_amount", F.lit(0)), F.lit(0)))
    owed = F.when(F.col("amount_due").isNotNull(), owed)
    return latest.select("account_id", F.col("id").alias("statement_id"), "due", paise(owed).alias("outstanding_paise"), (F.coalesce(owed > 0, F.lit(False)) & (F.col("due") < F.lit(today).cast("date"))).alias("overdue"))


def outstanding_totals(uploads: DataFrame, today: str) -> DataFrame:
    """One row: what all cards owe, and how many owe something, nothing, or are overdue; amounts that don't parse are in none."""
    own = outstanding(uploads, today).join(parsed(uploads).where("amount_due is not null").select(F.col("id").alias("_i")), F.col("statement_id") == F.col("_i"), "left_semi")
    return own.agg(F.coalesce(F.sum("outstanding_paise"), F.lit(0)).cast("bigint").alias("total_paise"), F.count_if(F.col("outstanding_paise") > 0).cast("bigint").alias("owing"), F.count_if(F.col("outstanding_paise") == 0).cast("bigint").alias("settled"), F.count_if("overdue").cast("bigint").alias("overdue"))


def reminders(uploads: DataFrame, today: str, offsets: tuple[int, ...] = (7, 3, 1, 0)) -> DataFrame:
    """Statements to remind of today: the latest of an account, not paid, and so many days before its due date."""
    days = F.datediff(F.col("due"), F.lit(today).cast("date"))
    return outstanding(uploads, today).where((F.col("outstanding_paise") > 0) & days.isin(*offsets)).select("account_id", "statement_id", days.alias("days_left"))


def candidates(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """(stmt_idx, id, offset, reference) of stored rows with the same account, direction and amount within a day; the
    range is three exact dates, so the join stays an equi-join."""
    spread = rows.select("stmt_idx", F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.col("amount").alias("_m"), F.col("date").alias("_date"), F.trim("reference_number").alias("_ref"), F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("offset"))
    spread = spread.withColumn("_on", F.date_add("_date", F.col("offset")))
    hit = spread.join(txns, (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("direction")) & (F.col("_m") == F.col("amount")) & (F.col("_on") == F.col("transaction_date")))
    return hit.select("stmt_idx", "id", "account_id", "offset", F.coalesce(F.col("_ref") == F.trim("reference_number"), F.lit(False)).alias("same_reference"))


def reference_pairs(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """(stmt_idx, id, account_id, direction, amount, same_amount) of stored rows with the same account, direction and reference,
    whatever their date; the direction counts, as a refund can have the reference of its payment."""
    s = rows.select("stmt_idx", F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.col("amount").alias("_m"), F.trim("reference_number").alias("_ref")).where("_ref <> ''")
    t = txns.select("id", "account_id", "direction", F.col("amount").alias("_tm"), F.trim("reference_number").alias("_r"))
    hit = s.join(t, (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("direction")) & (F.col("_ref") == F.col("_r")))
    return hit.select("stmt_idx", "id", "account_id", "direction", F.col("_m").alias("amount"), F.coalesce(F.col("_m") == F.col("_tm"), F.lit(False)).alias("same_amount"))


def extra(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """Stored rows inside a statement's dates that no statement row can be."""
    span = rows.groupBy(F.col("account_id").alias("_a")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = txns.join(span, (F.col("account_id") == F.col("_a")) & F.col("transaction_date").between(F.col("lo"), F.col("hi"))).drop("_a", "lo", "hi")
    return inside.join(candidates(rows, txns).select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").select("id", "account_id")


def certain_extra(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """``extra`` without those that a row of uncertain direction (column ``uncertain``) could be, by amount within a day."""
    vague = rows.where("uncertain").select(F.col("account_id").alias("_a"), F.col("amount").alias("_m"), F.col("date").alias("_date"), F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("_o"))
    vague = vague.select("_a", "_m", F.date_add("_date", F.col("_o")).alias("_on")).distinct()
    own = extra(rows, txns).select(F.col("id").alias("_x"))
    left = txns.join(own, F.col("id") == F.col("_x"), "left_semi").join(vague, (F.col("account_id") == F.col("_a")) & (F.col("amount") == F.col("_m")) & (F.col("transaction_date") == F.col("_on")), "left_anti")
    return left.select("id", "account_id")


def judged(rows: DataFrame, txns: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``candidates`` with fits (the evidence lets the stored row be the statement's) and strong (one's reference stands in
    the other's text).  Columns that a table lacks count as null."""
    has = lambda df, name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    ref = F.nullif(F.trim("reference_number"), F.lit(""))
    stmt = rows.select(F.col("stmt_idx").alias("_s"), ref.alias("_sr"), has(rows, "narration", "string").alias("_st"), has(rows, "balance", "decimal(20,2)").alias("_sb"), has(rows, "channel", "string").alias("_sc"), F.col("direction").alias("_sd"), F.col("amount").alias("_sm"))
    text = F.coalesce(has(txns, "raw_description", "string"), has(txns, "counterparty", "string"))
    own = txns.select(F.col("id").alias("_t"), ref.alias("_tr"), text.alias("_tt"), has(txns, "balance", "decimal(20,2)").alias("_tb"), has(txns, "channel", "string").alias("_tc"))
    j = candidates(rows, txns).join(stmt, F.col("stmt_idx") == F.col("_s")).join(own, F.col("id") == F.col("_t"))
    fits = evidence.compatible(F.col("_sr"), F.col("_st"), F.col("_sb"), F.col("_sc"), F.col("_tr"), F.col("_tt"), F.col("_tb"), F.col("_tc"), F.col("offset") != 0, list(leave_out))
    strong = evidence.reference_in(F.col("_tr"), F.col("_st")) | evidence.reference_in(F.col("_sr"), F.col("_tt"))
    return j.select("stmt_idx", "id", "offset", F.coalesce(F.col("_sr") == F.col("_tr"), F.lit(False)).alias("same_reference"), F.coalesce(fits, F.lit(False)).alias("fits"), strong.alias("strong"), "account_id", F.col("_sd").alias("direction"), F.col("_sm").alias("amount"))


def identity(rows: DataFrame) -> Column:
    """What a statement row would bring to a stored one: counterparty or else narration, and channel; null where it has none."""
    has = lambda name: F.trim(F.coalesce(F.col(name) if name in rows.columns else F.lit(None).cast("string"), F.lit("")))
    text = F.concat_ws("\1", F.coalesce(F.nullif(has("counterparty"), F.lit("")), has("narration")), has("channel"))
    return F.when(text != "\1", text)


#: The date passes in their order: status and offset.
PASSES = (("date", 0), ("date-1", -1), ("date+1", 1))


def reconcile(rows: DataFrame, txns: DataFrame) -> DataFrame:
    """Statement rows assigned to stored rows: unique references of equal amount first, whatever the date, then the first of the
    offsets 0, -1, +1 where one compatible candidate is left, among those with strong evidence where there are any.

    A row that picks what another row without a reference match can reach at any offset is ambiguous, unless all rows that
    reach it have one identity (``identity``): of such, any pairing brings the same, so the first that picks it has it and the
    next ones look further.  A row with candidates and no pick is ambiguous, also where all it has is its reference under
    another amount; a row without any is missing.  Every step is a count over the pairs of one statement row or one stored row, so
    no account, amount or day has to fit in a task."""
    near, told = judged(rows, txns), reference_pairs(rows, txns)
    known = near.select(F.col("stmt_idx").alias("_s"), F.col("id").alias("_t"))
    far = told.where("same_amount").join(known, (F.col("stmt_idx") == F.col("_s")) & (F.col("id") == F.col("_t")), "left_anti")
    far = far.select("stmt_idx", "id", F.lit(None).cast("int").alias("offset"), F.lit(True).alias("same_reference"), F.lit(False).alias("fits"), F.lit(False).alias("strong"))
    who = rows.select(F.col("stmt_idx").alias("_w"), identity(rows).alias("who"))
    p = near.select(*far.columns).unionByName(far).join(who, F.col("stmt_idx") == F.col("_w")).drop("_w")
    mine, its = Window.partitionBy("stmt_idx"), Window.partitionBy("id")
    once = lambda flag, w: F.count_if(flag).over(w) == 1
    p = p.withColumn("_told", F.col("same_reference") & once(F.col("same_reference"), mine)).withColumn("_told", F.col("_told") & once(F.col("same_reference"), its)).withColumn("_gone", F.bool_or("_told").over(its))
    p = p.withColumn("_live", F.col("fits") & ~F.bool_or("_told").over(mine))
    live = F.when(F.col("_live"), F.coalesce("who", F.lit("")))
    alike = (F.min(live).over(its) == F.max(live).over(its)) & (F.max(live).over(its) != "")
    p = p.withColumn("_held", (F.count_if(F.col("_live")).over(its) > 1) & ~F.coalesce(alike, F.lit(False))).withColumn("_open", F.col("_live") & ~F.col("_gone")).withColumn("status", F.when(F.col("_told"), "reference"))
    for status, offset in PASSES:
        here = F.col("_open") & F.coalesce(F.col("offset") == offset, F.lit(False))
        p = p.withColumn("_here", here & (F.col("strong") | ~F.bool_or(here & F.col("strong")).over(mine)))
        p = p.withColumn("_sole", F.col("_here") & once(F.col("_here"), mine))
        p = p.withColumn("_pick", F.col("_sole") & (F.col("_held") | (F.col("stmt_idx") == F.min(F.when(F.col("_sole"), F.col("stmt_idx"))).over(its))))
        p = p.withColumn("status", F.when(F.col("_pick") & ~F.col("_held"), status).otherwise(F.col("status"))).withColumn("_open", F.col("_open") & ~F.bool_or("_pick").over(its)).withColumn("_open", F.col("_open") & ~F.bool_or("_pick").over(mine))
    found = p.groupBy("stmt_idx").agg(F.max("status").alias("status"), F.max(F.when(F.col("status").isNotNull(), F.col("id"))).alias("id"), F.bool_or(F.col("fits") | F.col("same_reference")).alias("_any"))
    other = told.where("not same_amount").select(F.col("stmt_idx").alias("_o")).distinct()
    out = rows.select(F.col("stmt_idx").alias("_s")).join(found, F.col("_s") == F.col("stmt_idx"), "left").join(other, F.col("_s") == F.col("_o"), "left")
    ambiguous = F.when(F.col("_o").isNotNull() | F.coalesce("_any", F.lit(False)), "ambiguous")
    return out.select(F.col("_s").alias("stmt_idx"), "id", F.coalesce("status", ambiguous, F.lit("missing")).alias("status"))


def whole_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over sorted batches of rows that hold whole groups of ``keys``: a batch's last group waits for the next batch, so
    memory is bounded by a batch and the largest group, and small groups cost no call each."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for f in frames:
            f = f if left is None else pd.concat([left, f], ignore_index=True)
            if not len(f):
                continue
            last = pd.Series(True, index=f.index)
            for k in keys:
                last &= f[k].isna() if pd.isna(f[k].iloc[-1]) else f[k] == f[k].iloc[-1]
            left = f[last]
            if not last.all():
                yield run(f[~last])
        if left is not None and len(left):
            yield run(left)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(over, schema)


def balance_check(rows: DataFrame) -> DataFrame:
    """Credits, debits and net of each account's statement rows."""
    credit, debit = F.sum(F.when(F.col("direction") == "credit", F.col("amount"))), F.sum(F.when(F.col("direction") == "debit", F.col("amount")))
    return rows.groupBy("account_id").agg(paise(credit).alias("credits"), paise(debit).alias("debits"), F.count(F.lit(1)).cast("bigint").alias("n")).withColumn("net", F.col("credits") - F.col("debits"))
