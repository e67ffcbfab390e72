"""Registered queries of card statements: reconciliation, previews, payments and reminders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import card_statements
from tallyspark.plans.catalogue import _CYCLES, _DUE, _OWED, _fits, _mask, _paise, _query


def _rows(t):
    """Statement rows of one amount a direction for many, so that rows contend."""
    i = F.col("stmt_idx")
    card = F.when(i % 3 == 0, F.concat(F.lit("XX"), F.right(F.lpad(F.col("account_id").cast("string"), 10, "7"), F.lit(4)))).when(i % 3 == 1, "XX12")
    return t["bank_statement_rows"].withColumn("card_number", card)


@_query()
def card_reconcile(t):
    return card_statements.reconcile(_rows(t), t["transactions"], t["accounts"], t["cards"])


_PAIRS = f"""SELECT r.stmt_idx, t.id, cast(date_diff('day', r.date, t.transaction_date) AS INTEGER) AS "offset", {_mask('r.card_number')} AS sm, {_mask('t.card_mask')} AS tm, t.account_id FROM (SELECT *, CASE stmt_idx % 3 WHEN 0 THEN 'XX' || right(lpad(cast(account_id AS VARCHAR), 10, '7'), 4) WHEN 1 THEN 'XX12' END AS card_number FROM bank_statement_rows) r
    JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND t.amount = r.amount AND abs(date_diff('day', r.date, t.transaction_date)) <= 1"""
_KNOWN = f"SELECT id AS account_id, {_mask('account_number')} AS m FROM accounts UNION SELECT account_id, {_mask('card_mask')} FROM cards"


@_query(f"""SELECT p.stmt_idx, p.id, p."offset", p.tm = '' OR count(k.m) = 0 OR bool_or(coalesce({_fits('p.tm', 'k.m')}, false)) AS fits, p.sm <> '' AND p.tm <> '' AND NOT {_fits('p.sm', 'p.tm')} AS other FROM ({_PAIRS}) p LEFT JOIN (SELECT * FROM ({_KNOWN}) WHERE m <> '') k ON k.account_id = p.account_id GROUP BY p.stmt_idx, p.id, p."offset", p.sm, p.tm""")
def card_candidates(t):
    return card_statements.judged_pairs(_rows(t), t["transactions"], t["accounts"], t["cards"]).select("stmt_idx", "id", "offset", "fits", "other")


@_query("""SELECT id FROM transactions t WHERE EXISTS (SELECT 1 FROM (SELECT account_id, min(date) - 7 AS lo, max(date) + 7 AS hi FROM bank_statement_rows GROUP BY 1) s WHERE s.account_id = t.account_id AND t.transaction_date BETWEEN lo AND hi)
    OR EXISTS (SELECT 1 FROM bank_statement_rows r WHERE r.account_id = t.account_id AND trim(coalesce(r.reference_number, '')) <> '' AND trim(r.reference_number) = trim(t.reference_number))""")
def reconcile_preview(t):
    return card_statements.preview(t["bank_statement_rows"], t["transactions"])


_WIN = f"SELECT w.*, p.payment_paid_amount FROM ({_CYCLES}) w JOIN statement_uploads p ON p.id = w.id"
_SET = f"SELECT w.id, t.transaction_date AS d, t.amount AS m FROM ({_CYCLES}) w JOIN transactions t ON t.account_id = w.account_id AND t.direction = 'credit' AND t.transaction_date >= w.start AND (w.end_ IS NULL OR t.transaction_date < w.end_)"


@_query(f"""SELECT w.id, coalesce(s.n, 0) AS settled, {_paise('s.paid')} AS settled_paise, coalesce(p.n, 0) AS pending, CASE WHEN w.amount_due IS NOT NULL THEN {_paise('greatest(w.amount_due - coalesce(w.payment_paid_amount, 0), 0)')} END AS remaining_paise FROM ({_WIN}) w LEFT JOIN (SELECT id, count(*) AS n, sum(m) AS paid FROM ({_SET}) GROUP BY 1) s ON s.id = w.id
    LEFT JOIN (SELECT o.id, count(*) AS n FROM (SELECT w.id, t.transaction_date + 2 AS d, t.amount + CASE WHEN t.id % 2 = 0 THEN 0 ELSE 1 END AS m FROM ({_CYCLES}) w JOIN transactions t ON t.account_id = w.account_id AND t.direction = 'credit' AND t.transaction_date + 2 >= w.start AND (w.end_ IS NULL OR t.transaction_date + 2 < w.end_)) o
      WHERE NOT EXISTS (SELECT 1 FROM ({_SET}) s WHERE s.id = o.id AND s.m = o.m AND abs(date_diff('day', s.d, o.d)) <= 3) GROUP BY 1) p ON p.id = w.id""")
def payments_panel(t):
    credit = t["transactions"].where("direction = 'credit' and transaction_date is not null and account_id is not null")
    settled = credit.select("account_id", F.col("transaction_date").alias("date"), "amount")
    pending = credit.select("id", "account_id", F.date_add("transaction_date", 2).alias("date"), (F.col("amount") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)).cast("decimal(12,2)").alias("amount"))
    return card_statements.payments_panel(t["statement_uploads"], settled, pending)


@_query(f"""SELECT account_id, statement_id, status, status <> 'paid' AND len(reached) > 0 AS announce, array_to_string(CASE WHEN status = 'paid' THEN done ELSE list_sort(list_distinct(list_concat(done, passed, reached))) END, ',') AS sent FROM (SELECT *, list_filter(todo, lambda o: status = 'late' AND o > 0) AS passed, list_filter(todo, lambda o: NOT (status = 'late' AND o > 0) AND DATE '1998-06-01' >= due - cast(o AS INTEGER)) AS reached FROM (
    SELECT *, list_filter([7, 3, 1, 0], lambda o: NOT list_contains(done, o)) AS todo, CASE WHEN owed <= 0 THEN 'paid' WHEN DATE '1998-06-01' > due THEN 'late' ELSE payment_status END AS status FROM (SELECT account_id, id AS statement_id, due, owed, payment_status, CASE WHEN id % 2 = 0 THEN [7] ELSE [] END AS done, row_number() OVER (PARTITION BY account_id ORDER BY due DESC, id DESC) AS r
      FROM (SELECT account_id, id, payment_status, {_DUE} AS due, CASE WHEN id % 7 = 0 THEN 0 ELSE {_OWED} END AS owed FROM statement_uploads) WHERE due IS NOT NULL AND due < DATE '1998-06-20' AND payment_status IN ('unpaid', 'partially_paid', 'late')) WHERE r = 1 AND date_diff('day', due, DATE '1998-06-01') <= 400 AND owed IS NOT NULL))""")
def reminder_run(t):
    own = t["statement_uploads"].withColumn("total_amount_due", F.when(F.col("id") % 7 == 0, "0").otherwise(F.col("total_amount_due"))).withColumn("sent_offsets", F.when(F.col("id") % 2 == 0, F.array(F.lit(7))).otherwise(F.array().cast("array<int>")))
    own = own.where(F.coalesce(F.try_to_date("due_date", "dd/MM/yyyy") < F.lit("1998-06-20").cast("date"), F.lit(True)))
    return card_statements.reminder_run(own, "1998-06-01", stale_days=400).withColumn("sent", F.array_join(F.col("sent").cast("array<string>"), ","))


@_query(f"SELECT w.id, {_paise('sum(t.amount)')} AS paid_paise, CASE WHEN w.amount_due IS NULL THEN NULL WHEN w.amount_due <= 0 OR coalesce(sum(t.amount), 0) >= w.amount_due THEN 'paid' WHEN coalesce(sum(t.amount), 0) > 0 THEN 'partially_paid' ELSE 'unpaid' END AS payment_status FROM ({_CYCLES}) w LEFT JOIN (SELECT account_id, coalesce(transaction_date, created_at::DATE) AS d, amount FROM transactions WHERE direction = 'credit') t ON t.account_id = w.account_id AND t.d >= w.start AND (w.end_ IS NULL OR t.d < w.end_) GROUP BY w.id, w.amount_due")
def payment_tracking(t):
    return card_statements.tracking(t["statement_uploads"], t["transactions"])
