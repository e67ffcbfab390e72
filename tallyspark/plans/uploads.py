"""Registered queries over statement uploads, their accounts, balances and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.operators import listing, networth, statements, uploads
from tallyspark.plans.catalogue import _DUE, _OWED, _fits, _mask, _paise, _query

_L4 = lambda c: f"nullif(regexp_extract(regexp_replace(coalesce({c}, ''), '[ -]', '', 'g'), '([0-9]{{4}})$', 1), '')"
_STMT = "id, account_id, bank, CASE id % 6 WHEN 0 THEN 'XX' || lpad(cast(account_id % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'XXXX XXXX XXXX ' || lpad(cast((account_id * 7) % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN 'XX' || lpad(cast(account_id % 100 AS VARCHAR), 2, '0') WHEN 3 THEN '5100XXXXXXXX' WHEN 4 THEN '' END AS mask"


def _statements(t):
    k = F.col("account_id")
    mask = F.when(F.col("id") % 6 == 0, F.concat(F.lit("XX"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(F.col("id") % 6 == 1, F.concat(F.lit("XXXX XXXX XXXX "), F.lpad(((k * 7) % 10000).cast("string"), 4, "0"))).when(
        F.col("id") % 6 == 2, F.concat(F.lit("XX"), F.lpad((k % 100).cast("string"), 2, "0"))).when(F.col("id") % 6 == 3, "5100XXXXXXXX").when(F.col("id") % 6 == 4, "")
    return t["statement_uploads"].select("id", "account_id", "bank", mask.alias("mask"))


@_query("SELECT id, right(account_number, 4) AS last4 FROM accounts")
def account_last4(t):
    return t["accounts"].select("id", uploads.last_four(F.col("account_number")).alias("last4"))


@_query("SELECT id, CASE WHEN length(payload) <= 20 THEN payload END AS payload, CASE WHEN payload IS NULL THEN 'absent' WHEN length(payload) > 20 THEN 'too_large' ELSE 'present' END AS state FROM bank_uploads")
def upload_payloads(t):
    return t["bank_uploads"].select("id", *uploads.bounded_payload(F.col("payload"), 20))


@_query("SELECT id, CASE WHEN portfolio_ok THEN 'parsed' ELSE 'invalid' END AS status FROM cas_uploads")
def cas_statuses(t):
    return t["cas_uploads"].select("id", uploads.upload_status(F.col("portfolio_ok")).alias("status"))


@_query("SELECT u.id, a.label AS account_label, a.bank AS account_bank FROM bank_uploads u LEFT JOIN accounts a ON a.id = u.account_id AND a.id % 5 <> 0")
def uploads_with_accounts(t):
    return uploads.with_account(t["bank_uploads"], t["accounts"].where("id % 5 <> 0")).select("id", "account_label", "account_bank")


@_query(f"SELECT account_id, id FROM (SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY coalesce({_DUE}, created_on) DESC, created_on DESC, id DESC) AS r FROM statement_uploads) WHERE r = 1")
def latest_uploads(t):
    return uploads.latest_uploads(t["statement_uploads"])


@_query("""SELECT account_id, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p ELSE lo END AS first_date, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN q ELSE hi END AS last_date FROM (SELECT account_id, min(date) AS lo, max(date) AS hi, max(try_strptime(CASE WHEN account_id % 2 = 0 THEN strftime(date, '%d/%m/%Y') END, '%d/%m/%Y')::DATE) AS p,
    max(try_strptime(CASE WHEN account_id % 2 = 0 THEN strftime(date, '%d/%m/%Y') ELSE 'later' END, '%d/%m/%Y')::DATE) AS q FROM bank_statement_rows GROUP BY 1)""")
def statement_ranges(t):
    printed = F.when(F.col("account_id") % 2 == 0, F.date_format("date", "dd/MM/yyyy"))
    rows = t["bank_statement_rows"].withColumn("p", printed).withColumn("q", F.coalesce(printed, F.lit("later")))
    return uploads.statement_ranges(rows, "account_id", "date", ("p", "q"))


_CLOSING, _END = "try_cast(replace(closing_balance, ',', '') AS DECIMAL(16, 2))", "try_strptime(period_end, '%d/%m/%Y')::DATE"
_BANKSNAP = f"SELECT account_id, 'asset' AS kind, 'bank_balance' AS category, d AS as_of_date, {_paise('v')} AS value_paise, id AS upload_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id, d ORDER BY id DESC) AS r FROM (SELECT id, account_id, {_CLOSING} AS v, {_END} AS d FROM bank_uploads) WHERE v IS NOT NULL AND d IS NOT NULL) WHERE r = 1"


@_query(_BANKSNAP)
def bank_snapshots(t):
    return uploads.bank_snapshots(t["bank_uploads"])


@_query(f"""SELECT account_id, kind, category, as_of_date, value_paise FROM ({_BANKSNAP}) UNION ALL SELECT account_id, 'liability', 'cc_outstanding', created_on, {_paise("CASE WHEN payment_status = 'paid' OR due <= 0 THEN 0 ELSE greatest(due - coalesce(payment_paid_amount, 0), 0) END")} FROM (SELECT *, row_number() OVER (PARTITION BY account_id, created_on ORDER BY id DESC) AS r FROM (SELECT *, {_OWED} AS due FROM statement_uploads) WHERE due IS NOT NULL) WHERE r = 1""")
def snapshot_backfill(t):
    return networth.backfill(t["bank_uploads"], t["statement_uploads"])


_MATCH = f"""SELECT s.id, k.account_id FROM (SELECT id, bank, {_mask('mask')} AS m FROM (SELECT {_STMT} FROM statement_uploads)) s JOIN (SELECT a.bank, x.account_id, x.m FROM (SELECT id AS account_id, {_mask('account_number')} AS m FROM accounts UNION SELECT account_id, {_mask('card_mask')} FROM cards) x JOIN accounts a ON a.id = x.account_id AND a.type = 'credit_card' AND coalesce(a.active, true)) k
    ON k.bank = s.bank AND k.m <> '' AND s.m <> '' AND regexp_matches(k.m, '[0-9]$') AND regexp_matches(s.m, '[0-9]$') AND {_fits('s.m', 'k.m')}"""


@_query(f"SELECT s.id, CASE WHEN m.n = 1 THEN m.a END AS account_id, coalesce(m.n, 0) AS matches FROM statement_uploads s LEFT JOIN (SELECT id, count(DISTINCT account_id) AS n, min(account_id) AS a FROM ({_MATCH}) GROUP BY 1) m ON m.id = s.id")
def statement_accounts(t):
    return uploads.account_of_mask(_statements(t), t["accounts"], t["cards"])


@_query(f"""SELECT s.id, regexp_matches(s.m, '[0-9]') AND count(k.m) > 0 AND NOT coalesce(bool_or({_fits('s.m', 'k.m')}), false) AS refuted FROM (SELECT id, account_id, {_mask('mask')} AS m FROM (SELECT {_STMT} FROM statement_uploads)) s
    LEFT JOIN (SELECT * FROM (SELECT id AS account_id, {_mask('account_number')} AS m FROM accounts UNION SELECT account_id, {_mask('card_mask')} FROM cards) WHERE m <> '') k ON k.account_id = s.account_id GROUP BY s.id, s.m""")
def refuted_statements(t):
    return uploads.refuted(_statements(t), t["accounts"], t["cards"])


@_query(f"""SELECT s.id, coalesce(own, near, al4) AS last4, CASE WHEN own IS NOT NULL THEN 'printed' WHEN near IS NOT NULL THEN 'card' WHEN al4 IS NOT NULL THEN 'account' END AS step FROM (SELECT id, account_id, {_L4('mask')} AS own, regexp_replace(coalesce(mask, ''), '[^0-9]', '', 'g') AS part FROM (SELECT {_STMT} FROM statement_uploads)) s
    LEFT JOIN (SELECT s.id, min_by({_L4('c.card_mask')}, c.id) AS near FROM (SELECT id, account_id, {_L4('mask')} AS own, regexp_replace(coalesce(mask, ''), '[^0-9]', '', 'g') AS part FROM (SELECT {_STMT} FROM statement_uploads)) s JOIN cards c ON c.account_id = s.account_id AND own IS NULL AND part <> '' AND ends_with({_L4('c.card_mask')}, part) GROUP BY 1) n ON n.id = s.id
    LEFT JOIN (SELECT id, {_L4('account_number')} AS al4 FROM accounts) a ON a.id = s.account_id""")
def statement_cards(t):
    return uploads.card_of_statement(_statements(t), t["accounts"], t["cards"])


@_query(f"""SELECT s.id, coalesce(f.a, o.a) AS account_id FROM (SELECT u.id, c.bank, CASE u.id % 3 WHEN 0 THEN 'XX' || right(c.account_number, 4) WHEN 1 THEN right(c.account_number, 3) END AS mask FROM bank_uploads u JOIN accounts c ON c.id = u.account_id) s
    LEFT JOIN (SELECT s.id, min(a.id) AS a FROM (SELECT u.id, c.bank, CASE u.id % 3 WHEN 0 THEN 'XX' || right(c.account_number, 4) WHEN 1 THEN right(c.account_number, 3) END AS mask FROM bank_uploads u JOIN accounts c ON c.id = u.account_id) s JOIN accounts a ON a.bank = s.bank AND a.type = 'bank_account' AND a.active
      AND CASE WHEN {_L4('s.mask')} IS NOT NULL THEN {_L4('s.mask')} = {_L4('a.account_number')} ELSE s.mask <> '' AND contains(a.account_number, s.mask) END GROUP BY 1) f ON f.id = s.id
    LEFT JOIN (SELECT bank, min(id) AS a FROM accounts WHERE type = 'bank_account' AND active GROUP BY 1 HAVING count(*) = 1) o ON o.bank = s.bank""")
def bank_statement_accounts(t):
    c = t["accounts"].select(F.col("id").alias("_c"), "bank", "account_number")
    s = t["bank_uploads"].select("id", "account_id").join(c, F.col("account_id") == F.col("_c"))
    mask = F.when(F.col("id") % 3 == 0, F.concat(F.lit("XX"), F.right("account_number", F.lit(4)))).when(F.col("id") % 3 == 1, F.right("account_number", F.lit(3)))
    return uploads.bank_account_of(s.select("id", "bank", mask.alias("mask")), t["accounts"])


def _decoded(t):
    k, i = F.col("event_id"), F.col("event_id").cast("string")
    text = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "[1]").when(k % 7 == 2, F.concat(F.lit('{"matched": ['), F.repeat(F.lit('{"stmt_idx": 1, "id": 2}, '), F.lit(30)), F.lit('{"stmt_idx": 1, "id": 2}]}'))).otherwise(
        F.concat(F.lit('{"matched": [{"stmt_idx": 1, "id": '), (k % 40).cast("string"), F.lit('}, {"stmt_idx": 2, "id": 5}, {"stmt_idx": 3, "id": '), (k % 40).cast("string"), F.lit('}], "missing": [{"stmt_idx": 4, "duplicate": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}, "),
                 F.lit('{"stmt_idx": 5, "import_failed": '), F.when(k % 3 == 0, "true").otherwise("null"), F.lit("}]}")))
    return uploads.reconciliations(t["events"].select(k.alias("id"), text.alias("data")), "data", 400)


@_query("""SELECT id, state AS recon_state, CASE WHEN ok THEN 2 ELSE 0 END::BIGINT AS missing, d AS duplicates, f AS failures, CASE WHEN NOT ok THEN '' WHEN id % 40 = 5 THEN '5' ELSE (id % 40) || ',5' END AS ids, CASE WHEN d + f > 0 THEN 'Skipped ' || concat_ws(', ', CASE WHEN d > 0 THEN '1 duplicate' END, CASE WHEN f > 0 THEN '1 unexpected error' END) || ' row(s) during auto-import; see reconciliation details.' END AS note
    FROM (SELECT *, CASE WHEN ok AND id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS d, CASE WHEN ok AND id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS f FROM (SELECT event_id AS id, event_id % 7 > 2 AS ok, CASE event_id % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'malformed' WHEN 2 THEN 'too_large' ELSE 'parsed' END AS state FROM events))""")
def reconciliation_summaries(t):
    return uploads.reconciliation_summary(_decoded(t)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@_query("SELECT e.event_id AS upload_id, v.stmt_idx, v.id, t.category, t.counterparty FROM events e, LATERAL (VALUES (1::BIGINT, e.event_id % 40), (2::BIGINT, 5::BIGINT), (3::BIGINT, e.event_id % 40)) AS v(stmt_idx, id) LEFT JOIN transactions t ON t.id = v.id WHERE e.event_id % 7 > 2")
def hydrated_reconciliations(t):
    return uploads.hydrated(_decoded(t), t["transactions"])


@_query(f"""SELECT account_id AS upload_id, {_paise("sum(CASE WHEN id % 3 = 0 AND direction = 'debit' AND id % 5 <> 0 THEN amount END)")} AS debit_paise, {_paise("sum(CASE WHEN id % 3 = 0 AND direction = 'credit' AND id % 5 <> 0 THEN amount END)")} AS credit_paise FROM transactions WHERE account_id IS NOT NULL GROUP BY 1""")
def adjustment_totals(t):
    shown = lambda d: F.when(F.col("direction") == d, F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.format_number("amount", 2)))
    pairs = t["transactions"].where("account_id is not null").select(F.col("account_id").alias("upload_id"), F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("confidence"), shown("debit").alias("debit"), shown("credit").alias("credit"))
    return uploads.adjustment_totals(pairs)


@_query(f"""SELECT id, {_paise('abs(gap)')} AS gap_paise, abs(gap) < 1 AS closes FROM (SELECT account_id AS id, CASE WHEN account_id % 9 <> 0 THEN 100 + c - d - (100 + c - d + CASE account_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -25 END) END AS gap FROM (SELECT account_id, coalesce(sum(CASE WHEN direction = 'credit' THEN amount END), 0) AS c, coalesce(sum(CASE WHEN direction = 'debit' THEN amount END), 0) AS d FROM bank_statement_rows GROUP BY 1))""")
def statement_closes(t):
    k = F.col("account_id")
    g = t["bank_statement_rows"].groupBy("account_id").agg(F.coalesce(F.sum(F.when(F.col("direction") == "credit", F.col("amount"))), F.lit(0)).alias("credits"), F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount"))), F.lit(0)).alias("debits"))
    off = F.when(k % 4 == 0, F.lit("0.5")).when(k % 4 == 1, F.lit("1")).when(k % 4 == 2, F.lit("0")).otherwise(F.lit("-25")).cast("decimal(10,2)")
    s = g.select(k.alias("id"), F.lit(100).cast("decimal(12,2)").alias("opening"), "credits", "debits", F.when(k % 9 != 0, F.lit(100) + F.col("credits") - F.col("debits") + off).alias("closing"))
    return uploads.closes(s)


@_query("SELECT coalesce(cast(transaction_date AS VARCHAR), '') AS transaction_date, cast(amount AS VARCHAR) AS amount, coalesce(counterparty, '') AS counterparty, count(*) AS n FROM (SELECT transaction_date, amount, CASE WHEN id % 5 = 0 THEN '''=1+1' ELSE counterparty END AS counterparty FROM transactions) GROUP BY 1, 2, 3")
def statement_csv(t):
    rows = t["transactions"].withColumn("counterparty", F.when(F.col("id") % 5 == 0, "=1+1").otherwise(F.col("counterparty")))
    cols = ["transaction_date", "amount", "counterparty"]
    return uploads.csv_rows(rows, cols).groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@_query("""SELECT r.stmt_idx, array_to_string(list_sort(list(DISTINCT t.id))[1:2], ',') AS ids, count(DISTINCT t.id) AS candidates, count(DISTINCT t.id) > 2 AS truncated FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND abs(date_diff('day', r.date, t.transaction_date)) <= 60 GROUP BY 1""")
def evidence_ids(t):
    r = t["bank_statement_rows"].select("stmt_idx", F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.col("date").alias("_on"))
    near = r.join(t["transactions"], (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("direction")) & (F.abs(F.datediff("_on", "transaction_date")) <= 60))
    out = uploads.candidate_evidence(near.select("stmt_idx", "id"), 2)
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@_query("""SELECT stmt_idx, CASE WHEN status = 'ambiguous' THEN 'ambiguous' WHEN bad THEN 'unparseable' WHEN stored OR (ref IS NOT NULL AND row_number() OVER (PARTITION BY account_id, direction, ref, status = 'missing' AND NOT bad AND NOT stored ORDER BY stmt_idx) > 1) THEN 'duplicate' ELSE 'import' END AS action FROM (
    SELECT r.*, CASE r.stmt_idx % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'missing' END AS status, r.stmt_idx % 10 = 0 AS bad, nullif(trim(coalesce(r.reference_number, '')), '') AS ref, EXISTS (SELECT 1 FROM transactions t WHERE t.account_id = r.account_id AND t.direction = r.direction AND trim(coalesce(t.reference_number, '')) <> '' AND trim(t.reference_number) = trim(r.reference_number) AND t.id % 3 = 0 AND t.id % 4 = 0) AS stored FROM bank_statement_rows r) WHERE status IS NOT NULL""")
def import_decisions(t):
    i = F.col("stmt_idx")
    rows = t["bank_statement_rows"].withColumn("amount", F.when(i % 10 != 0, F.col("amount")))
    status = rows.select("stmt_idx", F.when(i % 4 == 0, "missing").when(i % 4 == 1, "ambiguous").when(i % 4 == 2, "missing").otherwise("date").alias("status"))
    return uploads.importable(rows, status, t["transactions"].where("id % 4 = 0"))


@_query("""SELECT id, CASE WHEN trim(coalesce(told, '')) <> '' AND (low IN ('', 'payment received', 'payment done', 'payment successful') OR (low = 'self' AND lower(trim(told)) = bank || ' fd')) THEN told ELSE own END AS counterparty FROM (SELECT *, lower(trim(coalesce(own, ''))) AS low FROM (
    SELECT id, bank, CASE id % 4 WHEN 0 THEN counterparty WHEN 1 THEN 'Payment Received' WHEN 2 THEN ' self ' END AS own, CASE id % 3 WHEN 0 THEN upper(bank) || ' FD' WHEN 1 THEN 'Corner shop' END AS told FROM transactions WHERE coalesce(counterparty, 'x') <> ' ' || chr(9)))""")
def enriched_counterparties(t):
    i = F.col("id")
    own = F.when(i % 4 == 0, F.col("counterparty")).when(i % 4 == 1, "Payment Received").when(i % 4 == 2, " self ")
    told = F.when(i % 3 == 0, F.concat(F.upper("bank"), F.lit(" FD"))).when(i % 3 == 1, "Corner shop")
    return t["transactions"].where("coalesce(counterparty, 'x') <> ' \t'").select("id", uploads.enriched_counterparty(own, told, F.col("bank")).alias("counterparty"))


@_query("SELECT a.id, coalesce(t.n, 0) AS txns, coalesce(c.n, 0) AS card_statements, coalesce(b.n, 0) AS bank_statements FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM transactions GROUP BY 1) t ON t.account_id = a.id LEFT JOIN (SELECT account_id, count(*) AS n FROM statement_uploads GROUP BY 1) c ON c.account_id = a.id LEFT JOIN (SELECT account_id, count(*) AS n FROM bank_uploads GROUP BY 1) b ON b.account_id = a.id")
def account_link_counts(t):
    return listing.link_counts(t["accounts"], {"txns": t["transactions"], "card_statements": t["statement_uploads"], "bank_statements": t["bank_uploads"]})


_OWEDNOW = f"SELECT account_id, CASE WHEN payment_status = 'paid' OR a <= 0 THEN 0 ELSE greatest(a - coalesce(payment_paid_amount, 0), 0) END AS owed, due FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY due DESC, id) AS r FROM (SELECT *, {_DUE} AS due, {_OWED} AS a FROM statement_uploads) WHERE due IS NOT NULL) WHERE r = 1 AND a IS NOT NULL"


@_query(f"SELECT {_paise('sum(owed)')} AS total_paise, count(*) FILTER (WHERE owed > 0) AS owing, count(*) FILTER (WHERE owed = 0) AS settled, count(*) FILTER (WHERE owed > 0 AND due < DATE '1998-06-01') AS overdue FROM ({_OWEDNOW})")
def cc_totals(t):
    return statements.outstanding_totals(t["statement_uploads"], "1998-06-01")
