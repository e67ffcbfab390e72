"""More registered queries: formats, messages, sinks, sync policy, card payments, statements and CAS documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.functions import formatting, udfs
from tallyspark.functions.vocabulary import known_slugs
from tallyspark.operators import cards, evidence, investments, journal, ledger, listing, matching, networth, statements, sync
from tallyspark.plans.catalogue import _ACTIVE, _CANON, _CCY, _DUE, _FLOW, _LOTS, _OWED, _POST, _PROJ, _in, _paise, _projected, _query
from tallyspark.sources import messages

# ---- formats


@_query("""SELECT id, grouped, (CASE WHEN amount < 0 THEN '-' ELSE '' END) || '₹' || CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(reverse(regexp_replace(reverse(w[:-4]), '(..)', '\\1,', 'g')), '^,', '') || ',' || w[-3:] END || '.' || c AS indian
    FROM (SELECT id, amount, format('{:,.2f}', cast(amount AS DOUBLE)) AS grouped, string_split(cast(abs(amount) AS VARCHAR), '.')[1] AS w, string_split(cast(abs(amount) AS VARCHAR), '.')[2] AS c FROM transactions)""")
def money_formats(t):
    return t["transactions"].select("id", formatting.grouped_amount(F.col("amount")).alias("grouped"), formatting.indian_amount(F.col("amount")).alias("indian"))


@_query("""SELECT DISTINCT category, CASE WHEN regexp_matches(s, '^[a-z][a-z0-9_]{1,40}$') THEN s END AS slug FROM (SELECT category, regexp_replace(lower(trim(category)), '[\\s-]+', '_', 'g') AS s FROM transactions)""")
def category_slugs(t):
    return t["transactions"].select("category", formatting.canonical_slug(F.col("category")).alias("slug")).distinct()


@_query("""SELECT id, trim(regexp_replace(translate(coalesce(raw_description, '') || ';{x}', ';{}', '   '), ' +', ' ', 'g')) AS note FROM transactions""")
def sanitized_notes(t):
    return t["transactions"].select("id", formatting.sanitized_text(F.concat(F.coalesce("raw_description", F.lit("")), F.lit(";{x}"))).alias("note"))


@_query("""SELECT d, CASE WHEN m BETWEEN 1 AND 12 AND x >= 1 THEN least(cast(make_date(2023, CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 1 END, 1) + x - 1 AS DATE), last_day(make_date(2023, CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 1 END, 1))) END AS clamped
    FROM (SELECT o_orderkey AS d, cast(o_orderkey % 15 AS INTEGER) AS m, cast(o_orderkey % 33 AS INTEGER) AS x FROM orders)""")
def clamped_dates(t):
    k = F.col("o_orderkey")
    return t["orders"].select(k.alias("d"), formatting.clamped_date(F.lit(2023), (k % 15).cast("int"), (k % 33).cast("int")).alias("clamped"))


@_query("SELECT id, transaction_date - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS local_date, CASE WHEN id % 2 = 0 THEN '23:15:00' ELSE '05:30:00' END AS local_time FROM transactions WHERE transaction_date IS NOT NULL")
def local_times(t):
    at = F.when(F.col("id") % 2 == 0, F.expr("cast(date_sub(transaction_date, 1) as timestamp_ntz) + interval '17:45:00' hour to second")).otherwise(F.expr("cast(transaction_date as timestamp_ntz)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), at)
    return t["transactions"].where("transaction_date is not null").select("id", local.cast("date").alias("local_date"), F.date_format(local, "HH:mm:ss").alias("local_time"))


@_query()
def portfolio_tokens(t):
    keys = t["cas_uploads"].select("portfolio_key").distinct()
    return keys.select("portfolio_key", udfs.portfolio_token("fixture secret")(F.col("portfolio_key")).alias("token"))


@_query()
def names_redacted(t):
    return t["transactions"].where("counterparty is not null").select("id", udfs.redact_names(["ravi"])(F.col("counterparty")).alias("redacted"))


@_query(r"SELECT id, coalesce(regexp_matches(nfc_normalize(lower(trim(regexp_replace(raw_description, '[ \t\n\r\f\v]+', ' ', 'g')))), '(^|[^\p{L}\p{N}\p{M}\p{Pc}])zomato($|[^\p{L}\p{N}\p{M}\p{Pc}])'), false) AS named FROM transactions")
def narration_names(t):
    return t["transactions"].select("id", udfs.narration_names(F.col("raw_description"), F.lit("zomato")).alias("named"))


# ---- messages and documents

@_query("SELECT event_id, 'k' AS name, cast(cast(json_extract_string(props, '$.k') AS DECIMAL(16, 2)) * 100 AS BIGINT) AS paise FROM events")
def json_amounts(t):
    return messages.amounts_of_map(t["events"], "event_id", "props").select("event_id", "name", X.paise(F.col("amount")).alias("paise"))


@_query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 7 = 0 AS malformed FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 7 = 0")
def json_documents(t):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("[broken")).otherwise(F.col("props"))
    return messages.json_objects(t["events"].select("event_id", text.alias("props")), "props", "k int").select("event_id", F.col("props.k").alias("k"), F.col("props").isNull().alias("malformed"))


@_query("SELECT m.id AS message_id, r.id AS rule_id FROM sms_messages m, (VALUES (1, 'vm-user', ''), (2, '', 'the '), (3, 'ASSISTANT', 'de')) AS r(id, sender, subject) WHERE (r.sender = '' OR contains(lower(m.sender), lower(r.sender))) AND (r.subject = '' OR contains(lower(m.body), trim(lower(r.subject))))")
def fetch_rule_matches(t):
    rules = t.spark.sql("SELECT * FROM VALUES (1, 'vm-user', ''), (2, '', 'the '), (3, 'ASSISTANT', 'de') AS r(id, sender, subject)")
    return messages.rules_for(t["sms_messages"].select("id", "sender", F.col("body").alias("subject")), rules)


@_query("SELECT DISTINCT sender, body FROM sms_messages WHERE arrival % 2 = 1 AND (sender || body) NOT IN (SELECT sender || body FROM sms_messages WHERE arrival % 2 = 0 AND body IS NOT NULL)")
def unseen_messages(t):
    sms = t["sms_messages"].withColumn("key", F.concat("sender", "body"))
    return messages.unseen(sms.where("arrival % 2 = 1"), sms.where("arrival % 2 = 0"), "key").select("sender", "body")


# ---- sinks

@_query(f"""SELECT account_id, category, as_of_date, {_paise('value')} AS value_paise FROM (SELECT *, row_number() OVER (PARTITION BY account_id, category, as_of_date ORDER BY fresh DESC, id DESC) AS r FROM (SELECT id, account_id, category, as_of_date, value, 0 AS fresh FROM balance_snapshots WHERE account_id IS NOT NULL
    UNION ALL SELECT id, account_id, category, as_of_date, value + 1, 1 FROM balance_snapshots WHERE account_id IS NOT NULL AND id % 6 = 0)) WHERE r = 1""")
def snapshot_upsert(t):
    stored = t["balance_snapshots"].where("account_id is not null").select("id", "account_id", "category", "as_of_date", F.col("value").cast("decimal(18,2)").alias("value"))
    changes = stored.where("id % 6 = 0").withColumn("value", (F.col("value") + 1).cast("decimal(18,2)"))
    return messages.upserted(stored, changes, ["account_id", "category", "as_of_date"], "id").select("account_id", "category", "as_of_date", X.paise(F.col("value")).alias("value_paise"))


@_query("""SELECT s.id, s.portfolio_key, s.statement_date, s.src FROM (SELECT id, portfolio_key, statement_date, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS src, 0 AS fresh FROM cas_uploads WHERE id % 3 <> 0 UNION ALL SELECT id, portfolio_key, statement_date, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END, 1 FROM cas_uploads WHERE id % 3 = 0) s
    JOIN (SELECT portfolio_key, statement_date, max(src) AS best, max(CASE WHEN fresh = 1 THEN src END) AS newest FROM (SELECT portfolio_key, statement_date, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS src, 0 AS fresh FROM cas_uploads WHERE id % 3 <> 0 UNION ALL SELECT portfolio_key, statement_date, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END, 1 FROM cas_uploads WHERE id % 3 = 0) GROUP BY 1, 2) b
    ON b.portfolio_key = s.portfolio_key AND b.statement_date = s.statement_date WHERE s.src = b.best AND (s.fresh = 1 OR b.newest IS NULL OR b.newest < b.best)""")
def cas_replace(t):
    own = t["cas_uploads"].select("id", "portfolio_key", "statement_date")
    stored = own.where("id % 3 <> 0").withColumn("src", F.when(F.col("id") % 2 == 0, 2).otherwise(1))
    incoming = own.where("id % 3 = 0").withColumn("src", F.when(F.col("id") % 4 == 0, 2).otherwise(1))
    return messages.replaced(stored, incoming, ["portfolio_key", "statement_date"], "src")


@_query(f"""SELECT cast(id AS VARCHAR) AS id, category, CASE WHEN trim(coalesce(category, '')) = '' THEN 'blank' WHEN id % 11 = 0 THEN 'mismatch' WHEN category NOT IN {_in(known_slugs())} THEN 'unknown_category' ELSE 'applied' END AS status FROM (SELECT id, coalesce(category, '') AS category FROM transactions)""")
def review_import(t):
    rows = messages.review_rows(t["transactions"])
    changed = rows.withColumn("amount", F.when(F.col("id").cast("bigint") % 11 == 0, "0.01").otherwise(F.col("amount")))
    return messages.reviewed(changed, t["transactions"], known_slugs())


# ---- statements and cards

@_query(f"""SELECT id, kind, coalesce(bank, '') AS bank FROM (SELECT id, 'card' AS kind, bank FROM statement_uploads UNION ALL SELECT id, 'bank', NULL FROM (SELECT min(stmt_idx) AS id FROM bank_statement_rows GROUP BY account_id))""")
def statement_union(t):
    bank = t["bank_statement_rows"].groupBy("account_id").agg(F.min("stmt_idx").alias("id")).select("id")
    return listing.all_statements(t["statement_uploads"].select("id", "bank"), bank).select("id", "kind", F.coalesce("bank", F.lit("")).alias("bank"))


_OUT = f"""SELECT account_id, id AS statement_id, amount_due, CASE WHEN amount_due IS NULL THEN NULL WHEN payment_status = 'paid' OR amount_due <= 0 THEN 0 ELSE greatest(amount_due - coalesce(payment_paid_amount, 0), 0) END AS owed
    FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY due DESC, id) AS r FROM (SELECT *, {_DUE} AS due, {_OWED} AS amount_due FROM statement_uploads) WHERE due IS NOT NULL) WHERE r = 1"""
_STATE = f"SELECT a.id AS card, a.bank, cast(o.amount_due * 100 AS BIGINT) AS total, cast(o.owed * 100 AS BIGINT) AS owed FROM accounts a LEFT JOIN ({_OUT}) o ON o.account_id = a.id WHERE a.type = 'credit_card'"


@_query(f"""SELECT p.id, coalesce(sole, tc, exact, least_) AS account_id, CASE WHEN sole IS NOT NULL THEN 'sole_card' WHEN tc IS NOT NULL THEN 'total_due' WHEN exact IS NOT NULL THEN 'outstanding' WHEN least_ IS NOT NULL THEN 'sole_outstanding' END AS step FROM (
    SELECT q.id, CASE WHEN b.n = 1 THEN b.sole END AS sole, (SELECT CASE WHEN count(*) = 1 THEN max(card) END FROM state s WHERE s.bank = q.bank AND s.total = q.paise) AS tc,
      CASE WHEN NOT b.uncovered THEN (SELECT CASE WHEN count(*) = 1 THEN max(card) END FROM state s WHERE s.bank = q.bank AND s.owed = q.paise AND s.owed > 0) END AS exact,
      CASE WHEN NOT b.uncovered AND b.owing = 1 THEN (SELECT max(card) FROM state s WHERE s.bank = q.bank AND s.owed > 0 AND q.paise <= s.owed) END AS least_
    FROM (SELECT id, bank, cast((CASE WHEN id % 2 = 0 THEN amount ELSE 1 END) * 100 AS BIGINT) AS paise FROM transactions WHERE category = 'credit_card_payment') q
    LEFT JOIN (SELECT bank, count(*) AS n, max(card) AS sole, bool_or(owed IS NULL) AS uncovered, count(*) FILTER (WHERE owed > 0) AS owing FROM state GROUP BY 1) b ON b.bank = q.bank) p""")
def card_payment_accounts(t):
    pay = t["transactions"].where("category = 'credit_card_payment'").select("id", "bank", F.when(F.col("id") % 2 == 0, F.col("amount")).otherwise(F.lit(1)).cast("decimal(12,2)").alias("amount"))
    return cards.resolve_payments(pay, t["accounts"], t["statement_uploads"], "2001-01-01")


@_query(f"""SELECT account_id, statement_id, cast(date_diff('day', DATE '2000-06-01', due) AS INTEGER) AS days_left FROM (SELECT o.*, s.due FROM ({_OUT}) o JOIN (SELECT id, {_DUE} AS due FROM statement_uploads) s ON s.id = o.statement_id) WHERE owed > 0 AND date_diff('day', DATE '2000-06-01', due) IN (0, 1, 3, 7)""")
def due_reminders(t):
    return statements.reminders(t["statement_uploads"], "2000-06-01")


@_query("SELECT r.stmt_idx, count(DISTINCT t.id) AS candidates FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND t.amount = r.amount AND abs(date_diff('day', r.date, t.transaction_date)) <= 1 GROUP BY 1")
def candidate_evidence(t):
    found = statements.candidates(t["bank_statement_rows"], t["transactions"])
    g = found.groupBy("stmt_idx").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 20).alias("ids"), F.countDistinct("id").cast("bigint").alias("candidates"))
    return g.select("stmt_idx", "candidates")


@_query("SELECT s.stmt_idx, s.id AS id FROM (SELECT r.stmt_idx, t.id, count(*) OVER (PARTITION BY r.stmt_idx) AS a, count(*) OVER (PARTITION BY t.id) AS b FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND t.amount = r.amount AND trim(r.reference_number) = trim(t.reference_number) AND trim(r.reference_number) <> '') s WHERE a = 1 AND b = 1")
def stmt_reference_matches(t):
    done = statements.reconcile(t["bank_statement_rows"], t["transactions"])
    return done.where("status = 'reference'").select("stmt_idx", "id")


# ---- ledger, sync and investments

@_query(f"SELECT account, date, amount_paise, count(*) AS times FROM ({_POST}) WHERE starts_with(account, 'Expenses:') AND amount_paise < 0 GROUP BY 1, 2, 3")
def expected_reversals(t):
    return sync.expected_reversals(ledger.postings(_projected(t)))


@_query(f"""SELECT f.id, CASE WHEN f.n <= coalesce(e.times, 0) THEN 'accepted' ELSE 'fatal' END AS verdict FROM (SELECT id, account, date, amount_paise, row_number() OVER (PARTITION BY account, date, amount_paise ORDER BY id) AS n FROM (
      SELECT id * 10 + k AS id, CASE WHEN k = 9 THEN NULL ELSE account END AS account, date, amount_paise FROM ({_POST}), (VALUES (1), (2), (9)) AS v(k) WHERE leg = 1 AND amount_paise < 0)) f
    LEFT JOIN (SELECT account, date, amount_paise, count(*) AS times FROM ({_POST}) WHERE starts_with(account, 'Expenses:') AND amount_paise < 0 GROUP BY 1, 2, 3) e ON e.account = f.account AND e.date = f.date AND e.amount_paise = f.amount_paise""")
def diagnosis_verdicts(t):
    posted = ledger.postings(_projected(t))
    return _verdicts(posted, posted)


@_query(f"""SELECT f.id, CASE WHEN f.n <= coalesce(e.times, 0) THEN 'accepted' ELSE 'fatal' END AS verdict FROM (SELECT id, account, date, amount_paise, row_number() OVER (PARTITION BY account, date, amount_paise ORDER BY id) AS n FROM (
      SELECT id * 10 + k AS id, CASE WHEN k = 9 THEN NULL ELSE account END AS account, date, amount_paise FROM ({_POST}), (VALUES (1), (2), (9)) AS v(k) WHERE leg = 1 AND amount_paise < 0)) f
    LEFT JOIN (SELECT account, date, amount_paise, count(*) AS times FROM ({_POST}) WHERE starts_with(account, 'Expenses:') AND amount_paise < 0 GROUP BY 1, 2, 3) e ON e.account = f.account AND e.date = f.date AND e.amount_paise = f.amount_paise""")
def diagnosis_verdicts_all(t):
    posted = ledger.postings(_projected(t))
    return _verdicts(posted, posted)


def _verdicts(told, posted):
    """Verdicts on three findings about each negative contra posting of ``told``: two by the template and one without."""
    own = told.where("leg = 1 and amount_paise < 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))))
    amount = (F.col("amount_paise").cast("decimal(20,4)") / 100).cast("decimal(20,4)").cast("string")
    text = F.when(F.col("k") == 9, "Negative Balance").otherwise(F.concat(F.lit("<b>"), amount, F.lit("</b> got debited from <b>"), F.col("account"), F.lit("</b> on "), F.date_format("date", "dd MMM yyyy")))
    return sync.classify_findings(own.select((F.col("id") * 10 + F.col("k")).alias("id"), text.alias("details")), posted)


_SYNC = "event_id AS id, 1000 AS now_s, CASE WHEN event_id % 11 = 0 THEN 2000 END AS next_attempt_s, event_id % 13 = 0 AS force, CASE WHEN event_id % 7 = 0 THEN -30000 ELSE 900 END AS last_attempt_s, event_id % 5 AS desired, 2 AS applied, 1000 - event_id % 60 AS first_dirty_s, 1000 - event_id % 9 AS last_dirty_s"


@_query(f"""SELECT id, reason, reason NOT IN ('backoff', 'caught_up', 'debounce') AS due, CASE least(greatest(desired, 1), 5) WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 10 ELSE 15 END AS retry_min FROM (SELECT *, CASE WHEN now_s < next_attempt_s THEN 'backoff' WHEN force THEN 'force_reload' WHEN now_s - last_attempt_s >= 21600 THEN 'periodic_reload'
    WHEN desired <= applied THEN 'caught_up' WHEN now_s - first_dirty_s >= 30 THEN 'max_latency' WHEN now_s - last_dirty_s < 5 THEN 'debounce' ELSE 'dirty' END AS reason FROM (SELECT {_SYNC} FROM events))""")
def reload_eligibility(t):
    return sync.eligibility(t["events"].selectExpr(*_SYNC.split(", "))).select("id", "reason", "due", sync.backoff_minutes(F.col("desired")).alias("retry_min"))


@_query(f"""SELECT n.name, coalesce(e.commodity, k.commodity) AS commodity, coalesce(e.balance_paise, k.s) AS balance_paise FROM (VALUES ('Expenses'), ('Expenses:Rent'), ('Income'), ('Nothing')) AS n(name)
    LEFT JOIN (SELECT account, commodity, cast(sum(amount_paise) AS BIGINT) AS balance_paise FROM ({_POST}) GROUP BY 1, 2) e ON e.account = n.name
    LEFT JOIN (SELECT regexp_replace(account, ':[^:]+$', '') AS parent, commodity, cast(sum(amount_paise) AS BIGINT) AS s FROM ({_POST}) WHERE contains(account, ':') GROUP BY 1, 2) k ON k.parent = n.name AND k.commodity = coalesce(e.commodity, 'INR')""")
def balance_rollup(t):
    names = t.spark.sql("SELECT * FROM VALUES ('Expenses'), ('Expenses:Rent'), ('Income'), ('Nothing') AS n(name)")
    return sync.rolled_up(ledger.balances(ledger.postings(_projected(t))), names)


@_query(f"SELECT id, leg, '    ' || account || repeat(' ', greatest(0, 48 - length(account))) || ' ' || cast(cast(amount_paise AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2)) || ' ' || commodity AS line FROM ({_POST})")
def ledger_lines(t):
    return ledger.journal_lines(ledger.postings(_projected(t)))


@_query(f"SELECT id, leg, '    ' || account || repeat(' ', greatest(0, 48 - length(account))) || ' ' || cast(cast(amount_paise AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2)) || ' ' || commodity AS line FROM ({_POST})")
def ledger_lines_all(t):
    return ledger.journal_lines(ledger.postings(_projected(t)))


@_query(f"""SELECT coalesce(v.instrument, l.instrument) AS instrument, quantity, unit_price, lots, cost_paise FROM (SELECT instrument, cast(sum(units) AS BIGINT) AS quantity, cast(CASE WHEN count(DISTINCT nav) = 1 THEN max(nav) END AS BIGINT) AS unit_price FROM ({_LOTS}) WHERE instrument IS NOT NULL GROUP BY 1) v
    FULL JOIN (SELECT instrument, count(*) AS lots, cast(sum(units * nav) * 100 AS BIGINT) AS cost_paise FROM ({_CANON}) GROUP BY 1) l ON l.instrument = v.instrument""")
def investment_positions(t):
    raw = investments.classify(t["raw_lots"])
    return investments.positions(raw.where("instrument is not null"), investments.canonical_lots(raw))


@_query(f"""SELECT coalesce(v.instrument, l.instrument) AS instrument, quantity, unit_price, lots, cost_paise FROM (SELECT instrument, cast(sum(units) AS BIGINT) AS quantity, cast(CASE WHEN count(DISTINCT nav) = 1 THEN max(nav) END AS BIGINT) AS unit_price FROM ({_LOTS}) WHERE instrument IS NOT NULL GROUP BY 1) v
    FULL JOIN (SELECT instrument, count(*) AS lots, cast(sum(units * nav) * 100 AS BIGINT) AS cost_paise FROM ({_CANON}) GROUP BY 1) l ON l.instrument = v.instrument""")
def investment_positions_all(t):
    raw = investments.classify(t["raw_lots"])
    return investments.positions(raw.where("instrument is not null"), investments.canonical_lots(raw))


@_query("""SELECT portfolio_key, id AS upload_id, portfolio_ok FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(portfolio_key)) ORDER BY statement_date DESC, id DESC) AS r FROM cas_uploads) WHERE r = 1""")
def latest_portfolios(t):
    return investments.latest_portfolios(t["cas_uploads"]).select("portfolio_key", F.col("id").alias("upload_id"), "portfolio_ok")


@_query(f"""SELECT asset_class, {_paise('sum(v)')} AS value_paise FROM (SELECT asset_class, value AS v FROM snapshot_holdings UNION ALL SELECT 'other', total - held FROM (SELECT s.id, s.value * 3 AS total, sum(h.value) AS held FROM balance_snapshots s JOIN snapshot_holdings h ON h.snapshot_id = s.id GROUP BY 1, 2) WHERE total > held) GROUP BY 1""")
def holdings_by_class(t):
    return networth.holdings_by_class(t["balance_snapshots"], t["snapshot_holdings"], F.col("value") * 3)


@_query(f"""SELECT item, newest, values_ FROM (SELECT manual_item_id AS item, max(as_of_date) AS newest, count(*) AS values_ FROM balance_snapshots WHERE manual_item_id IS NOT NULL GROUP BY 1)""")
def manual_item_history(t):
    g = networth.manual_history(t["balance_snapshots"])
    return g.select("item", F.element_at("history", 1)["as_of_date"].alias("newest"), F.size("history").cast("bigint").alias("values_"))


@_query(f"SELECT source, count(*) AS n, min(as_of_date) AS first_date FROM ({_ACTIVE}) GROUP BY 1")
def snapshot_sources(t):
    own = networth.active_snapshots(t["balance_snapshots"], t["accounts"], t["manual_items"]).where("as_of_date <= date '2024-03-20'")
    return own.groupBy(networth.source_key().alias("source")).agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("as_of_date").alias("first_date"))


@_query(f"SELECT {_CCY} AS currency, source, count(*) AS n, {_paise(f'sum({_FLOW})')} AS net_paise, count(*) FILTER (WHERE category_method IS NULL) AS open_rows FROM transactions GROUP BY 1, 2")
def channel_counters(t):
    return t["transactions"].groupBy(X.normalized_currency(F.col("currency")).alias("currency"), "source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), X.paise(F.sum(X.signed(F.col("direction"), F.col("amount")))).alias("net_paise"), F.count_if(F.col("category_method").isNull()).cast("bigint").alias("open_rows"))


@_query("""SELECT i.seq, count(s.id) AS stored, coalesce(bool_or(s.balance IS NOT NULL AND i.balance IS NOT NULL AND s.balance <> i.balance), false) AS balance_conflict FROM incoming i LEFT JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND trim(s.reference_number) = trim(i.reference_number) AND trim(i.reference_number) <> '' GROUP BY i.seq""")
def match_evidence(t):
    hits = matching.by_reference(t["incoming"], t["transactions"])
    i = t["incoming"].select(F.col("seq").alias("_q"), F.col("bank").alias("_b"), F.col("direction").alias("_d"), F.trim("reference_number").alias("_r"), F.col("balance").alias("_bal"))
    s = t["transactions"]
    off = i.join(s, (F.col("_b") == F.col("bank")) & (F.col("_d") == F.col("direction")) & (F.col("_r") == F.trim("reference_number")) & (F.col("_r") != "")).groupBy("_q").agg(F.bool_or(F.coalesce(F.col("_bal") != F.col("balance"), F.lit(False))).alias("c"))
    out = t["incoming"].select("seq").join(hits.select(F.col("seq").alias("_h"), "candidates"), F.col("seq") == F.col("_h"), "left").join(off, F.col("seq") == F.col("_q"), "left")
    return out.select("seq", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("stored"), F.coalesce("c", F.lit(False)).alias("balance_conflict"))


# ---- evidence

_SUFFIX = "'(_cc_bill_paid|_cc_bill_paid_alert|_cc_credit_alert|_cc_payment|_cc_payment_alert|_cc_payment_received_alert|_cc_repayment_received_alert|_cc_upi_payment_alert|sbi_payment_ack)$'"


@_query(f"SELECT id, account_id FROM transactions WHERE direction = 'credit' AND account_id IS NOT NULL AND regexp_matches(email_type, {_SUFFIX})")
def settling_rows(t):
    return evidence.settles_statement(t["transactions"]).select("id", "account_id")


_STOP = ["PAYMENT", "ORDER", "CARD", "RECEIVED", "THANK"]
_TOK = lambda c: f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z]{{4,}}'), lambda w: upper(w)), lambda w: w NOT IN {_in(_STOP)})"
_RIN = lambda r, x: f"coalesce(regexp_matches({r}, '^[A-Za-z0-9]{{6,}}$') AND regexp_matches(' ' || {x} || ' ', '[^A-Za-z0-9]' || {r} || '[^A-Za-z0-9]'), false)"


@_query(f"""SELECT x.stmt_idx, x.id, CASE WHEN has AND sr = tr THEN true WHEN coalesce(sb <> tb, false) THEN false WHEN NOT has THEN true WHEN shifted THEN false ELSE {_RIN('tr', 'sn')} OR {_RIN('sr', 'tn')} OR coalesce(sc = 'upi' AND tc = 'upi' AND list_has_any({_TOK('tn')}, {_TOK('sn')}), false) END AS fits
    FROM (SELECT r.stmt_idx, t.id, r.reference_number AS sr, t.reference_number AS tr, coalesce(r.reference_number <> '', false) AND coalesce(t.reference_number <> '', false) AS has, r.balance AS sb, t.balance AS tb, r.narration || coalesce(' ' || t.reference_number, '') AS sn, coalesce(t.raw_description, t.counterparty) AS tn, 'upi' AS sc, t.channel AS tc, r.date <> t.transaction_date AS shifted
      FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND abs(date_diff('day', r.date, t.transaction_date)) <= 1) x""")
def candidate_compatibility(t):
    r = t["bank_statement_rows"].select("stmt_idx", F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.col("date").alias("_date"), F.col("reference_number").alias("sr"), F.col("balance").alias("sb"), "narration", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("o"))
    s = t["transactions"]
    j = r.join(s, (F.col("_a") == F.col("account_id")) & (F.col("_d") == F.col("direction")) & (F.date_add("_date", F.col("o")) == F.col("transaction_date")))
    told = F.concat(F.col("narration"), F.coalesce(F.concat(F.lit(" "), F.col("reference_number")), F.lit("")))
    fits = evidence.compatible(F.col("sr"), told, F.col("sb"), F.lit("upi"), F.col("reference_number"), F.coalesce("raw_description", "counterparty"), F.col("balance"), F.col("channel"), F.col("o") != 0, _STOP)
    return j.select("stmt_idx", "id", fits.alias("fits"))


@_query("""SELECT id, least(length(x), length(y)) >= 4 AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x)) AS same FROM (SELECT id, regexp_replace(upper(coalesce(reference_number, '')), '[^A-Z0-9]', '', 'g') AS x, regexp_replace(upper(coalesce(substr(reference_number, cast(2 + id % 5 AS INTEGER)), '')), '[^A-Z0-9]', '', 'g') AS y FROM transactions)""")
def shortened_references(t):
    return t["transactions"].select("id", evidence.shortened_reference(F.col("reference_number"), F.expr("substr(reference_number, cast(2 + id % 5 as int))")).alias("same"))


@_query("""SELECT id, cast(CASE WHEN h BETWEEN 1 AND 12 THEN coalesce((SELECT min(c.t) FROM (SELECT am AS t UNION ALL SELECT am + 43200) c WHERE c.t - got BETWEEN -43200 AND 300 AND abs(c.t - got) = least(CASE WHEN am - got BETWEEN -43200 AND 300 THEN abs(am - got) ELSE 999999 END, CASE WHEN am + 43200 - got BETWEEN -43200 AND 300 THEN abs(am + 43200 - got) ELSE 999999 END)), s) ELSE s END AS INTEGER) AS resolved
    FROM (SELECT id, transaction_time_s AS s, transaction_time_s // 3600 AS h, CASE WHEN transaction_time_s // 3600 = 12 THEN transaction_time_s - 43200 ELSE transaction_time_s END AS am, (id * 911) % 86400 AS got FROM transactions WHERE transaction_time_s IS NOT NULL AND transaction_date IS NOT NULL)""")
def am_pm_by_arrival(t):
    own = t["transactions"].where("transaction_time_s is not null and transaction_date is not null")
    got = F.unix_date("transaction_date").cast("bigint") * 86400 + (F.col("id") * 911) % 86400
    return own.select("id", evidence.half_of_day(F.col("transaction_time_s"), F.col("transaction_date"), got).cast("int").alias("resolved"))


@_query(f"""SELECT account_id, kind, category, as_of_date, value_paise, id FROM (SELECT account_id, 'liability' AS kind, 'cc_outstanding' AS category, created_on AS as_of_date, id, {_paise("CASE WHEN payment_status = 'paid' OR due <= 0 THEN 0 ELSE greatest(due - coalesce(payment_paid_amount, 0), 0) END")} AS value_paise
    FROM (SELECT *, {_OWED} AS due FROM statement_uploads) WHERE due IS NOT NULL)""")
def card_snapshots(t):
    return evidence.card_snapshots(t["statement_uploads"])


@_query("SELECT id AS account_id, account_number AS card_mask, 'self' AS label, true AS is_primary FROM accounts a WHERE type = 'credit_card' AND coalesce(account_number, '') <> '' AND NOT EXISTS (SELECT 1 FROM known_cards c WHERE c.account_id = a.id)")
def default_cards(t):
    return evidence.default_cards(t["accounts"], t["known_cards"])


@_query("""SELECT t.id, CASE WHEN trim(coalesce(t.reference_number, '')) = '' THEN 'no_reference' WHEN g.d <> 1 OR g.c <> 1 THEN 'legs' WHEN g.lo <> g.hi THEN 'amount_mismatch' WHEN g.c1 <> g.c2 THEN 'currency_mismatch' WHEN NOT g.known THEN 'account' ELSE 'paired' END AS verdict FROM transactions t
    LEFT JOIN (SELECT trim(reference_number) AS ref, count(*) FILTER (WHERE direction = 'debit') AS d, count(*) FILTER (WHERE direction = 'credit') AS c, min(amount) AS lo, max(amount) AS hi, min(coalesce(nullif(trim(currency), ''), 'INR')) AS c1, max(coalesce(nullif(trim(currency), ''), 'INR')) AS c2, bool_and(account_id IS NOT NULL) AS known FROM transactions WHERE category = 'self_transfer' AND trim(coalesce(reference_number, '')) <> '' GROUP BY 1) g ON g.ref = trim(t.reference_number)
    WHERE t.category = 'self_transfer'""")
def self_transfer_verdicts(t):
    return evidence.self_transfer_verdicts(t["transactions"])


@_query(f"""SELECT DISTINCT p.transaction_date AS date, p.commodity, cast((SELECT r.rate FROM fx_rates r WHERE r.currency = p.commodity AND r.date <= p.transaction_date ORDER BY r.date DESC LIMIT 1) * 10000 AS BIGINT) AS rate_e4 FROM ({_PROJ}) p WHERE reason IS NULL AND commodity <> 'INR'""")
def price_directives(t):
    return evidence.price_directives(_projected(t)).select("date", "commodity", (F.col("rate") * 10000).cast("bigint").alias("rate_e4"))


@_query(f"SELECT account_id, n, posted, CASE WHEN posted = 0 THEN 'excluded' WHEN posted < n THEN 'partial' ELSE 'included' END AS scope FROM (SELECT account_id, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS posted FROM ({_PROJ}) WHERE account_id IS NOT NULL GROUP BY 1)")
def ledger_scope(t):
    return evidence.scope_completeness(_projected(t))


@_query("""SELECT p.id, CASE WHEN m.n = 1 THEN m.a END AS card_account, CASE WHEN m.n = 1 THEN 'resolved' WHEN m.n > 1 THEN 'ambiguous_mask' ELSE 'unresolved' END AS status FROM transactions p LEFT JOIN (SELECT trim(card_mask) AS m, count(*) AS n, max(account_id) AS a FROM cards GROUP BY 1) m ON m.m = trim(p.card_mask) WHERE p.category = 'credit_card_payment'""")
def card_of_payment(t):
    return evidence.card_of_payment(t["transactions"].where("category = 'credit_card_payment'").select("id", "card_mask"), t["cards"])


_NCP = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"


@_query(f"""SELECT target, id, cast(r AS INTEGER) AS place FROM (SELECT x.target, c.id, row_number() OVER (PARTITION BY x.target ORDER BY c.created_at DESC, c.id DESC) AS r FROM (SELECT id AS target, direction, {_NCP.format('counterparty')} AS cp FROM transactions) x
    JOIN (SELECT * FROM (SELECT id, direction, created_at, {_NCP.format('counterparty')} AS cp, row_number() OVER (PARTITION BY direction ORDER BY created_at DESC, id DESC) AS k FROM transactions WHERE category IS NOT NULL AND category_method IN ('manual', 'rule') AND direction IN ('credit', 'debit')) WHERE k <= 200) c
    ON c.direction = x.direction AND x.cp <> '' AND c.cp <> '' AND (contains(c.cp, x.cp) OR contains(x.cp, c.cp))) WHERE r <= 5""")
def similar_examples(t):
    targets = t["transactions"].select(F.col("id").alias("target"), "direction", "counterparty")
    return evidence.similar_examples(t["transactions"], targets)


@_query(f"""SELECT target, id, cast(r AS INTEGER) AS place FROM (SELECT x.target, c.id, row_number() OVER (PARTITION BY x.target ORDER BY c.created_at DESC, c.id DESC) AS r FROM (SELECT id AS target, direction, {_NCP.format('counterparty')} AS cp FROM transactions) x
    JOIN (SELECT * FROM (SELECT id, direction, created_at, {_NCP.format('counterparty')} AS cp, row_number() OVER (PARTITION BY direction ORDER BY created_at DESC, id DESC) AS k FROM transactions WHERE category IS NOT NULL AND category_method IN ('manual', 'rule') AND direction IN ('credit', 'debit')) WHERE k <= 200) c
    ON c.direction = x.direction AND x.cp <> '' AND c.cp <> '' AND (contains(c.cp, x.cp) OR contains(x.cp, c.cp))) WHERE r <= 5""")
def similar_examples_all(t):
    return evidence.similar_examples(t["transactions"], t["transactions"].select(F.col("id").alias("target"), "direction", "counterparty"))


@_query("""SELECT p_partkey, scope, source_ref, instrument, cast(row_number() OVER (PARTITION BY p_partkey, scope, source_ref, instrument ORDER BY q) - 1 AS INTEGER) AS occurrence, cast(v * 100 AS BIGINT) AS value_paise FROM (
    SELECT p_partkey, 'demat' AS scope, 'D' || p_size % 3 AS source_ref, 'INE' || (p_size + k) % 2 AS instrument, k AS q, cast(p_size + k AS DECIMAL(16, 2)) AS v FROM part, (VALUES (0), (1), (2)) AS x(k)
    UNION ALL SELECT p_partkey, 'folio', 'F' || p_size % 4, 'INF' || p_size % 5, 0, NULL FROM part WHERE p_size % 2 = 0)""")
def nested_holdings(t):
    text = """named_struct('accounts', array(named_struct('source_ref', concat('D', p_size % 3), 'holdings', transform(sequence(0, 2), k -> named_struct('isin', concat(' ine', (p_size + k) % 2), 'quantity', '1', 'value', cast(p_size + k as string))))),
      'folios', if(p_size % 2 = 0, array(named_struct('source_ref', concat('F', p_size % 4), 'schemes', array(named_struct('isin', concat('INF', p_size % 5), 'units', 'n/a', 'value', 'n/a'), named_struct('isin', ' ', 'units', '1', 'value', '1')))), array()))"""
    schema = "accounts array<struct<source_ref:string,holdings:array<struct<isin:string,quantity:string,value:string>>>>, folios array<struct<source_ref:string,schemes:array<struct<isin:string,units:string,value:string>>>>"
    docs = messages.json_objects(t["part"].select("p_partkey", F.to_json(F.expr(text)).alias("doc")), "doc", schema).select("p_partkey", "doc.*")
    return evidence.holdings_of(docs, "p_partkey").select("p_partkey", "scope", "source_ref", "instrument", "occurrence", (F.col("value") * 100).cast("bigint").alias("value_paise"))


# ---- journal

_PAYEE = "coalesce(nullif(trim(regexp_replace(translate(coalesce(t.counterparty, t.raw_description, ''), ';' || chr(10) || chr(13) || chr(9) || '{}', '      '), ' +', ' ', 'g')), ''), 'Unknown')"
_AMT = "cast(cast(cast(amount_paise AS DECIMAL(22, 2)) / 100 AS DECIMAL(20, 2)) AS VARCHAR)"


@_query(f"""SELECT e.id, strftime(e.date, '%Y/%m/%d') || ' * ' || {_PAYEE} || chr(10) || string_agg('    ' || rpad(account, 36, ' ') || lpad({_AMT}, 14, ' ') || ' ' || commodity, chr(10) ORDER BY leg) AS text FROM ({_POST}) e JOIN transactions t ON t.id = e.id GROUP BY e.id, e.date, t.counterparty, t.raw_description""")
def journal_ledger(t):
    e = journal.entries(ledger.postings(_projected(t)), t["transactions"])
    return e.select("id", journal.ledger_entry(F.col("date"), F.col("payee"), F.col("postings")).alias("text"))


_BEAN = "array_to_string(list_transform(string_split(account, ':'), lambda p: regexp_replace(upper(p[1]) || p[2:], '[^A-Za-z0-9-]', '-', 'g')), ':')"


@_query(f"""SELECT e.id, cast(e.date AS VARCHAR) || ' * "' || replace({_PAYEE}, '"', '''') || '"' || chr(10) || string_agg('  ' || {_BEAN} || '  ' || {_AMT} || ' ' || commodity, chr(10) ORDER BY leg) AS text FROM ({_POST}) e JOIN transactions t ON t.id = e.id GROUP BY e.id, e.date, t.counterparty, t.raw_description""")
def journal_beancount(t):
    e = journal.entries(ledger.postings(_projected(t)), t["transactions"])
    return e.select("id", journal.beancount_entry(F.col("date"), F.col("payee"), F.col("postings")).alias("text"))


@_query(f"SELECT account, cast(opened AS VARCHAR) || ' open ' || account || ' ' || c AS line FROM (SELECT {_BEAN} AS account, min(date) AS opened, string_agg(DISTINCT commodity, ',' ORDER BY commodity) AS c FROM ({_POST}) GROUP BY 1)")
def journal_opens(t):
    return journal.open_directives(ledger.postings(_projected(t)))


# ---- more listings


@_query("SELECT id, amount FROM (SELECT id, cast(amount * 100 AS BIGINT) AS amount FROM transactions WHERE lower(bank) = 'icici' AND direction = 'debit' AND source = 'email' AND category = 'rent' AND transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1999-12-31')")
def exact_filters(t):
    own = listing.exact_filters(t["transactions"], bank=" ICICI ", direction="debit ", source="email", category="rent", date_from="1996-01-01", date_to="1999-12-31", reference_number=None)
    return own.select("id", X.paise(F.col("amount")).alias("amount"))


@_query("SELECT t.id, a.label AS account_label, a.type AS account_type, (SELECT min(card_mask) FROM cards c WHERE c.account_id = t.account_id AND c.is_primary) AS primary_mask FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id")
def txn_details(t):
    return listing.with_details(t["transactions"], t["accounts"], t["cards"]).select("id", "account_label", "account_type", "primary_mask")


@_query("SELECT t.account_id, count(*) AS n FROM transactions t JOIN (SELECT account_id, min(date) - 7 AS lo, max(date) + 7 AS hi FROM bank_statement_rows GROUP BY 1) s ON s.account_id = t.account_id AND t.transaction_date BETWEEN lo AND hi GROUP BY 1")
def near_statement_rows(t):
    return listing.near_statement(t["transactions"], t["bank_statement_rows"]).groupBy("account_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@_query("SELECT account_id, person, n FROM (SELECT account_id, person, n, count(*) OVER (PARTITION BY account_id) AS p FROM (SELECT account_id, narration AS person, count(*) AS n FROM bank_statement_rows WHERE narration IS NOT NULL GROUP BY 1, 2)) WHERE p > 1")
def rows_by_person(t):
    return listing.by_person(t["bank_statement_rows"], "account_id", "narration").withColumnRenamed("narration", "person")


@_query("SELECT count(*) AS rows_, count(*) FILTER (WHERE category_method = 'pending_llm') AS pending, count(*) FILTER (WHERE category_method IS NULL) AS open_, count(*) FILTER (WHERE account_id IS NULL) AS orphans, count(DISTINCT bank) AS banks FROM transactions")
def status_counters(t):
    return t["transactions"].agg(F.count(F.lit(1)).cast("bigint").alias("rows_"), F.count_if(F.col("category_method") == "pending_llm").cast("bigint").alias("pending"), F.count_if(F.col("category_method").isNull()).cast("bigint").alias("open_"),
                                 F.count_if(F.col("account_id").isNull()).cast("bigint").alias("orphans"), F.countDistinct("bank").cast("bigint").alias("banks"))
