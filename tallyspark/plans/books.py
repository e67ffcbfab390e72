"""Registered queries over the ledger's pairs, names, checks and texts, investments and outside reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.functions import formatting
from tallyspark.operators import books, cashflow, evidence, investments, ledger, networth, reports, upkeep
from tallyspark.plans.catalogue import _BASE, _CANON, _CONTRA, _LOTS, _POST, _PROJ, CUTOVER, END, START, _paise, _projected, _query
from tallyspark.sources import messages

# ---- ledger


@_query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, cast(o_orderdate AS DATE) AS date, cast(cast(o_totalprice AS DECIMAL(12, 2)) * 10000 AS BIGINT) AS rate_e4 FROM orders WHERE o_orderkey % 4 <> 3")
def parsed_rates(t):
    """A rate table for every order: a good entry beside ones that don't parse, are negative or round to nothing."""
    day, rate = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    name = F.when(F.col("o_orderkey") % 4 == 3, "").when(F.col("o_orderkey") % 3 == 0, " usd").otherwise("EUR")
    text = F.format_string('{"%s": [{"date": "%s", "rate": "%s"}, {"date": "soon", "rate": "1"}, {"date": "%s", "rate": "-1"}, {"date": "%s", "rate": "0.00001"}, {"rate": "5"}], "GBP": []}', name, day, rate, day, day)
    return books.parsed_rates(t["orders"].select(text.alias("value"))).select("currency", "date", (F.col("rate") * 10000).cast("bigint").alias("rate_e4"))


_PJ = _PROJ.replace("SELECT t.id,", "SELECT t.id, t.reference_number, t.card_mask,")
_PAIR = f"""SELECT reference, date, debit_id, credit_id, from_account, to_account, {_paise('hi')} AS amount_paise, commodity FROM (SELECT trim(reference_number) AS reference, count(*) FILTER (WHERE direction = 'debit') AS d, count(*) AS n, min(amount) AS lo, max(amount) AS hi, min(commodity) AS c, max(commodity) AS commodity, min(transaction_date) AS date,
    max(CASE WHEN direction = 'debit' THEN id END) AS debit_id, max(CASE WHEN direction = 'credit' THEN id END) AS credit_id, max(CASE WHEN direction = 'debit' THEN own END) AS from_account, max(CASE WHEN direction = 'credit' THEN own END) AS to_account
    FROM (SELECT * REPLACE (ACC AS amount) FROM (PJ)) WHERE category = 'self_transfer' AND reason IS NULL AND trim(coalesce(reference_number, '')) <> '' GROUP BY 1) WHERE n = 2 AND d = 1 AND credit_id IS NOT NULL AND lo = hi AND c = commodity"""
_PAIRS = _PAIR.replace("(SELECT * REPLACE (ACC AS amount) FROM (PJ))", f"(SELECT * REPLACE (CASE WHEN category = 'self_transfer' THEN 100 ELSE amount END::DECIMAL(12, 2) AS amount) FROM ({_PJ}))")


def _evened(t):
    """Projected rows; self-transfers all of one amount, so that some pair."""
    return _projected(t).withColumn("amount", F.when(F.col("category") == "self_transfer", F.lit(100)).otherwise(F.col("amount")).cast("decimal(12,2)"))


@_query(_PAIRS)
def transfer_entries(t):
    return books.transfer_entries(_evened(t))


@_query(f"SELECT id, reason FROM ({_PJ}) WHERE reason IS NOT NULL UNION ALL SELECT id, 'unmatched_self_transfer' FROM ({_PJ}) WHERE reason IS NULL AND category = 'self_transfer' AND id NOT IN (SELECT debit_id FROM ({_PAIRS}) UNION ALL SELECT credit_id FROM ({_PAIRS}))")
def skip_reasons(t):
    return books.skip_reasons(_evened(t))


_PAY = f"SELECT p.*, CASE p.id % 3 WHEN 0 THEN p.account_id * 10 + 1 WHEN 1 THEN -5 END AS card_id, CASE WHEN p.id % 4 = 1 THEN 'XX' || right(lpad(cast(p.id % 150 AS VARCHAR), 10, '7'), 4) ELSE p.card_mask END AS mask FROM ({_PJ}) p WHERE category = 'credit_card_payment' AND reason IS NULL"
_LIAB = f"SELECT p.*, coalesce(c.account_id, CASE WHEN m.n = 1 THEN m.a END) AS liability_id, CASE WHEN c.id IS NOT NULL THEN 'resolved' WHEN m.n > 1 THEN 'ambiguous_mask' WHEN m.n = 1 THEN 'resolved' ELSE 'unresolved' END AS resolution FROM ({_PAY}) p LEFT JOIN cards c ON c.id = p.card_id LEFT JOIN (SELECT trim(card_mask) AS m, count(*) AS n, max(account_id) AS a FROM cards GROUP BY 1) m ON m.m = trim(p.mask)"


def _payments(t):
    i = F.col("id")
    own = _projected(t).withColumn("card_id", F.when(i % 3 == 0, F.col("account_id") * 10 + 1).when(i % 3 == 1, -5))
    return own.withColumn("card_mask", F.when(i % 4 == 1, F.concat(F.lit("XX"), F.right(F.lpad((i % 150).cast("string"), 10, "7"), F.lit(4)))).otherwise(F.col("card_mask")))


@_query(f"SELECT id, liability_id, resolution FROM ({_LIAB})")
def payment_liabilities(t):
    return books.payment_liabilities(_payments(t).where("category = 'credit_card_payment' and reason is null"), t["cards"]).select("id", "liability_id", "resolution")


@_query(f"""SELECT l.id, resolution, leg, CASE WHEN leg = 1 THEN own ELSE coalesce('Liabilities:Card:' || upper(a.bank[1]) || a.bank[2:] || ':' || a.label, 'Liabilities:Credit Card') END AS account, {_paise("CASE WHEN (direction = 'credit') = (leg = 1) THEN amount ELSE -amount END")} AS amount_paise FROM ({_LIAB}) l LEFT JOIN accounts a ON a.id = l.liability_id, (VALUES (0), (1)) AS v(leg)""")
def payment_postings(t):
    return books.payment_postings(_payments(t), t["cards"], t["accounts"])


@_query(f"SELECT id, CASE WHEN category IN ('investment', 'investment_redemption') AND id % 5 <> 0 THEN CASE WHEN direction = 'debit' THEN 'Assets:Investments:Unallocated' ELSE 'Equity:Transfers In' END ELSE contra END AS contra FROM (SELECT id, category, direction, {_CONTRA} AS contra FROM transactions) WHERE category IS NOT NULL")
def investment_contras(t):
    rows = t["transactions"].where("category is not null")
    return rows.select("id", books.investment_contra(F.col("category"), F.col("direction"), ledger.contra_account(F.col("category")), F.col("id") % 5 == 0).alias("contra"))


_VAL = "SELECT portfolio_key, as_of_date, CASE WHEN currency = 'INR' THEN value ELSE 0 END AS value FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_key, as_of_date ORDER BY id DESC) AS r FROM balance_snapshots WHERE portfolio_key IS NOT NULL) WHERE r = 1"


@_query(f"""SELECT portfolio_key, kind, CASE WHEN kind = 'opening' THEN DATE '2023-08-31' ELSE as_of_date END AS date, as_of_date, {_paise('d')} AS delta_paise FROM (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY portfolio_key ORDER BY as_of_date), 0) AS d FROM (
    SELECT portfolio_key, as_of_date, value, 'opening' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_key ORDER BY as_of_date DESC) AS n FROM ({_VAL}) WHERE as_of_date <= DATE '2023-08-31') WHERE n = 1 UNION ALL SELECT portfolio_key, as_of_date, value, 'revaluation' FROM ({_VAL}) WHERE as_of_date > DATE '2023-08-31')) WHERE d <> 0""")
def valuation_entries(t):
    return books.valuation_entries(t["balance_snapshots"], "2023-08-31")


@_query("SELECT id AS upload_id, CASE WHEN count(*) OVER (PARTITION BY portfolio_key) = 1 THEN portfolio_key ELSE portfolio_key || ' #' || row_number() OVER (PARTITION BY portfolio_key ORDER BY id) END AS shown FROM cas_uploads WHERE id NOT IN (SELECT cas_upload_id FROM balance_snapshots WHERE cas_upload_id IS NOT NULL AND id % 3 = 0)")
def uncovered_uploads(t):
    return books.uncovered_uploads(t["cas_uploads"], t["balance_snapshots"].where("id % 3 = 0"))


@_query("SELECT DISTINCT account_id FROM transactions WHERE account_id IS NOT NULL AND account_id NOT IN (SELECT id FROM accounts)")
def unknown_account_ids(t):
    return books.unknown_ids(t["transactions"].where("account_id is not null").select("account_id"), t["accounts"])


_NAMES = "SELECT id, CASE id % 6 WHEN 0 THEN 'Assets:Bank:' || upper(bank) || ':' || label WHEN 1 THEN 'Cash:Bank' WHEN 2 THEN 'Liabilities:Card:7 stars' WHEN 3 THEN 'Expenses:Eating out:' || bank WHEN 4 THEN 'Income' ELSE 'Equity:--:x' END AS name FROM accounts"
_PASCAL = lambda p: f"array_to_string(list_transform(regexp_extract_all({p}, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '')"


@_query(f"""SELECT id, name, CASE WHEN ok THEN array_to_string(list_concat([root], parts), ':') END AS made, regexp_matches(name, '^(Assets|Equity|Expenses|Income|Liabilities)(:[A-Z][A-Za-z0-9]*)+$') AS beancount_ok, regexp_matches(name, '^[^:]+(:[^:]+)+$') AND NOT contains(name, '  ') AS ledger_ok FROM (
    SELECT *, root IN ('Assets', 'Equity', 'Expenses', 'Income', 'Liabilities') AND len(parts) >= 1 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[A-Z][A-Za-z0-9]*$'))) = 0 AS ok FROM (SELECT id, name, string_split(name, ':')[1] AS root, list_transform(string_split(name, ':')[2:], lambda p: {_PASCAL('p')}) AS parts FROM ({_NAMES})))""")
def account_names(t):
    i = F.col("id")
    name = F.when(i % 6 == 0, F.concat(F.lit("Assets:Bank:"), F.upper("bank"), F.lit(":"), F.col("label"))).when(i % 6 == 1, "Cash:Bank").when(i % 6 == 2, "Liabilities:Card:7 stars").when(i % 6 == 3, F.concat(F.lit("Expenses:Eating out:"), F.col("bank"))).when(i % 6 == 4, "Income").otherwise("Equity:--:x")
    n = t["accounts"].select("id", name.alias("name"))
    return n.select("id", "name", books.beancount_name(F.col("name")).alias("made"), books.legal_beancount_name(F.col("name")).alias("beancount_ok"), books.legal_ledger_name(F.col("name")).alias("ledger_ok"))


@_query(f"SELECT id, commodity, cast(sum(amount_paise) AS BIGINT) AS off_paise FROM ({_POST}) WHERE NOT (id % 50 = 0 AND leg = 1) GROUP BY 1, 2 HAVING sum(amount_paise) <> 0")
def unbalanced_entries(t):
    return books.unbalanced(ledger.postings(_projected(t)).where("not (id % 50 = 0 and leg = 1)"))


_META = lambda c: f"coalesce(nullif(left(trim(regexp_replace(translate(coalesce({c}, ''), ';{{}},\"', '     '), ' +', ' ', 'g')), 200), ''), 'unknown')"


@_query(f"""SELECT id, 'dashboard_txn_ids: txn-' || id || chr(10) || 'dashboard_kind: transaction' || chr(10) || 'dashboard_category: ' || coalesce(nullif(lower(trim(coalesce(category, ''))), ''), 'unknown') || chr(10) || 'dashboard_source: ' || {_META('source')} || chr(10) || 'dashboard_channel: ' || {_META('channel')} || chr(10) || 'dashboard_email_type: ' || {_META('email_type')} || chr(10)
    || 'dashboard_account_ids: ' || coalesce(cast(account_id AS VARCHAR), 'none') || chr(10) || 'dashboard_card_ids: none' || CASE WHEN {_META('reference_number')} <> 'unknown' THEN chr(10) || 'dashboard_reference: ' || {_META('reference_number')} ELSE '' END AS meta FROM transactions WHERE coalesce(category, 'x') <> ' ' || chr(9)""")
def entry_metadata(t):
    return t["transactions"].where("coalesce(category, 'x') <> ' \t'").select("id", books.metadata("transaction").alias("meta"))


@_query("""SELECT p_partkey, CASE WHEN regexp_matches(s, '^[A-Z]+$') THEN s WHEN regexp_matches(s, '^[A-Z]') THEN '"' || s || '"' END AS token, left(trim(regexp_replace(translate(p_name || ';a,b"', ';,"', '   '), ' +', ' ', 'g')), 200) AS meta FROM (SELECT p_partkey, p_name, upper(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'ine-' || p_partkey WHEN 2 THEN '' ELSE '9x' END, '[^A-Za-z0-9]', '', 'g')) AS s FROM part)""")
def commodity_tokens(t):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "usd").when(k % 4 == 1, F.concat(F.lit("ine-"), k.cast("string"))).when(k % 4 == 2, "").otherwise("9x")
    return t["part"].select("p_partkey", books.commodity_token(raw).alias("token"), formatting.sanitized_meta(F.concat("p_name", F.lit(';a,b"'))).alias("meta"))


_LINE = "'    ' || account || repeat(' ', greatest(48 - length(account), 2)) || cast(cast(cast(amount_paise AS DECIMAL(22, 2)) / 100 AS DECIMAL(20, 2)) AS VARCHAR) || ' ' || commodity"


@_query(f"SELECT id, leg, {_LINE} AS line FROM ({_POST})")
def posting_lines(t):
    return ledger.postings(_projected(t)).select("id", "leg", books.posting_line(F.col("account"), F.col("amount_paise").cast("decimal(20,2)") / 100, F.col("commodity")).alias("line"))


@_query(f"SELECT date, sha256(string_agg({_LINE}, chr(10) ORDER BY id, leg)) AS digest FROM ({_POST}) GROUP BY 1")
def day_digests(t):
    return books.day_digests(ledger.postings(_projected(t)))


@_query(f"SELECT date, id, leg, account, amount_paise FROM ({_POST}) ORDER BY date, id, leg")
def journal_order(t):
    return books.in_file_order(ledger.postings(_projected(t))).select("date", "id", "leg", "account", "amount_paise")


@_query("SELECT 'P ' || strftime(cast(o_orderdate AS DATE), '%Y/%m/%d') || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END || ' ' || cast(cast(o_totalprice AS DECIMAL(12, 2)) AS DECIMAL(18, 4)) || ' INR' AS line FROM orders")
def price_lines(t):
    rate = F.col("o_totalprice").cast("decimal(12,2)").cast("decimal(18,4)")
    return t["orders"].select(books.price_line(F.col("o_orderdate").cast("date"), F.when(F.col("o_orderkey") % 2 == 0, "USD").otherwise("EUR"), rate).alias("line"))


@_query(f"""SELECT account_id, account, native_paise, projected_paise, external_paise, CASE WHEN projected_paise IS NULL THEN 'not_projected' WHEN external_paise IS NULL THEN 'not_loaded' WHEN native_paise IS NULL THEN 'no_balance' WHEN projected_paise <> external_paise THEN 'stale_external' WHEN native_paise <> projected_paise THEN 'drift' ELSE 'agrees' END AS note FROM (
    SELECT a.id AS account_id, a.name AS account, n.paise AS native_paise, (CASE WHEN a.kind = 'liability' THEN -1 ELSE 1 END * b.s)::BIGINT AS projected_paise, CASE WHEN a.id % 4 <> 0 THEN (CASE WHEN a.kind = 'liability' THEN -1 ELSE 1 END * (b.s + CASE WHEN a.id % 3 = 0 THEN 5 ELSE 0 END))::BIGINT END AS external_paise
    FROM (SELECT id, CASE WHEN type = 'credit_card' THEN 'liability' ELSE 'asset' END AS kind, CASE WHEN type = 'credit_card' THEN 'Liabilities:Card:' ELSE 'Assets:Bank:' END || upper(bank[1]) || bank[2:] || ':' || label AS name FROM accounts) a LEFT JOIN (SELECT account, sum(amount_paise) AS s FROM ({_POST}) GROUP BY 1) b ON b.account = a.name
    LEFT JOIN (SELECT account_id, {_paise('max(value)')} AS paise FROM balance_snapshots WHERE account_id IS NOT NULL GROUP BY 1) n ON n.account_id = a.id)""")
def ledger_comparison(t):
    a = t["accounts"].select(F.col("id").alias("account_id"), ledger.account_name(F.col("type"), F.col("bank"), F.col("label")).alias("account"), F.when(F.col("type") == "credit_card", "liability").otherwise("asset").alias("kind"))
    held = ledger.postings(_projected(t)).groupBy("account").agg(F.sum("amount_paise").cast("bigint").alias("balance_paise"))
    native = t["balance_snapshots"].where("account_id is not null").groupBy("account_id").agg(X.paise(F.max("value")).alias("paise"))
    shown = a.join(held.withColumnRenamed("account", "_h"), F.col("account") == F.col("_h")).where("account_id % 4 <> 0").select("account", (F.col("balance_paise") + F.when(F.col("account_id") % 3 == 0, 5).otherwise(0)).alias("paise"))
    return books.compared(a, native, held, shown)


@_query(f"SELECT category, {_paise('sum(amount)')} AS total_paise FROM transactions WHERE transaction_date BETWEEN DATE '{START}' AND DATE '{END}' AND category IS NOT NULL GROUP BY 1 ORDER BY -abs(sum(amount)), category")
def lines_by_magnitude(t):
    g = t["transactions"].where(F.col("transaction_date").between(START, END) & F.col("category").isNotNull()).groupBy("category").agg(X.paise(F.sum("amount")).alias("total_paise"))
    return cashflow.by_magnitude(g, "total_paise", "category")


@_query("SELECT category, kind, string_agg(label, ',' ORDER BY lower(label), id) AS labels FROM (SELECT category, kind, id, CASE WHEN id % 2 = 0 THEN 'b' ELSE 'A' END || id % 7 AS label FROM balance_snapshots) GROUP BY 1, 2")
def grouped_labels(t):
    rows = t["balance_snapshots"].select("category", "kind", "id", F.concat(F.when(F.col("id") % 2 == 0, "b").otherwise("A"), (F.col("id") % 7).cast("string")).alias("label"))
    return networth.grouped(rows).select("category", "kind", F.array_join(F.transform("rows", lambda r: r["label"]), ",").alias("labels"))


# ---- investments

_RAW = "p_partkey AS upload_id, 'F' || p_size % 3 AS source_ref, 'inf' || p_size % 4 AS isin, '2024-01-0' || (1 + (p_size + k) % 2) AS day, cast(10 AS VARCHAR) AS units"


@_query("""SELECT upload_id, source_ref, instrument, acquired_on, cast(row_number() OVER (PARTITION BY upload_id, source_ref, instrument, acquired_on ORDER BY k) - 1 AS BIGINT) AS occurrence, 10::BIGINT AS units FROM (SELECT p_partkey AS upload_id, 'F' || p_size % 3 AS source_ref, 'INF' || p_size % 4 AS instrument, DATE '2024-01-01' + cast((p_size + k) % 2 AS INTEGER) AS acquired_on, k FROM part, (VALUES (0), (1), (2)) AS v(k))""")
def extracted_lots(t):
    text = "to_json(named_struct('folios', array(named_struct('source_ref', concat('F', p_size % 3), 'schemes', array(named_struct('isin', concat(' inf', p_size % 4), 'transactions', transform(sequence(0, 2), k -> named_struct('date', concat('2024-01-0', 1 + (p_size + k) % 2), 'units', '10'))), named_struct('isin', '', 'transactions', array(named_struct('date', 'x', 'units', '1'))))))))"
    schema = "folios array<struct<source_ref:string,schemes:array<struct<isin:string,transactions:array<struct<date:string,units:string>>>>>>"
    docs = messages.json_objects(t["part"].select(F.col("p_partkey").alias("upload_id"), F.expr(text).alias("doc")), "doc", schema).select("upload_id", "doc.*")
    return investments.extracted_lots(docs, "upload_id").withColumn("units", F.col("units").cast("bigint"))


@_query(f"SELECT instrument, source_ref, acquired_on, cast(units AS BIGINT) AS units, cast(occurrence AS BIGINT) AS occurrence, string_agg(cast(upload_id AS VARCHAR), ',' ORDER BY upload_id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY {_BASE}, upload_id ORDER BY raw_id) - 1 AS occurrence FROM ({_LOTS}) WHERE reason IS NULL) GROUP BY {_BASE}, occurrence")
def lot_sources(t):
    out = investments.canonical_lots_with_sources(investments.classify(t["raw_lots"]))
    return out.select("instrument", "source_ref", "acquired_on", F.col("units").cast("bigint").alias("units"), F.col("occurrence").cast("bigint").alias("occurrence"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


_PRINT = "sha256(concat_ws('|', coalesce(upper(trim(isin)), ''), coalesce(source_ref, ''), cast(acquired_on AS VARCHAR), cast(cast(units AS BIGINT) AS VARCHAR), cast(cast(nav AS BIGINT) AS VARCHAR), lower(trim(coalesce(transaction_type, ''))), coalesce(reference, '')))"


@_query(f"SELECT fingerprint, max(n) AS copies, min(upload_id) AS first_upload FROM (SELECT {_PRINT} AS fingerprint, upload_id, count(*) AS n FROM raw_lots GROUP BY 1, 2) GROUP BY 1")
def canonical_raw(t):
    return investments.canonical_raw(t["raw_lots"])


@_query("SELECT portfolio_key, id AS upload_id, cast(CASE WHEN id % 4 <> 0 THEN id % 100 END AS BIGINT) AS value FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(portfolio_key)) ORDER BY statement_date DESC, id DESC) AS r FROM cas_uploads) WHERE r = 1")
def current_valuations(t):
    text = F.when(F.col("id") % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"value": "'), (F.col("id") % 100).cast("string"), F.lit('"}')))
    out = investments.current_valuations(t["cas_uploads"].withColumn("payload", text), "value string")
    return out.select("portfolio_key", "upload_id", F.col("payload.value").try_cast("bigint").alias("value"))


@_query(f"SELECT count(*) AS landed, min(raw_id) AS first_id FROM (SELECT min(raw_id) AS raw_id FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, {_BASE} ORDER BY raw_id) AS k FROM ({_LOTS}) WHERE reason IS NULL) GROUP BY upload_id, {_BASE}, k HAVING upload_id % 2 = 1)")
def persisted_lots(t):
    lots = investments.numbered_lots(investments.classify(t["raw_lots"]))
    keys = ["upload_id", *investments.BASE, "occurrence"]
    new = upkeep.landing(lots, lots.where("upload_id % 2 = 0").select(*keys), keys, "raw_id")
    return new.agg(F.count(F.lit(1)).cast("bigint").alias("landed"), F.min("raw_id").alias("first_id"))


@_query("SELECT instrument, cast(sum(v) AS BIGINT) AS value FROM (SELECT 'I' || user_id % 7 AS instrument, value::DECIMAL(16, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1 AND v IS NOT NULL GROUP BY 1")
def latest_instrument_values(t):
    own = t["events"].where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("portfolio_key"), F.col("ts").cast("date").alias("statement_date"), F.concat(F.lit("I"), (F.col("user_id") % 7).cast("string")).alias("instrument"), F.col("value").cast("decimal(16,0)").alias("value"))
    return investments.latest_values(own).select("instrument", F.col("value").cast("bigint").alias("value"))


@_query("SELECT label AS instrument, CASE WHEN count(DISTINCT asset_class) = 1 THEN max(asset_class) ELSE 'other' END AS asset_class, count(*) AS n FROM snapshot_holdings GROUP BY 1")
def instrument_classes(t):
    return investments.classes(t["snapshot_holdings"].withColumnRenamed("label", "instrument"))


@_query(f"SELECT l.raw_id, u.portfolio_key, count(*) AS n FROM ({_LOTS}) l JOIN cas_uploads u ON u.id = l.upload_id WHERE l.reason IS NULL GROUP BY 1, 2")
def lots_of_uploads(t):
    j = investments.with_uploads(investments.classify(t["raw_lots"]).where("reason is null"), t["cas_uploads"])
    return j.groupBy("raw_id", "portfolio_key").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@_query(f"SELECT instrument, source_ref, acquired_on, cast(units AS BIGINT) AS units, occurrence::BIGINT AS occurrence FROM ({_CANON}) ORDER BY instrument, source_ref, acquired_on, units, nav, kind, reference, occurrence")
def lots_in_order(t):
    return investments.in_order(investments.canonical_lots(investments.classify(t["raw_lots"]))).select("instrument", "source_ref", "acquired_on", F.col("units").cast("bigint").alias("units"), F.col("occurrence").cast("bigint").alias("occurrence"))


# ---- reports

_M = lambda x: f"coalesce(cast(try_cast({x} AS DECIMAL(20, 2)) AS VARCHAR), '0')"


@_query("""SELECT c_custkey AS id, v.month, v.forecast, v.actual, v.available, v.end_balance FROM customer, LATERAL (VALUES ('2024-01', (c_custkey % 9) || '.50', (c_custkey + 2) || '.25', '0', '7.00'), ('2024-02', '0', '0.00', '1.00', '0')) AS v(month, forecast, actual, available, end_balance) WHERE c_custkey % 5 <> 0""")
def budget_report(t):
    text = """{"budgetsByMonth": {"2024-01": {"forecast": "%F.5", "endOfMonthBalance": 7, "availableThisMonth": "x", "accounts": [{"actual": %K}, {"actual": "2.25"}, {"actual": "n/a"}, {"other": 1}]}, "2024-02": {"forecast": null, "availableThisMonth": 1.0}}}"""
    k = F.col("c_custkey")
    doc = F.replace(F.replace(F.lit(text), F.lit("%F"), (k % 9).cast("string")), F.lit("%K"), k.cast("string"))
    df = t["customer"].select(k.alias("id"), F.when(k % 5 == 0, "[]").otherwise(doc).alias("doc"))
    return reports.budget(df, "id", "doc")


@_query("SELECT c_custkey AS id, v.name, v.target, v.current FROM customer, LATERAL (VALUES ('debt', (c_custkey % 100) || '.00', '40.00'), ('equity', '60.50', '0')) AS v(name, target, current)")
def allocation_report(t):
    k = F.col("c_custkey")
    doc = F.replace(F.lit("""{"allocation_targets": [{"name": " debt ", "target": %K, "current": "40"}, {"name": "equity", "target": "60.5"}, {"name": "", "target": 1}, {"target": 2}], "aggregates": {}}"""), F.lit("%K"), (k % 100).cast("string"))
    return reports.allocation(t["customer"].select(k.alias("id"), doc.alias("doc")), "id", "doc")


@_query("SELECT c_custkey AS id, v.sequence, v.period, v.interval_days, v.n FROM customer, LATERAL (VALUES ('rent', 'monthly', 30::BIGINT, 3::BIGINT), ('gym' || c_custkey % 4, NULL, NULL, 0::BIGINT)) AS v(sequence, period, interval_days, n)")
def recurring_report(t):
    k = F.col("c_custkey")
    doc = F.replace(F.lit("""{"transaction_sequences": [{"key": "rent", "period": "monthly", "interval": 30, "transactions": [1, 2, 3]}, {"key": "gym%K", "period": " ", "interval": "x"}]}"""), F.lit("%K"), (k % 4).cast("string"))
    return reports.recurring(t["customer"].select(k.alias("id"), doc.alias("doc")), "id", "doc")


@_query("SELECT c_custkey AS id, '2023-24' AS year, v.section, v.account, v.amount FROM customer, LATERAL (VALUES ('income', 'Income:Salary', (c_custkey * 3) || '.00'), ('expenses', 'Expenses:Rent', '10.10'), ('tax', 'Tax', '0')) AS v(section, account, amount)")
def income_report(t):
    k = F.col("c_custkey")
    doc = F.replace(F.lit("""{"yearly": {"2023-24": {"income": {"Income:Salary": %K}, "expenses": {"Expenses:Rent": "10.1", " ": 5}, "tax": {"Tax": "none"}}}}"""), F.lit("%K"), (k * 3).cast("string"))
    return reports.income_statement(t["customer"].select(k.alias("id"), doc.alias("doc")), "id", "doc")


@_query("SELECT c_custkey AS id, 'Liabilities:Home' AS account, (c_custkey * 2) || '.00' AS drawn_amount, '5.00' AS repaid_amount, '0' AS interest_amount, '-1.50' AS balance_amount, '8.25' AS apr FROM customer")
def liabilities_report(t):
    k = F.col("c_custkey")
    doc = F.replace(F.lit("""{"liability_breakdowns": {"Liabilities:Home": {"drawn_amount": %K, "repaid_amount": "5", "balance_amount": "-1.5", "apr": 8.25}}}"""), F.lit("%K"), (k * 2).cast("string"))
    return reports.liabilities(t["customer"].select(k.alias("id"), doc.alias("doc")), "id", "doc")


@_query("SELECT c_custkey AS id, 'Assets:Gold' AS account, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey || '.00') ELSE '0' END AS market_amount FROM customer")
def assets_report(t):
    k = F.col("c_custkey")
    doc = F.concat(F.lit('{"asset_breakdowns": {"Assets:Gold": {"marketAmount": '), F.when(k % 2 == 0, k.cast("string")).otherwise("true"), F.lit("}}}"))
    return reports.assets(t["customer"].select(k.alias("id"), doc.alias("doc")), "id", "doc")


# ---- dates and times

_WRITTEN = ["d/M/yyyy", "d.M.yy", "d MMMM yyyy", "MMM d, yyyy", "EEEE, dd-MMM-yyyy", "yyyyMMdd", "yyyy/M/d", "dd-MM-yyyy hh:mm:ss a", "d'th of' MMMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "ddMMMyyyy"]


@_query("SELECT id, CASE WHEN id % 12 <> 11 THEN transaction_date END AS date FROM transactions")
def lenient_dates(t):
    """Dates written in eleven ways and one that is none."""
    i = F.col("id") % 12
    text = F.coalesce(*[F.when(i == k, F.date_format(F.col("transaction_date").cast("timestamp_ntz"), s)) for k, s in enumerate(_WRITTEN)], F.when(i == 11, "31.02.2024"))
    return t["transactions"].select("id", X.parse_date_leniently(text, 2024).alias("date"))

_SHAPES = ["dd/MM/yyyy", "d-MMM-yyyy", "dd-MM-yyyy", "d MMM yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yy"]


@_query("SELECT DISTINCT CASE WHEN id % 8 <> 7 THEN transaction_date END AS date, id % 8 AS shape FROM transactions WHERE transaction_date IS NOT NULL")
def day_first_dates(t):
    i = F.col("id") % 8
    text = F.coalesce(*[F.when(i == k, F.date_format("transaction_date", s)) for k, s in enumerate(_SHAPES)], F.lit("32/13/2024"))
    rows = t["transactions"].where("transaction_date is not null").select(X.parse_day_first(text).alias("date"), i.alias("shape"))
    return rows.select(F.when((F.col("shape") == 6) & (F.col("date") >= F.lit("2050-01-01").cast("date")), F.add_months("date", -1200)).otherwise(F.col("date")).alias("date"), "shape").distinct()


@_query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 3 = 0 THEN DATE '2024-01-01' END, (ts + INTERVAL 330 MINUTE)::DATE) AS date, cast(coalesce(CASE WHEN event_id % 4 = 0 THEN 60 END, floor(epoch((ts + INTERVAL 330 MINUTE)::TIME))) AS BIGINT) AS time_s, event_id % 4 <> 0 AS received_time FROM events")
def received_fallbacks(t):
    k = F.col("event_id")
    told = t["events"].select(k.alias("id"), F.when(k % 3 == 0, F.lit("2024-01-01").cast("date")).alias("date"), F.when(k % 4 == 0, 60).cast("bigint").alias("time_s"), F.col("ts").alias("received_at"))
    return messages.dated_by_arrival(told).select("id", "date", "time_s", "received_time")
