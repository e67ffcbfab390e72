"""Registered queries over the finance tables and their ANSI equivalents on the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.functions.vocabulary import ACQUISITIONS, CARD_IMPOSSIBLE, CARD_PAYMENT_MARKERS, CARD_REFUND_MARKERS, DISPOSALS, EXPENSE_SLUGS, FEE_REVERSAL_MARKERS, INCOME_SLUGS, LABELS, STALE_DAYS, bucket_sql, known_slugs
from tallyspark.operators import cashflow, classify, investments, ledger, linking, listing, matching, networth, statements
from tallyspark.sources.adapter import FinanceTables, oracle

START, END, TODAY, CUTOVER = "1996-01-01", "1996-12-31", "1997-03-15", "1997-12-31"
NW_TODAY = "2024-03-20"

_QUERIES: dict[str, Callable[[FinanceTables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Pieces of SQL that several oracles share.
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_FLOW = "CASE WHEN direction = 'credit' THEN amount ELSE -amount END"
_RANGE = f"transaction_date BETWEEN DATE '{START}' AND DATE '{END}'"
_BANK = "EXISTS (SELECT 1 FROM accounts a WHERE a.id = t.account_id AND a.type IN ('bank_account', 'debit_card'))"
_KNOWN_TYPE = "EXISTS (SELECT 1 FROM accounts a WHERE a.id = t.account_id AND a.type IN ('bank_account', 'debit_card', 'credit_card'))"
_INR = "(currency IS NULL OR currency = 'INR')"
_UNCAT = f"(category IS NULL OR trim(category, {_BLANK}) = '' OR category = 'unknown' OR category NOT IN {_in(known_slugs())})"


def _blank_null(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR trim({c}, {_BLANK}) = '' THEN NULL ELSE {c} END"


def _paise(x: str) -> str:
    return f"coalesce(cast({x} * 100 AS BIGINT), 0)"


def _label(c: str) -> str:
    title = f"array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    cases = " ".join(f"WHEN {c} = '{s}' THEN '{n}'" for s, n in LABELS.items())
    return f"CASE WHEN {c} IS NULL THEN '(uncategorized)' WHEN {c} <> 'unknown' AND {c} NOT IN {_in(known_slugs())} THEN 'unmapped: ' || {c} {cases} ELSE {title} END"


# ---- cash flow

_BUCKETS = bucket_sql("category", True)


@_query(f"""SELECT bucket, slug, {_label('slug')} AS label, kind, {_paise("CASE WHEN bucket = 'income' THEN f ELSE -f END")} AS total_paise, n FROM (
    SELECT {_BUCKETS} AS bucket, category AS slug, CASE WHEN {_BUCKETS} = 'investment' THEN CASE WHEN direction = 'debit' THEN 'contribution' ELSE 'redemption' END END AS kind,
      sum({_FLOW}) AS f, count(*) AS n FROM transactions t WHERE {_RANGE} AND {_INR} AND {_BANK} GROUP BY 1, 2, 3) WHERE bucket IN ('income', 'expense', 'investment')""")
def cashflow_buckets(t):
    return cashflow.buckets(t["transactions"], t["accounts"], START, END)


@_query(f"SELECT {_blank_null('counterparty')} AS counterparty, {_paise(f'sum({_FLOW})')} AS total_paise, count(*) AS n FROM transactions t WHERE {_RANGE} AND {_INR} AND {_BANK} AND category = 'repayment' GROUP BY 1")
def cashflow_transfers_in(t):
    return cashflow.transfers_in(t["transactions"], t["accounts"], START, END)


@_query(f"""SELECT slug, {_label('slug')} AS label, total_paise, n FROM (SELECT {_blank_null('category')} AS slug, {_paise(f'sum({_FLOW})')} AS total_paise, count(*) AS n
    FROM transactions t WHERE {_RANGE} AND {_BANK} AND {_UNCAT} GROUP BY 1)""")
def cashflow_uncategorized(t):
    return cashflow.uncategorized(t["transactions"], t["accounts"], START, END)


@_query(f"SELECT category AS slug, {_paise(f'-sum({_FLOW})')} AS total_paise, count(*) AS n FROM transactions t WHERE {_RANGE} AND {_INR} AND {bucket_sql('category', False)} = 'expense' GROUP BY 1")
def cashflow_expense_detail(t):
    return cashflow.expense_detail(t["transactions"], START, END)


_SELF, _FAM, _LOST, _UND = f"{_RANGE} AND {_BANK} AND category = 'self_transfer'", f"{_RANGE} AND category = 'family'", f"{_RANGE} AND NOT {_KNOWN_TYPE}", "transaction_date IS NULL"


@_query(f"""SELECT i.n AS internal_count, i.g AS internal_gross, i.f AS internal_net, x.n AS non_inr_count, u.n AS undated_count, u.f AS undated_net, l.n AS unaccounted_count, l.f AS unaccounted_net, m.n AS family_count, m.f AS family_net
    FROM (SELECT count(*) AS n, {_paise('sum(amount)')} AS g, {_paise(f'sum({_FLOW})')} AS f FROM transactions t WHERE {_SELF}) i,
    (SELECT count(*) AS n FROM transactions t WHERE {_RANGE} AND {_BANK} AND currency IS NOT NULL AND currency <> 'INR') x,
    (SELECT count(*) AS n, {_paise(f'sum({_FLOW})')} AS f FROM transactions t WHERE {_UND}) u, (SELECT count(*) AS n, {_paise(f'sum({_FLOW})')} AS f FROM transactions t WHERE {_LOST}) l,
    (SELECT count(*) AS n, {_paise(f'sum({_FLOW})')} AS f FROM transactions t WHERE {_FAM}) m""")
def cashflow_footnotes(t):
    return cashflow.footnotes(t["transactions"], t["accounts"], START, END)


@_query(f"""SELECT income, transfers_in, expense, net_invested, income + transfers_in - expense - net_invested AS net_cash_retained FROM (SELECT
    {_paise(f"sum(CASE WHEN b = 'income' THEN f END)")} AS income, {_paise(f"sum(CASE WHEN b = 'transfers_in' THEN f END)")} AS transfers_in, {_paise(f"sum(CASE WHEN b = 'expense' THEN -f END)")} AS expense,
    {_paise(f"sum(CASE WHEN b = 'investment' THEN -f END)")} AS net_invested FROM (SELECT {_BUCKETS} AS b, {_FLOW} AS f FROM transactions t WHERE {_RANGE} AND {_INR} AND {_BANK}))""")
def cashflow_net(t):
    return cashflow.net(t["transactions"], t["accounts"], START, END)


@_query(f"""SELECT m.month, {_paise("sum(CASE WHEN inr AND b = 'income' THEN f END)")} AS income, {_paise("sum(CASE WHEN inr AND b = 'expense' THEN -f END)")} AS expense,
    {_paise("sum(CASE WHEN inr AND b = 'investment' THEN -f END)")} AS net_invested, count(*) FILTER (WHERE category = 'salary') AS salary_count
    FROM (SELECT strftime(g, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1996-04-01', DATE '1997-03-01', INTERVAL 1 MONTH)) AS g)) m
    LEFT JOIN (SELECT strftime(transaction_date, '%Y-%m') AS month, category, {_INR} AS inr, {_BUCKETS} AS b, {_FLOW} AS f FROM transactions t
      WHERE transaction_date BETWEEN DATE '1996-04-01' AND DATE '{TODAY}' AND {_BANK}) x ON x.month = m.month GROUP BY 1""")
def cashflow_trend(t):
    return cashflow.trend(t["transactions"], t["accounts"], 12, TODAY)


@_query(f"""SELECT CASE WHEN {_BANK} THEN 'bank' WHEN {_KNOWN_TYPE} THEN 'card' ELSE 'unaccounted' END AS scope, count(*) AS n, {_paise(f'sum({_FLOW})')} AS net_paise FROM transactions t GROUP BY 1""")
def scope_partition(t):
    out = None
    for scope in ("bank", "card", "unaccounted"):
        part = cashflow.in_scope(t["transactions"], t["accounts"], scope).agg(F.count(F.lit(1)).cast("bigint").alias("n"), X.paise(cashflow.flow()).alias("net_paise")).select(F.lit(scope).alias("scope"), "n", "net_paise")
        out = part if out is None else out.unionByName(part)
    return out


# ---- listings and reads

_CCY = "coalesce(nullif(upper(trim(currency)), ''), 'INR')"


@_query(f"""SELECT c.currency, coalesce(credits, 0) AS credits, coalesce(debits, 0) AS debits, coalesce(credits, 0) - coalesce(debits, 0) AS net FROM (SELECT {_CCY} AS currency FROM transactions UNION SELECT 'INR') c
    LEFT JOIN (SELECT {_CCY} AS currency, {_paise("sum(CASE WHEN direction = 'credit' THEN amount END)")} AS credits, {_paise("sum(CASE WHEN direction = 'debit' THEN amount END)")} AS debits FROM transactions GROUP BY 1) s ON s.currency = c.currency""")
def totals_by_currency(t):
    return listing.totals_by_currency(t["transactions"])


@_query(f"""SELECT id, transaction_date, {_paise('amount')} AS amount_paise, category FROM transactions t WHERE bank = 'hdfc' AND {_BANK} AND {_UNCAT} ORDER BY amount DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50""")
def txn_page(t):
    own = listing.filtered(t["transactions"], t["accounts"], bank="hdfc", uncategorized=True, scope="bank")
    return listing.page(own, "amount", True, 2).select("id", "transaction_date", X.paise(F.col("amount")).alias("amount_paise"), "category")


@_query(f"""SELECT direction, count(*) AS n, count(*) FILTER (WHERE currency IS NOT NULL AND currency <> 'INR') AS foreign_rows FROM transactions t
    WHERE transaction_date >= DATE '1997-01-01' AND transaction_date <= DATE '1999-06-30' AND (counterparty IS NULL OR trim(counterparty, {_BLANK}) = '') AND NOT {_KNOWN_TYPE} GROUP BY 1""")
def filtered_listing(t):
    own = listing.filtered(t["transactions"], t["accounts"], start="1997-01-01", end="1999-06-30", counterparty=" ", scope="unaccounted")
    return own.groupBy("direction").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(X.non_inr(F.col("currency"))).cast("bigint").alias("foreign_rows"))


@_query("SELECT id, transaction_date, direction FROM transactions ORDER BY transaction_date DESC NULLS LAST, id DESC LIMIT 20")
def recent_txns(t):
    return listing.page(t["transactions"], "transaction_date", True, 1, 20).select("id", "transaction_date", "direction")


@_query("""SELECT a.id, count(DISTINCT t.id) AS txns, (SELECT count(*) FROM statement_uploads s WHERE s.account_id = a.id) AS statements FROM accounts a LEFT JOIN transactions t ON t.account_id = a.id GROUP BY a.id""")
def account_counts(t):
    return listing.account_counts(t["accounts"], t["transactions"], t["statement_uploads"])


@_query("""SELECT id, account_id, cast(position AS INTEGER) AS position, truncated FROM (SELECT id, account_id, row_number() OVER (PARTITION BY account_id ORDER BY is_primary DESC NULLS LAST, id) AS position,
    count(*) OVER (PARTITION BY account_id) > 1 AS truncated FROM cards) WHERE position <= 1""")
def cards_top_n(t):
    return listing.first_cards(t["cards"], 1).select("id", "account_id", "position", "truncated")


@_query(f"""SELECT account_id, category, id, as_of_date, {_paise('value')} AS value_paise FROM (SELECT *, row_number() OVER (PARTITION BY account_id, category ORDER BY as_of_date DESC, id DESC) AS r
    FROM balance_snapshots WHERE account_id IS NOT NULL) WHERE r = 1""")
def latest_snapshot_per_category(t):
    return listing.latest_snapshots(t["balance_snapshots"]).select("account_id", "category", "id", "as_of_date", X.paise(F.col("value")).alias("value_paise"))


@_query("SELECT bank FROM accounts UNION SELECT bank FROM statement_uploads")
def distinct_banks(t):
    return t["accounts"].select("bank").union(t["statement_uploads"].select("bank")).distinct()


@_query("""SELECT relation, missing, count(*) AS n FROM (SELECT 'transactions.account_id' AS relation, account_id AS missing FROM transactions t WHERE account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = t.account_id)
    UNION ALL SELECT 'balance_snapshots.manual_item_id', manual_item_id FROM balance_snapshots b WHERE manual_item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manual_items m WHERE m.id = b.manual_item_id)) GROUP BY 1, 2""")
def fk_violations(t):
    both = listing.without_match(t["transactions"], "account_id", t["accounts"], "id", "transactions.account_id").unionByName(listing.without_match(t["balance_snapshots"], "manual_item_id", t["manual_items"], "id", "balance_snapshots.manual_item_id"))
    return both.groupBy("relation", "missing").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@_query("SELECT w.position, w.wanted, o.bank, o.bank IS NOT NULL AS found FROM (VALUES (0, 5), (1, 999999999), (2, 3), (3, 5)) AS w(position, wanted) LEFT JOIN accounts o ON o.id = w.wanted")
def batch_by_ids(t):
    spark = t.spark
    ids = spark.sql("SELECT * FROM VALUES (0, 5), (1, 999999999), (2, 3), (3, 5) AS w(position, wanted)")
    return listing.in_request_order(ids, t["accounts"], "id").select("position", "wanted", "bank", "found")


@_query("SELECT id, substr(body, 1, 40) AS text, length(body) > 40 AS truncated FROM sms_messages WHERE body ILIKE '%the %'")
def bounded_messages(t):
    return t["sms_messages"].where(F.col("body").ilike("%the %")).select("id", *listing.bounded_text(F.col("body"), 40))


@_query("""SELECT id, CASE WHEN regexp_replace(coalesce(card_mask, ''), '[^0-9]', '', 'g') <> '' THEN 'XXXX' || right(regexp_replace(coalesce(card_mask, ''), '[^0-9]', '', 'g'), 4) END AS shown FROM transactions""")
def redacted_masks(t):
    return t["transactions"].select("id", listing.display_mask(F.col("card_mask")).alias("shown"))


@_query("SELECT id, category_method FROM transactions WHERE category_method IS NULL OR category_method = 'pending_llm' OR (category_method = 'llm' AND category = 'unknown') ORDER BY id LIMIT 500")
def needs_categorization(t):
    return classify.needs_work(t["transactions"], 500)


# ---- net worth

_KEY = "CASE WHEN s.account_id IS NOT NULL THEN concat_ws('|', 'acct', s.account_id, s.category) WHEN s.portfolio_key IS NOT NULL THEN concat_ws('|', 'inv', s.portfolio_key, s.category) ELSE concat_ws('|', 'man', s.manual_item_id) END"
_ACTIVE = f"""SELECT s.*, {_KEY} AS source, coalesce(a.label, m.name) AS known FROM balance_snapshots s LEFT JOIN accounts a ON a.id = s.account_id LEFT JOIN manual_items m ON m.id = s.manual_item_id
    WHERE coalesce(a.active, true) AND coalesce(m.active, true) AND s.as_of_date <= DATE '{NW_TODAY}'"""
_STALE = "CASE category " + " ".join(f"WHEN '{c}' THEN {d}" for c, d in STALE_DAYS.items()) + " ELSE 9999 END"
_CURRENT = f"""SELECT b.source, b.id, coalesce(b.known, u.investor_name, b.portfolio_key, 'Unknown') AS label, b.category, b.kind, {_paise('b.value')} AS value_paise, b.as_of_date,
    DATE '{NW_TODAY}' - b.as_of_date > {_STALE.replace('category', 'b.category', 1)} AS stale, coalesce(u.id IS NOT NULL AND NOT u.portfolio_ok, false) AS unreconciled
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY as_of_date DESC, id DESC) AS r FROM ({_ACTIVE})) b LEFT JOIN cas_uploads u ON u.id = b.cas_upload_id WHERE r = 1 AND b.currency = 'INR'"""


def _current(t):
    return networth.current(t["balance_snapshots"], t["accounts"], t["manual_items"], t["cas_uploads"], NW_TODAY)


@_query(_CURRENT)
def networth_current(t):
    return _current(t)


@_query(f"""SELECT assets, liabilities, has_stale, assets - liabilities AS net_worth FROM (SELECT cast(sum(CASE WHEN kind = 'asset' THEN value_paise ELSE 0 END) AS BIGINT) AS assets, cast(sum(CASE WHEN kind = 'liability' THEN value_paise ELSE 0 END) AS BIGINT) AS liabilities, bool_or(stale) AS has_stale FROM ({_CURRENT}))""")
def networth_totals(t):
    return networth.totals(_current(t))


@_query(f"SELECT category, kind, cast(sum(value_paise) AS BIGINT) AS total_paise, count(*) AS n, count(*) FILTER (WHERE stale) AS stale FROM ({_CURRENT}) GROUP BY 1, 2")
def networth_groups(t):
    return networth.groups(_current(t))


@_query(f"SELECT asset_class, label, {_paise('sum(value)')} AS value_paise FROM snapshot_holdings h WHERE snapshot_id IN (SELECT id FROM ({_CURRENT}) WHERE category = 'investment') GROUP BY 1, 2")
def networth_breakdown(t):
    return networth.breakdown(_current(t), t["snapshot_holdings"])


@_query(f"""SELECT strftime(g, '%Y-%m') AS month, (SELECT {_paise("sum(CASE WHEN currency <> 'INR' THEN 0 WHEN kind = 'asset' THEN value WHEN kind = 'liability' THEN -value ELSE 0 END)")}
      FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY as_of_date DESC, id DESC) AS r FROM live WHERE as_of_date < g + INTERVAL 1 MONTH) WHERE r = 1) AS value_paise
    FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(as_of_date) FROM live)), DATE '{NW_TODAY}', INTERVAL 1 MONTH)) AS g)""")
def networth_trend(t):
    return networth.monthly_trend(t["balance_snapshots"], t["accounts"], t["manual_items"], NW_TODAY)


# ---- categorization

_TEXT = "trim(regexp_replace(regexp_replace(lower(concat_ws(' ', nullif(counterparty, ''), nullif(raw_description, ''))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_FD = "(lower(trim(coalesce(counterparty, ''))) = lower(trim(coalesce(bank, ''))) || ' fd')"
_MERCHANT = f"""SELECT id, rule_id, CASE WHEN rule_category = 'investment' AND direction = 'credit' THEN 'investment_redemption' ELSE rule_category END AS merchant_slug FROM (
    SELECT x.id, x.direction, r.id AS rule_id, r.category AS rule_category, row_number() OVER (PARTITION BY x.id ORDER BY r.priority, length(r.pattern) DESC, r.id) AS n
    FROM (SELECT id, direction, {_TEXT} AS text FROM transactions) x JOIN merchant_rules r ON r.active AND trim(r.pattern) <> '' AND contains(x.text, lower(trim(r.pattern)))
      AND NOT (contains(x.text, 'spent on') AND contains(x.text, 'credit card') AND r.category = 'credit_card_payment')
      AND NOT (x.direction = 'credit' AND r.category IN {_in(EXPENSE_SLUGS)}) AND NOT (x.direction = 'debit' AND r.category IN {_in(INCOME_SLUGS)})) WHERE n = 1"""


def _marker(text: str, markers: list[str]) -> str:
    return f"regexp_matches(' ' || {text} || ' ', '( {' | '.join(markers)} )')"


@_query(_MERCHANT)
def merchant_rule_match(t):
    return classify.merchant_match(t["transactions"], t["merchant_rules"])


_CASCADE = [
    (_FD, "CASE WHEN direction = 'credit' THEN 'investment_redemption' ELSE 'investment' END", 0.95),
    ("lower(coalesce(channel, '')) = 'interest' AND direction <> 'debit'", "'interest'", 1.0),
    ("contains(email_type, 'cc_refund')", "'refund'", 0.9),
    ("contains(email_type, 'cc_payment') OR contains(email_type, 'cc_bill_paid') OR contains(email_type, 'cc_smartpay')", "'credit_card_payment'", 0.95),
    (f"direction = 'credit' AND {_marker('text', FEE_REVERSAL_MARKERS)}", "'fees_charges'", 0.9),
    (f"card AND {_marker('text', CARD_REFUND_MARKERS)}", "'refund'", 0.9),
    (f"card AND ({_marker('text', CARD_PAYMENT_MARKERS)} OR starts_with(text, 'payment '))", "'credit_card_payment'", 0.95),
    ("merchant_slug IS NOT NULL", "merchant_slug", 0.9),
    ("contains(regexp_replace(lower(coalesce(counterparty, '')), '[^a-z0-9]', '', 'g'), 'self')", "'self_transfer'", 0.9),
    ("card", "'credit_card_payment'", 0.7),
]


@_query(f"""SELECT id, CASE {' '.join(f'WHEN {w} THEN {v}' for w, v, _ in _CASCADE)} END AS slug, cast(CASE {' '.join(f'WHEN {w} THEN {c}' for w, _, c in _CASCADE)} END AS DOUBLE) AS confidence
    FROM (SELECT t.*, {_TEXT} AS text, t.direction = 'credit' AND coalesce(a.type = 'credit_card', false) AS card, m.merchant_slug FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id LEFT JOIN ({_MERCHANT}) m ON m.id = t.id)""")
def categorize_rules(t):
    return classify.categorize(t["transactions"], t["accounts"], t["merchant_rules"])


@_query(f"""SELECT id, CASE WHEN direction = 'debit' AND slug IN {_in([*INCOME_SLUGS, 'unknown'])} THEN 'expense' WHEN direction = 'credit' AND card AND slug IN {_in(EXPENSE_SLUGS + CARD_IMPOSSIBLE + ['unknown'])} THEN 'credit_card_payment'
    WHEN direction = 'credit' AND NOT card AND slug IN {_in([*EXPENSE_SLUGS, 'unknown'])} THEN 'repayment' ELSE slug END AS resolved FROM (SELECT t.id, t.direction, t.category AS slug, coalesce(a.type = 'credit_card', false) AS card FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id)""")
def polarity_guard(t):
    a = t["accounts"].select(F.col("id").alias("_a"), "type")
    return t["transactions"].join(a, F.col("account_id") == F.col("_a"), "left").select("id", classify.guard_polarity(F.col("category"), F.col("direction"), F.col("type")).alias("resolved"))


_DIG = "regexp_replace(coalesce({0}.account_mask, ''), '[^0-9]', '', 'g')"
_LEG = "coalesce(trim({0}.reference_number), '') <> '' AND NOT (lower(trim(coalesce({0}.counterparty, ''))) = lower(trim({0}.bank)) || ' fd')"
_A, _B = _DIG.format("x"), _DIG.format("y")


@_query(f"""SELECT x.id FROM transactions x WHERE {_LEG.format('x')} AND EXISTS (SELECT 1 FROM transactions y WHERE y.reference_number = x.reference_number AND y.direction <> x.direction AND {_LEG.format('y')} AND
    CASE WHEN x.account_id IS NOT NULL AND y.account_id IS NOT NULL THEN x.account_id <> y.account_id ELSE length({_A}) >= 3 AND length({_B}) >= 3 AND NOT ends_with({_A}, {_B}) AND NOT ends_with({_B}, {_A}) END)""")
def reference_self_transfers(t):
    return classify.reference_self_transfers(t["transactions"])


@_query("""SELECT trim(reference_number) AS reference, max(CASE WHEN direction = 'debit' THEN id END) AS debit_id, max(CASE WHEN direction = 'credit' THEN id END) AS credit_id FROM transactions
    WHERE category = 'self_transfer' AND trim(coalesce(reference_number, '')) <> '' GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (WHERE direction = 'debit') = 1 AND count(*) FILTER (WHERE direction = 'credit') = 1""")
def self_transfer_pairs(t):
    return classify.paired_legs(t["transactions"])


# ---- linking

def _mask(c: str) -> str:
    bare = f"regexp_replace(coalesce({c}, ''), '[\\s-]', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9Xx*#]+$') THEN regexp_replace({bare}, '[x*#]', 'X', 'g') ELSE '' END"


def _fits(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"({n} > 0 AND list_bool_and(list_transform(generate_series(1, greatest({n}, 1)), lambda i: ({a}[-i] = {b}[-i] OR {a}[-i] = 'X' OR {b}[-i] = 'X'))))"


_OPEN = f"SELECT id, lower(trim(bank)) AS bank, {_mask('card_mask')} AS cm, {_mask('account_mask')} AS am, coalesce(card_mask, '') = '' AND coalesce(account_mask, '') = '' AS bare, CASE WHEN contains(email_type, '_cc_') THEN 'credit_card' WHEN contains(email_type, '_dc_') THEN 'debit_card' WHEN contains(email_type, '_account_') THEN 'bank_account' END AS want FROM transactions WHERE account_id IS NULL"
_USABLE = "length(regexp_extract({0}, '([0-9]*)$', 1)) >= 3"
_STORED = f"SELECT id AS account_id, NULL::BIGINT AS card_id, lower(trim(bank)) AS bank, {_mask('account_number')} AS stored FROM accounts"
_CARDS = f"SELECT c.account_id, c.id AS card_id, lower(trim(a.bank)) AS bank, {_mask('c.card_mask')} AS stored FROM cards c JOIN accounts a ON a.id = c.account_id"


def _step(mask: str, side: str) -> str:
    return f"(SELECT o.id, max(s.account_id) AS account_id, max(s.card_id) AS card_id FROM ({_OPEN}) o JOIN ({side}) s ON s.bank = o.bank AND {_USABLE.format('o.' + mask)} AND s.stored <> '' AND {_fits('o.' + mask, 's.stored')} GROUP BY o.id HAVING count(*) = 1)"


@_query(f"""SELECT o.id, coalesce(s1.account_id, s2.account_id, s3.account_id, s4.account_id) AS account_id, s1.card_id, CASE WHEN s1.id IS NOT NULL THEN 'card' WHEN s2.id IS NOT NULL THEN 'card_account' WHEN s3.id IS NOT NULL THEN 'account' WHEN s4.account_id IS NOT NULL THEN 'bank' END AS step
    FROM ({_OPEN}) o LEFT JOIN {_step('cm', _CARDS)} s1 ON s1.id = o.id LEFT JOIN {_step('cm', _STORED)} s2 ON s2.id = o.id LEFT JOIN {_step('am', _STORED)} s3 ON s3.id = o.id
    LEFT JOIN (SELECT lower(trim(bank)) AS bank, type, max(id) AS account_id FROM accounts GROUP BY 1, 2 HAVING count(*) = 1 UNION ALL SELECT lower(trim(bank)), NULL, max(id) FROM accounts GROUP BY 1 HAVING count(*) = 1) s4 ON o.bare AND s4.bank = o.bank AND s4.type IS NOT DISTINCT FROM o.want
    UNION ALL SELECT id, account_id, NULL, 'linked before' FROM transactions WHERE account_id IS NOT NULL""")
def link_transactions(t):
    return linking.link(t["transactions"], t["accounts"], t["cards"])


@_query(f"SELECT card_mask AS mask, {_mask('card_mask')} AS normalized, cast(length(regexp_extract({_mask('card_mask')}, '([0-9]*)$', 1)) AS INTEGER) AS visible, {_fits(_mask('card_mask'), chr(39) + 'XX12X4' + chr(39))} AS fits FROM cards")
def mask_matrix(t):
    m = X.normalize_mask(F.col("card_mask"))
    return t["cards"].select(F.col("card_mask").alias("mask"), m.alias("normalized"), X.trailing_digits(m).alias("visible"), X.mask_matches(m, F.lit("XX12X4")).alias("fits"))


# ---- matching

@_query("""SELECT seq, CASE WHEN reason IS NULL THEN 'match' ELSE 'defer' END AS action, reason, CASE WHEN reason IS NULL THEN id END AS id, n AS candidates FROM (SELECT i.seq, count(*) AS n, max(s.id) AS id,
    CASE WHEN count(*) > 1 THEN 'multiple_candidates' WHEN bool_or(i.amount <> s.amount) THEN 'reference_amount_mismatch' WHEN bool_or(coalesce(i.balance <> s.balance, false)) THEN 'reference_balance_mismatch' END AS reason
    FROM incoming i JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND trim(s.reference_number) = trim(i.reference_number) AND trim(i.reference_number) <> '' GROUP BY i.seq)""")
def match_reference(t):
    return matching.by_reference(t["incoming"], t["transactions"])


_CP = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
_CPM = "({0} <> '' AND {1} <> '' AND (contains({0}, {1}) OR contains({1}, {0})))".format(_CP.format("s.counterparty"), _CP.format("i.counterparty"))
_AT, _SAT = "(date_diff('day', DATE '1970-01-01', i.transaction_date) * 86400 + i.transaction_time_s)", "(date_diff('day', DATE '1970-01-01', s.transaction_date) * 86400 + s.transaction_time_s)"
_OWN = "CASE WHEN i.received_time THEN 60 ELSE 600 END"
_FUZZY = f"""SELECT seq, id, bal_in, bal FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n, bool_or(cp) OVER (PARTITION BY seq) AS any_cp, bool_or(untimed) OVER (PARTITION BY seq) AS any_untimed FROM (
    SELECT i.seq, s.id, i.balance AS bal_in, s.balance AS bal, {_CPM} AS cp, i.transaction_time_s IS NULL OR s.transaction_time_s IS NULL AS untimed FROM incoming i JOIN transactions s
      ON s.bank = i.bank AND s.direction = i.direction AND s.amount = i.amount AND coalesce(s.currency, 'INR') = coalesce(i.currency, 'INR') AND CASE WHEN i.transaction_time_s IS NULL THEN s.transaction_date = i.transaction_date
      ELSE date_diff('day', DATE '1970-01-01', s.transaction_date) BETWEEN floor(({_AT} - {_OWN}) / 86400) AND floor(({_AT} + {_OWN}) / 86400)
        AND coalesce(abs({_AT} - {_SAT}) <= CASE WHEN i.received_time OR (s.received_time AND s.transaction_time_s IS NOT NULL) THEN 60 ELSE 600 END, true) END
    WHERE {_mask('i.account_mask')} = '' OR {_mask('s.account_mask')} = '' OR {_fits(_mask('i.account_mask'), _mask('s.account_mask'))}))
    WHERE CASE WHEN any_untimed THEN cp WHEN n > 1 AND any_cp THEN cp ELSE true END"""


@_query(f"SELECT seq, id FROM ({_FUZZY})")
def match_fuzzy_candidates(t):
    return matching.fuzzy_candidates(t["incoming"], t["transactions"]).select("seq", "id")


@_query(f"""SELECT seq, CASE WHEN n = 0 THEN 'insert' WHEN sure IS NOT NULL THEN 'match' ELSE 'defer' END AS action, sure AS id, CASE WHEN n > 0 AND sure IS NULL THEN CASE WHEN NOT known AND n > 1 THEN 'multiple_candidates' ELSE 'balance_ambiguous' END END AS reason, n AS candidates
    FROM (SELECT i.seq, count(c.id) AS n, bool_or(c.bal_in IS NOT NULL) AS known, CASE WHEN bool_or(c.bal_in IS NOT NULL) THEN CASE WHEN count(CASE WHEN c.bal IS NOT NULL THEN 1 END) = 1 THEN max(CASE WHEN c.bal IS NOT NULL THEN c.id END) END
      WHEN count(c.id) = 1 AND count(CASE WHEN c.bal IS NULL AND c.id IS NOT NULL THEN 1 END) = 1 THEN max(c.id) END AS sure FROM incoming i LEFT JOIN (SELECT * FROM ({_FUZZY}) WHERE bal_in IS NULL OR bal IS NULL OR bal = bal_in) c ON c.seq = i.seq GROUP BY i.seq)""")
def match_fuzzy(t):
    return matching.decide(t["incoming"], matching.fuzzy_candidates(t["incoming"], t["transactions"]))


@_query(f"""SELECT i.seq, max(s.id) AS id FROM incoming i JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND s.amount = i.amount AND coalesce(s.currency, 'INR') = coalesce(i.currency, 'INR') AND s.transaction_date = i.transaction_date
    AND CASE WHEN i.transaction_time_s >= 43200 THEN s.transaction_time_s // 3600 BETWEEN 1 AND 11 ELSE s.transaction_time_s // 3600 = 12 END AND abs(abs(i.transaction_time_s - s.transaction_time_s) - 43200) <= 600 AND {_CPM} GROUP BY i.seq HAVING count(*) = 1""")
def match_am_pm(t):
    return matching.twelve_hours_apart(t["incoming"], t["transactions"])


def _change(f: str) -> str:
    return f"""SELECT m.seq, m.id, '{f}' AS field, s.{f} AS old, i.{f} AS new FROM m JOIN incoming i ON i.seq = m.seq JOIN transactions s ON s.id = m.id WHERE i.{f} IS NOT NULL AND trim(i.{f}) <> ''
      AND (s.{f} IS NULL OR (i.by_email AND s.{f} <> i.{f} AND NOT (contains(lower(s.{f}), lower(i.{f})) AND length(i.{f}) < length(s.{f}))))"""


@_query("SELECT * FROM (WITH m AS (SELECT i.seq, max(s.id) AS id FROM incoming i JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND trim(s.reference_number) = trim(i.reference_number) AND trim(i.reference_number) <> '' GROUP BY i.seq "
        "HAVING count(*) = 1 AND NOT bool_or(i.amount <> s.amount) AND NOT bool_or(coalesce(i.balance <> s.balance, false))) " + " UNION ALL ".join(_change(f) for f in ("counterparty", "account_mask", "reference_number")) + ")")
def enrichment_diff(t):
    return matching.enrichment(t["incoming"], t["transactions"], matching.by_reference(t["incoming"], t["transactions"]))


# ---- statements

_DUE, _OWED = "try_strptime(due_date, '%d/%m/%Y')::DATE", "try_cast(replace(total_amount_due, ',', '') AS DECIMAL(16, 2))"


@_query(f"SELECT id, {_DUE} AS due, {_paise(_OWED)} AS due_paise, {_OWED} IS NULL AS bad_amount FROM statement_uploads")
def statement_parse(t):
    return statements.parsed(t["statement_uploads"]).select("id", "due", X.paise(F.col("amount_due")).alias("due_paise"), F.col("amount_due").isNull().alias("bad_amount"))


_CYCLES = f"""SELECT id, account_id, due, amount_due, coalesce(lag(due) OVER w + 1, created_on) AS start, CASE WHEN lead(due) OVER w IS NOT NULL THEN due + 1 END AS end_
    FROM (SELECT *, {_DUE} AS due, {_OWED} AS amount_due FROM statement_uploads) WHERE due IS NOT NULL WINDOW w AS (PARTITION BY account_id ORDER BY due, id)"""


@_query(f"SELECT id, account_id, due, start, end_ FROM ({_CYCLES})")
def cc_cycle_windows(t):
    return statements.cycles(t["statement_uploads"]).select("id", "account_id", "due", "start", F.col("end").alias("end_"))


@_query(f"""SELECT id, account_id, {_paise('coalesce(paid, 0)')} AS paid_paise, payments, CASE WHEN amount_due IS NULL THEN NULL WHEN coalesce(paid, 0) >= amount_due THEN 'paid' WHEN paid > 0 THEN 'partially_paid' ELSE 'unpaid' END AS status
    FROM (SELECT c.id, c.account_id, c.amount_due, sum(t.amount) AS paid, count(t.amount) AS payments FROM ({_CYCLES}) c LEFT JOIN transactions t ON t.direction = 'credit' AND t.account_id = c.account_id
      AND coalesce(t.transaction_date, t.created_at::DATE) >= c.start AND (c.end_ IS NULL OR coalesce(t.transaction_date, t.created_at::DATE) < c.end_) GROUP BY 1, 2, 3)""")
def cc_cycle_paid(t):
    return statements.cycle_payments(statements.cycles(t["statement_uploads"]), t["transactions"])


@_query(f"""SELECT account_id, id AS statement_id, due, {_paise('owed')} AS outstanding_paise, coalesce(owed > 0, false) AND due < DATE '2001-01-01' AS overdue FROM (SELECT *, CASE WHEN amount_due IS NULL THEN NULL WHEN payment_status = 'paid' OR amount_due <= 0 THEN 0 ELSE greatest(amount_due - coalesce(payment_paid_amount, 0), 0) END AS owed
    FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY due DESC, id) AS r FROM (SELECT *, {_DUE} AS due, {_OWED} AS amount_due FROM statement_uploads) WHERE due IS NOT NULL) WHERE r = 1)""")
def cc_outstanding(t):
    return statements.outstanding(t["statement_uploads"], "2001-01-01")


_CAND = """SELECT r.stmt_idx, t.id, t.account_id, cast(date_diff('day', r.date, t.transaction_date) AS INTEGER) AS "offset", coalesce(trim(r.reference_number) = trim(t.reference_number), false) AS same_reference FROM bank_statement_rows r JOIN transactions t
    ON t.account_id = r.account_id AND t.direction = r.direction AND t.amount = r.amount AND abs(date_diff('day', r.date, t.transaction_date)) <= 1"""


@_query(_CAND)
def stmt_candidates(t):
    return statements.candidates(t["bank_statement_rows"], t["transactions"])


@_query(f"SELECT stmt_idx FROM bank_statement_rows WHERE stmt_idx NOT IN (SELECT stmt_idx FROM ({_CAND}))")
def stmt_missing(t):
    rows = t["bank_statement_rows"]
    found = statements.candidates(rows, t["transactions"]).select(F.col("stmt_idx").alias("_s"))
    return rows.join(found, F.col("stmt_idx") == F.col("_s"), "left_anti").select("stmt_idx")


@_query(f"""SELECT t.id, t.account_id FROM transactions t JOIN (SELECT account_id, min(date) AS lo, max(date) AS hi FROM bank_statement_rows GROUP BY 1) s ON s.account_id = t.account_id AND t.transaction_date BETWEEN lo AND hi WHERE t.id NOT IN (SELECT id FROM ({_CAND}))""")
def stmt_extra(t):
    return statements.extra(t["bank_statement_rows"], t["transactions"])


_STANDS = lambda r, x: f"coalesce(regexp_matches({r}, '^[A-Za-z0-9]{{6,}}$') AND regexp_matches(' ' || {x} || ' ', '[^A-Za-z0-9]' || {r} || '[^A-Za-z0-9]'), false)"
_STRONG = f"({_STANDS('tr', 'st')} OR {_STANDS('sr', 'tt')})"
_MET = f"""SELECT stmt_idx, id, off, sr IS NOT NULL AND tr IS NOT NULL AND sr = tr AS same, abs(off) <= 1 AND CASE WHEN coalesce(sr = tr, false) THEN true WHEN coalesce(sb <> tb, false) THEN false WHEN sr IS NULL OR tr IS NULL THEN true WHEN off <> 0 THEN false ELSE {_STRONG} END AS fits, abs(off) <= 1 AND {_STRONG} AS strong, who
    FROM (SELECT r.stmt_idx, t.id, coalesce(date_diff('day', r.date, t.transaction_date), 99) AS off, nullif(trim(r.reference_number), '') AS sr, nullif(trim(t.reference_number), '') AS tr, r.narration AS st, coalesce(t.raw_description, t.counterparty) AS tt, r.balance AS sb, t.balance AS tb, nullif(trim(coalesce(r.narration, '')), '') AS who
      FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND t.amount = r.amount) WHERE abs(off) <= 1 OR sr = tr"""


def _pass(k: int, status: str, offset: int) -> str:
    """One date pass over p{k}, as windows over a statement row (mine) or a stored row (its)."""
    mine, its = "OVER (PARTITION BY stmt_idx)", "OVER (PARTITION BY id)"
    return f"""
    a{k} AS (SELECT *, open AND off = {offset} AS h0 FROM p{k}), b{k} AS (SELECT *, h0 AND (strong OR NOT bool_or(h0 AND strong) {mine}) AS h FROM a{k}), c{k} AS (SELECT *, h AND count(*) FILTER (WHERE h) {mine} = 1 AS sole FROM b{k}),
    d{k} AS (SELECT *, sole AND (held OR stmt_idx = min(CASE WHEN sole THEN stmt_idx END) {its}) AS pick FROM c{k}), e{k} AS (SELECT *, bool_or(pick) {its} OR bool_or(pick) {mine} AS out_ FROM d{k}),
    p{k + 1} AS (SELECT stmt_idx, id, off, same, fits, strong, held, open AND NOT out_ AS open, CASE WHEN pick AND NOT held THEN '{status}' ELSE status END AS status FROM e{k})"""


@_query(f"""SELECT * FROM (WITH m AS ({_MET}), t0 AS (SELECT *, same AND count(*) FILTER (WHERE same) OVER (PARTITION BY stmt_idx) = 1 AND count(*) FILTER (WHERE same) OVER (PARTITION BY id) = 1 AS told FROM m),
    t1 AS (SELECT *, bool_or(told) OVER (PARTITION BY id) AS gone, fits AND NOT bool_or(told) OVER (PARTITION BY stmt_idx) AS live FROM t0), t2 AS (SELECT *, CASE WHEN live THEN coalesce(who, '') END AS lw FROM t1),
    p0 AS (SELECT stmt_idx, id, off, same, fits, strong, count(*) FILTER (WHERE live) OVER (PARTITION BY id) > 1 AND NOT coalesce(min(lw) OVER (PARTITION BY id) = max(lw) OVER (PARTITION BY id) AND max(lw) OVER (PARTITION BY id) <> '', false) AS held, live AND NOT gone AS open, CASE WHEN told THEN 'reference' END AS status FROM t2),
    {_pass(0, 'date', 0)}, {_pass(1, 'date-1', -1)}, {_pass(2, 'date+1', 1)},
    f AS (SELECT stmt_idx, max(status) AS status, max(CASE WHEN status IS NOT NULL THEN id END) AS id, bool_or(fits OR same) AS known FROM p3 GROUP BY 1),
    o AS (SELECT DISTINCT r.stmt_idx FROM bank_statement_rows r JOIN transactions t ON t.account_id = r.account_id AND t.direction = r.direction AND trim(t.reference_number) = trim(r.reference_number) WHERE trim(r.reference_number) <> '' AND coalesce(t.amount <> r.amount, true))
    SELECT r.stmt_idx, f.id, coalesce(f.status, CASE WHEN f.known OR o.stmt_idx IS NOT NULL THEN 'ambiguous' ELSE 'missing' END) AS status FROM bank_statement_rows r LEFT JOIN f ON f.stmt_idx = r.stmt_idx LEFT JOIN o ON o.stmt_idx = r.stmt_idx)""")
def stmt_reconcile(t):
    return statements.reconcile(t["bank_statement_rows"], t["transactions"])


@_query(f"""SELECT account_id, credits, debits, n, credits - debits AS net FROM (SELECT account_id, {_paise("sum(CASE WHEN direction = 'credit' THEN amount END)")} AS credits, {_paise("sum(CASE WHEN direction = 'debit' THEN amount END)")} AS debits, count(*) AS n FROM bank_statement_rows GROUP BY 1)""")
def stmt_balance_check(t):
    return statements.balance_check(t["bank_statement_rows"])


# ---- ledger

_FXJ = "(SELECT r.rate FROM fx_rates r WHERE r.currency = t.currency AND r.date <= t.transaction_date ORDER BY r.date DESC LIMIT 1)"


@_query("""SELECT t.id, t.currency, t.transaction_date, cast(r.rate * 10000 AS BIGINT) AS rate_e4 FROM transactions t ASOF LEFT JOIN fx_rates r ON r.currency = t.currency AND r.date <= t.transaction_date""")
def fx_asof(t):
    return ledger.fx_as_of(t["transactions"], t["fx_rates"]).select("id", "currency", "transaction_date", (F.col("rate") * 10000).cast("bigint").alias("rate_e4"))


_SLUG = "coalesce(nullif(trim(category), ''), 'unknown')"
_WORDS = f"array_to_string(list_transform(string_split({_SLUG}, '_'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_CONTRA = f"""CASE WHEN {_SLUG} IN ('interest', 'other_income', 'salary', 'tax_refund') THEN 'Income:' || {_WORDS} WHEN {_SLUG} IN {_in(EXPENSE_SLUGS + ['refund', 'cashback_rewards'])} THEN 'Expenses:' || {_WORDS} WHEN {_SLUG} IN ('investment', 'investment_redemption') THEN 'Assets:Investments:Unallocated'
    WHEN {_SLUG} = 'repayment' THEN 'Equity:Transfers In' WHEN {_SLUG} = 'self_transfer' THEN 'Equity:Transfers' WHEN {_SLUG} = 'credit_card_payment' THEN 'Liabilities:Credit Card' WHEN {_SLUG} = 'family' THEN 'Expenses:Family' ELSE 'Equity:Unknown' END"""
_COMM = "CASE WHEN trim(coalesce(t.currency, '')) = '' THEN 'INR' ELSE t.currency END"
_PROJ = f"""SELECT p.*, CASE WHEN account_id IS NULL THEN 'orphan' WHEN acc IS NULL THEN 'unknown_account' WHEN commodity <> 'INR' AND commodity NOT IN (SELECT currency FROM fx_rates) THEN 'non_inr'
      WHEN commodity <> 'INR' AND NOT EXISTS (SELECT 1 FROM fx_rates r WHERE r.currency = p.commodity AND r.date <= p.transaction_date) THEN 'missing_fx_rate' WHEN category = 'credit_card_payment' AND type = 'credit_card' THEN 'card_side_payment' END AS reason
    FROM (SELECT t.id, t.account_id, t.transaction_date, t.direction, t.amount, t.category, {_COMM} AS commodity, a.id AS acc, a.type, {_CONTRA.replace('category', 't.category')} AS contra,
      CASE WHEN a.type = 'credit_card' THEN 'Liabilities:Card:' ELSE 'Assets:Bank:' END || upper(a.bank[1]) || a.bank[2:] || ':' || a.label AS own FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id WHERE t.transaction_date > DATE '{CUTOVER}') p"""
_POST = f"""SELECT id, transaction_date AS date, leg, CASE WHEN leg = 0 THEN own ELSE contra END AS account, commodity, cast(CASE WHEN (direction = 'credit') = (leg = 0) THEN amount ELSE -amount END * 100 AS BIGINT) AS amount_paise FROM ({_PROJ}), (VALUES (0), (1)) AS l(leg) WHERE reason IS NULL"""


def _projected(t):
    return ledger.projected(t["transactions"], t["accounts"], t["fx_rates"], CUTOVER)


@_query(_POST)
def ledger_postings(t):
    return ledger.postings(_projected(t))


@_query(f"SELECT account, commodity, cast(sum(amount_paise) AS BIGINT) AS balance_paise, count(*) AS n FROM ({_POST}) GROUP BY 1, 2")
def ledger_balances(t):
    return ledger.balances(ledger.postings(_projected(t)))


@_query(f"SELECT reason, count(*) AS n FROM ({_PROJ}) WHERE reason IS NOT NULL GROUP BY 1")
def ledger_skipped(t):
    return ledger.skipped(_projected(t))


@_query(f"""SELECT id AS account_id, {_paise("CASE WHEN type = 'credit_card' THEN -v ELSE v END")} AS opening_paise, CASE WHEN snap IS NOT NULL THEN 'snapshot' ELSE 'running' END AS origin FROM (SELECT a.id, a.type, s.value AS snap, coalesce(s.value, r.balance) AS v FROM accounts a
    LEFT JOIN (SELECT account_id, value, row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC, id DESC) AS n FROM balance_snapshots WHERE as_of_date <= DATE '2023-10-31' AND currency = 'INR') s ON s.account_id = a.id AND s.n = 1
    LEFT JOIN (SELECT account_id, balance, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, id DESC) AS n FROM transactions WHERE transaction_date <= DATE '2023-10-31' AND balance IS NOT NULL) r ON r.account_id = a.id AND r.n = 1) WHERE v IS NOT NULL""")
def opening_balances(t):
    return ledger.opening_balances(t["accounts"], t["balance_snapshots"], t["transactions"], "2023-10-31")


@_query(f"""SELECT portfolio_key, as_of_date, {_paise('d')} AS delta_paise FROM (SELECT portfolio_key, as_of_date, v - coalesce(lag(v) OVER (PARTITION BY portfolio_key ORDER BY as_of_date), 0) AS d FROM (SELECT portfolio_key, as_of_date, CASE WHEN currency = 'INR' THEN value ELSE 0 END AS v,
    row_number() OVER (PARTITION BY portfolio_key, as_of_date ORDER BY id DESC) AS r FROM balance_snapshots WHERE portfolio_key IS NOT NULL) WHERE r = 1) WHERE d <> 0""")
def valuation_deltas(t):
    return ledger.valuation_deltas(t["balance_snapshots"])


# ---- investments

_KIND, _ISIN = "lower(trim(coalesce(transaction_type, '')))", "nullif(upper(trim(coalesce(isin, ''))), '')"
_HAS = lambda words: "(" + " OR ".join(f"contains({_KIND}, '{w}')" for w in words) + ")"
_LOTS = f"""SELECT *, {_ISIN} AS instrument, {_KIND} AS kind, CASE WHEN lower(scope) <> 'mf' THEN 'not_mutual_fund' WHEN {_HAS(DISPOSALS)} THEN 'disposal_transaction' WHEN NOT {_HAS(ACQUISITIONS)} THEN 'ambiguous_transaction_type'
    WHEN units <= 0 OR nav <= 0 OR amount <= 0 OR acquired_on IS NULL OR {_ISIN} IS NULL THEN 'missing_lot_facts' WHEN abs(cast(units AS DECIMAL(14, 4)) * cast(nav AS DECIMAL(14, 4)) - amount) >= 0.01 THEN 'cost_basis_inconsistent' END AS reason FROM raw_lots"""
_BASE = ", ".join(investments.BASE)
_CANON = f"""SELECT {_BASE}, occurrence, min(upload_id) AS first_upload, count(*) AS uploads FROM (SELECT *, row_number() OVER (PARTITION BY {_BASE}, upload_id ORDER BY raw_id) - 1 AS occurrence FROM ({_LOTS}) WHERE reason IS NULL) GROUP BY ALL"""


@_query(f"SELECT reason, kind, count(*) AS n, count(DISTINCT instrument) AS instruments FROM ({_LOTS}) GROUP BY 1, 2")
def lot_classification(t):
    return investments.classify(t["raw_lots"]).groupBy("reason", "kind").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.countDistinct("instrument").cast("bigint").alias("instruments"))


@_query(f"SELECT instrument, source_ref, acquired_on, cast(units AS BIGINT) AS units, reference, cast(occurrence AS INTEGER) AS occurrence, first_upload, uploads FROM ({_CANON})")
def canonical_lots(t):
    return investments.canonical_lots(investments.classify(t["raw_lots"])).select("instrument", "source_ref", "acquired_on", F.col("units").cast("bigint").alias("units"), "reference", "occurrence", "first_upload", "uploads")


@_query(f"SELECT instrument, count(*) AS lots, cast(sum(units) AS BIGINT) AS units, cast(sum(units * nav) * 100 AS BIGINT) AS cost_paise FROM ({_CANON}) GROUP BY 1")
def lot_totals(t):
    return investments.lot_totals(investments.canonical_lots(investments.classify(t["raw_lots"])))


@_query()
def disposal_resolution(t):
    return investments.disposals(investments.classify(t["raw_lots"]))


# ---- scalar functions

@_query("SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(body, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS normalized FROM sms_messages")
def text_normalize(t):
    return t["sms_messages"].select("id", X.normalize_text(F.col("body")).alias("normalized"))


@_query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '\d{11,}', '#', 'g') <> coalesce(text, '') AS long_digits FROM documents")
def digit_runs(t):
    return t["documents"].select("doc_id", F.coalesce("text", F.lit("")).rlike(r"\d{11,}").alias("long_digits"))


@_query()
def pii_redact(t):
    return t["documents"].select("doc_id", X.redact_pii(F.col("text")).alias("redacted"))


@_query("""SELECT transaction_date, strftime(transaction_date, '%Y-%m') AS month, date_trunc('month', transaction_date)::DATE AS month_start, last_day(transaction_date) AS month_end,
    make_date(year(transaction_date) - CASE WHEN month(transaction_date) < 4 THEN 1 ELSE 0 END, 4, 1) AS fy_start FROM (SELECT DISTINCT transaction_date FROM transactions WHERE transaction_date IS NOT NULL)""")
def calendar_keys(t):
    d = F.col("transaction_date")
    return t["transactions"].where(d.isNotNull()).select(d).distinct().select(d, X.month_key(d).alias("month"), F.trunc(d, "MM").alias("month_start"), F.last_day(d).alias("month_end"), X.financial_year_start(d).alias("fy_start"))


# ---- ingest (batch results of the streaming operators)

@_query("SELECT sender, body, count(*) AS copies, min(id) AS first_id FROM sms_messages GROUP BY 1, 2")
def message_dedup(t):
    return t["sms_messages"].groupBy("sender", "body").agg(F.count(F.lit(1)).cast("bigint").alias("copies"), F.min("id").alias("first_id"))


@_query("""SELECT user_id, cast(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2""")
def dirty_sessions(t):
    from tallyspark.streaming.ingest import dirty_windows

    return dirty_windows(t["events"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(FinanceTables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: oracle(sql) for name, sql in _SQL.items()}
    # the series reads its live snapshots by name
    with_live = oracle(f"SELECT 1 FROM ({_ACTIVE})").rsplit(" SELECT 1 FROM", 1)[0]
    with_state = oracle(f"SELECT 1 FROM ({reads._STATE}), transactions").rsplit(" SELECT 1 FROM", 1)[0]
    out["card_payment_accounts"] = f"{with_state}, state AS ({reads._STATE}) {_SQL['card_payment_accounts']}"
    out["networth_trend"] = f"{with_live}, live AS ({_ACTIVE}) {_SQL['networth_trend']}"
    return out


from tallyspark.plans import books, card_statements, mailbox, merging, reads, relations, upkeep, uploads  # noqa: E402, F401  (they register their queries here)
