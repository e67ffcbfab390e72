"""Domain adapter: finance tables as views over the driver's star-schema tables.

Every view is one SELECT in the subset that Spark and DuckDB share, so that the same text is a DataFrame here and a common
table expression of an oracle query.  Values come from integer arithmetic on keys and are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BANK = "CASE {0} % 5 WHEN 0 THEN 'hdfc' WHEN 1 THEN 'icici' WHEN 2 THEN 'kotak' WHEN 3 THEN 'sbi' ELSE 'axis' END"
_DIGITS = "lpad(cast({0} as string), 10, '7')"
_DMY = "lpad(cast(day({0}) as string), 2, '0') || '/' || lpad(cast(month({0}) as string), 2, '0') || '/' || cast(year({0}) as string)"
_MONEY_TEXT = (
    "CASE WHEN {0} >= 100000 THEN cast({0} div 100000 as string) || ',' || lpad(cast(({0} div 100) % 1000 as string), 3, '0') "
    "ELSE cast({0} div 100 as string) END || '.' || lpad(cast({0} % 100 as string), 2, '0')"
)

#: View name -> SELECT over {tables}; later views may read earlier ones.
VIEWS: dict[str, str] = {
    "accounts": f"""
        SELECT c_custkey AS id, {_BANK.format('c_nationkey')} AS bank, 'Account ' || cast(c_custkey as string) AS label,
          CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'bank_account' WHEN 'BUILDING' THEN 'bank_account' WHEN 'AUTOMOBILE' THEN 'debit_card'
            WHEN 'MACHINERY' THEN 'credit_card' ELSE 'prepaid_wallet' END AS type,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {_DIGITS.format('c_custkey')} END AS account_number,
          CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS active
        FROM {{customer}}""",
    "cards": f"""
        SELECT c_custkey * 10 + 1 AS id, c_custkey AS account_id, 'XX' || substr({_DIGITS.format('c_custkey')}, 7, 4) AS card_mask,
          'Primary' AS label, true AS is_primary, true AS active
        FROM {{customer}} WHERE c_mktsegment = 'MACHINERY'
        UNION ALL
        SELECT c_custkey * 10 + 2, c_custkey, '0000 XXXX XXXX ' || lpad(cast((c_custkey * 7) % 10000 as string), 4, '0'), 'Add-on', false, c_custkey % 4 <> 0
        FROM {{customer}} WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0""",
    "transactions": f"""
        SELECT o_orderkey AS id,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 900000000 + o_custkey ELSE o_custkey END AS account_id,
          {_BANK.format('c_nationkey')} AS bank,
          CASE o_orderkey % 7 WHEN 0 THEN 'bank_cc_debit' WHEN 1 THEN 'bank_account_debit' WHEN 2 THEN 'bank_dc_debit' WHEN 3 THEN 'upi_alert'
            WHEN 4 THEN 'bank_cc_refund' WHEN 5 THEN 'bank_cc_payment' ELSE 'bank_transfer' END AS email_type,
          CASE WHEN (o_orderkey * 7 + o_custkey) % 5 < 3 THEN 'debit' ELSE 'credit' END AS direction,
          cast(o_totalprice as decimal(12, 2)) AS amount,
          CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'INR' END AS currency,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE cast(o_orderdate as date) END AS transaction_date,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast((o_orderkey * 37) % 86400 as int) END AS transaction_time_s,
          o_orderkey % 10 = 3 AS received_time,
          CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) WHEN 3 THEN 'Acme Payroll Ltd' WHEN 4 THEN 'Swiggy*Order 12'
            WHEN 5 THEN 'Self Account' WHEN 6 THEN 'HDFC FD' WHEN 7 THEN 'Ravi Kumar @upi' ELSE 'Amazon Pay' END AS counterparty,
          CASE WHEN o_orderkey % 4 = 0 THEN 'XX' || substr({_DIGITS.format('o_custkey')}, 7, 4) WHEN o_orderkey % 29 = 0 THEN '12A3456' END AS card_mask,
          CASE WHEN o_orderkey % 4 = 1 THEN 'XXXXXX' || substr({_DIGITS.format('o_custkey')}, 7, 4) WHEN o_orderkey % 37 = 0 THEN '123XXXX' END AS account_mask,
          CASE WHEN o_orderkey % 3 = 0 THEN 'REF' || lpad(cast((o_orderkey div 3) % 2200 as string), 6, '0') WHEN o_orderkey % 41 = 0 THEN ' ' END AS reference_number,
          CASE o_orderkey % 5 WHEN 0 THEN 'upi' WHEN 1 THEN 'neft' WHEN 2 THEN 'Interest' WHEN 3 THEN 'card' END AS channel,
          CASE WHEN o_orderkey % 4 = 2 THEN cast(o_totalprice * 2 as decimal(12, 2)) END AS balance,
          CASE o_orderkey % 12 WHEN 0 THEN 'PAYMENT RECEIVED - thank you' WHEN 1 THEN 'Annual fee reversal' WHEN 2 THEN 'Refund/credit 9876543210'
            WHEN 3 THEN 'spent on your credit card' WHEN 4 THEN 'zomato order' WHEN 5 THEN 'ZERODHA broking' WHEN 6 THEN 'CC PAYMENT bbps' ELSE NULL END AS raw_description,
          CASE WHEN o_orderkey % 3 = 0 AND ((o_orderkey div 3) % 2200) % 10 = 0 THEN 'self_transfer' ELSE CASE (o_orderkey * 13 + o_custkey) % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) WHEN 3 THEN 'unknown' WHEN 4 THEN 'crypto'
            WHEN 5 THEN 'salary' WHEN 6 THEN 'interest' WHEN 7 THEN 'groceries' WHEN 8 THEN 'dining' WHEN 9 THEN 'refund' WHEN 10 THEN 'cashback_rewards'
            WHEN 11 THEN 'investment' WHEN 12 THEN 'investment_redemption' WHEN 13 THEN 'self_transfer' WHEN 14 THEN 'credit_card_payment'
            WHEN 15 THEN 'repayment' WHEN 16 THEN 'family' WHEN 17 THEN 'rent' WHEN 18 THEN 'fees_charges' ELSE 'misc' END END AS category,
          CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'rule' WHEN 2 THEN 'llm' WHEN 3 THEN 'pending_llm' ELSE 'manual' END AS category_method,
          CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' ELSE 'statement' END AS source,
          cast(o_orderdate as timestamp) AS created_at
        FROM {{orders}} LEFT JOIN {{customer}} ON o_custkey = c_custkey""",
    "incoming": """
        SELECT id AS seq, bank, direction, CASE WHEN id % 45 = 5 THEN amount + 1 ELSE amount END AS amount, currency, transaction_date,
          CASE WHEN transaction_time_s IS NULL OR id % 35 = 0 THEN NULL
            ELSE (transaction_time_s + CASE id % 4 WHEN 0 THEN 7 WHEN 1 THEN 540 WHEN 2 THEN 660 ELSE 43200 END) % 86400 END AS transaction_time_s,
          id % 20 = 10 AS received_time, CASE WHEN id % 3 = 0 THEN counterparty WHEN id % 3 = 1 THEN 'payroll' END AS counterparty,
          CASE WHEN id % 6 = 0 THEN 'XXXX1111' ELSE account_mask END AS account_mask, CASE WHEN id % 25 = 0 THEN NULL ELSE reference_number END AS reference_number,
          CASE WHEN id % 8 = 2 THEN balance + 5 ELSE balance END AS balance, id % 2 = 0 AS by_email
        FROM {transactions} WHERE id % 5 = 0""",
    "balance_snapshots": """
        SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN user_id END AS account_id,
          CASE WHEN event_type = 'purchase' THEN event_id END AS cas_upload_id, CASE WHEN event_type IN ('signup', 'error') THEN user_id % 100 END AS manual_item_id,
          CASE WHEN event_type = 'purchase' AND user_id % 7 <> 0 THEN 'P' || cast(user_id as string) END AS portfolio_key,
          CASE WHEN event_type IN ('view', 'error') THEN 'liability' ELSE 'asset' END AS kind,
          CASE event_type WHEN 'click' THEN 'bank_balance' WHEN 'view' THEN 'cc_outstanding' WHEN 'purchase' THEN 'investment' WHEN 'signup' THEN 'manual_asset' ELSE 'manual_liability' END AS category,
          cast(ts as date) - cast(event_id % 400 as int) AS as_of_date, cast(value as decimal(16, 2)) AS value,
          CASE event_id % 13 WHEN 0 THEN 'USD' ELSE 'INR' END AS currency
        FROM {events}""",
    "cas_uploads": """
        SELECT event_id AS id, 'P' || cast(user_id as string) AS portfolio_key, cast(ts as date) AS statement_date, event_id % 5 <> 0 AS portfolio_ok,
          CASE WHEN user_id % 3 = 0 THEN 'Investor ' || cast(user_id as string) END AS investor_name
        FROM {events} WHERE event_type = 'purchase'""",
    "manual_items": """
        SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 9 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS active FROM {supplier}""",
    "snapshot_holdings": """
        SELECT event_id * 10 + 1 AS id, event_id AS snapshot_id, CASE user_id % 3 WHEN 0 THEN 'equity' WHEN 1 THEN 'debt' ELSE 'gold' END AS asset_class,
          'Holding ' || cast(user_id % 11 as string) AS label, cast(value as decimal(16, 2)) AS value
        FROM {events} WHERE event_type = 'purchase'
        UNION ALL
        SELECT event_id * 10 + 2, event_id, 'cash', 'Sweep', cast(value as decimal(16, 2)) + 1 FROM {events} WHERE event_type = 'purchase'""",
    "statement_uploads": f"""
        SELECT o_orderkey AS id, o_custkey AS account_id, {_BANK.format('c_nationkey')} AS bank,
          CASE WHEN o_orderkey % 23 = 0 THEN 'soon' WHEN o_orderkey % 29 = 0 THEN NULL ELSE {_DMY.format('cast(o_orderdate as date)')} END AS due_date,
          CASE WHEN o_orderkey % 19 = 0 THEN 'N/A' ELSE {_MONEY_TEXT.format("cast(round(o_totalprice * 100) as bigint)")} END AS total_amount_due,
          CASE o_orderkey % 5 WHEN 0 THEN 'paid' WHEN 1 THEN 'partially_paid' WHEN 2 THEN 'unpaid' WHEN 3 THEN 'late' END AS payment_status,
          CASE WHEN o_orderkey % 5 = 1 THEN cast(round(o_totalprice / 3, 2) as decimal(12, 2)) END AS payment_paid_amount,
          cast(o_orderdate as date) - 20 AS created_on
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'""",
    "bank_statement_rows": """
        SELECT id AS stmt_idx, account_id, direction, transaction_date + CASE id % 4 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS date,
          CASE WHEN id % 33 = 0 THEN amount + 10 ELSE amount END AS amount, CASE WHEN id % 2 = 0 THEN reference_number END AS reference_number, balance,
          raw_description AS narration
        FROM {transactions} WHERE account_id IS NOT NULL AND transaction_date IS NOT NULL AND id % 3 <> 2""",
    "fx_rates": """
        SELECT * FROM (VALUES ('USD', DATE '1996-01-01', cast(34.5 as decimal(18, 4))), ('USD', DATE '1998-06-15', cast(41.25 as decimal(18, 4))),
          ('USD', DATE '2000-03-01', cast(43.6125 as decimal(18, 4))), ('EUR', DATE '1999-01-04', cast(49.9 as decimal(18, 4)))) AS t(currency, date, rate)""",
    "merchant_rules": """
        SELECT * FROM (VALUES (1, 'payroll', 'salary', true, 100), (2, 'swiggy', 'dining', true, 100), (3, 'zomato order', 'dining', true, 100), (4, 'zomato', 'groceries', true, 100),
          (5, 'zerodha', 'investment', true, 50), (6, 'cc payment', 'credit_card_payment', true, 100), (7, 'amazon', 'shopping', true, 100), (8, 'ravi', 'rent', false, 1), (9, ' ', 'misc', true, 1))
          AS t(id, pattern, category, active, priority)""",
    "raw_lots": """
        SELECT l_orderkey * 100 + l_partkey % 100 AS raw_id, l_suppkey AS upload_id, CASE WHEN l_linenumber = 7 THEN 'demat' ELSE 'MF' END AS scope,
          CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'inf' || lpad(cast(l_partkey % 300 as string), 6, '0') END AS isin, 'F' || cast(l_suppkey % 10 as string) AS source_ref,
          CASE l_returnflag WHEN 'R' THEN 'Redemption' WHEN 'A' THEN 'SIP Purchase' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'Switch_In' WHEN 1 THEN 'Dividend' END END AS transaction_type,
          CASE WHEN l_partkey % 5 = 0 THEN 'R' || cast(l_orderkey % 100 as string) END AS reference,
          cast(l_shipdate as date) AS acquired_on, cast(CASE WHEN l_quantity < 3 THEN 0 ELSE l_quantity END as decimal(20, 6)) AS units,
          cast(10 + l_partkey % 300 as decimal(20, 6)) AS nav,
          cast(CASE WHEN l_quantity < 3 THEN 0 ELSE l_quantity END as decimal(20, 2)) * cast(10 + l_partkey % 300 as decimal(18, 2)) + cast(CASE WHEN l_orderkey % 20 = 0 THEN 0.5 ELSE 0 END as decimal(18, 2)) AS amount
        FROM {lineitem}""",
    "sms_messages": """
        SELECT conv_id * 1000 + turn AS id, 'VM-' || upper(role) AS sender, text AS body, conv_id AS arrival FROM {conversations}
        UNION ALL
        SELECT conv_id * 1000 + turn + 500, 'VM-' || upper(role), text, conv_id + 1 FROM {conversations} WHERE conv_id % 3 = 0""",
    "fetch_rules": """
        SELECT * FROM (VALUES (1, 'alerts@hdfc.test', 'spent', 'hdfc', true), (2, 'icici', '', 'icici', false), (3, '', 'statement', 'kotak', true)) AS t(id, sender, subject, bank, enabled)""",
    "emails": """
        SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 4 + 1 END AS rule_id,
          CASE event_id % 4 WHEN 0 THEN 'HDFC <Alerts@HDFC.test>' WHEN 1 THEN 'noreply@icici.test' WHEN 2 THEN 'x-alerts@hdfc.test' END AS sender,
          CASE event_id % 3 WHEN 0 THEN 'Rs 5 spent' WHEN 1 THEN 'Your Statement for May' END AS subject, ts AS received_at,
          CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'parsed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'pending' ELSE 'enriched' END AS status,
          CASE WHEN event_id % 10 = 0 THEN 'no parser matched ' || cast(user_id as string) END AS error, props AS body
        FROM {events}""",
    "txn_links": """
        SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE (id * 7) % 800 END AS email_id, account_id, bank, direction, amount, transaction_date FROM {transactions}""",
    "sms_rows": """
        SELECT id, sender, body, arrival, CASE id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'pending' WHEN 2 THEN 'error' ELSE 'skipped' END AS status,
          CASE WHEN id % 3 = 0 THEN id % 700 END AS transaction_id, CASE id % 7 WHEN 0 THEN 'provisional' WHEN 1 THEN 'restatement' END AS ledger_role,
          CASE id % 5 WHEN 0 THEN 'declined' WHEN 1 THEN 'credit' WHEN 2 THEN 'credit' ELSE 'debit' END AS direction
        FROM {sms_messages}""",
    "settings": """
        SELECT CASE c_custkey % 7 WHEN 0 THEN 'poll.minutes.' WHEN 1 THEN 'poll.enabled.' WHEN 2 THEN 'poll.names.' ELSE 'llm.' END || cast(c_custkey as string) AS key,
          CASE c_custkey % 7 WHEN 0 THEN ' ' || cast(c_custkey as string) || ' ' WHEN 1 THEN 'Yes' WHEN 2 THEN '[' || cast(c_custkey as string) || ', 2]' WHEN 3 THEN 'many' WHEN 4 THEN 'off' WHEN 5 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS value
        FROM {customer}""",
    "known_cards": """
        SELECT * FROM {cards} WHERE id % 3 <> 0""",
    "bank_uploads": """
        SELECT o_orderkey AS id, o_custkey AS account_id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE cast(round(o_totalprice) as bigint) div 1000 || ',' || lpad(cast(cast(round(o_totalprice) as bigint) % 1000 as string), 3, '0') || '.50' END AS closing_balance,
          CASE WHEN o_orderkey % 11 = 0 THEN 'soon' WHEN o_orderkey % 13 <> 0 THEN lpad(cast(day(cast(o_orderdate as date)) as string), 2, '0') || '/' || lpad(cast(month(cast(o_orderdate as date)) as string), 2, '0') || '/' || cast(year(cast(o_orderdate as date)) as string) END AS period_end,
          CASE WHEN o_orderkey % 3 = 0 THEN repeat('x', cast(o_orderkey % 50 as int)) END AS payload
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment IN ('HOUSEHOLD', 'BUILDING')""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents"]


class FinanceTables:
    """The adapter's views over the Parquet tables of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                used = {t: self[t] for t in [*TABLES, *VIEWS] if "{" + t + "}" in sql}
                self._made[name] = self.spark.sql(sql, **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sorted_with(self, name: str) -> FinanceTables:
        """The same tables, of which this one is joined by sorting however small its files look, and never comes whole to the driver
        (a table of few columns in well packed files is a multiple of them there)."""
        out = FinanceTables(self.spark, self.sf_dir)
        out._made[name] = self[name].hint("merge")
        return out


def oracle(sql: str) -> str:
    """``sql`` for DuckDB with the views it names (directly or through others) in front."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    body = lambda n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]).replace(" div ", " // ")
    return "WITH " + ", ".join(f"{n} AS ({body(n)})" for n in need) + " " + sql if need else sql
