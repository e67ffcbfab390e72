"""Registered queries over the relations between tables: details, dangling keys, filters of other lists, rows beyond a statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import investments, listing, statements
from tallyspark.plans.catalogue import _CAND, _query


@_query("""SELECT t.id, e.status AS email_status, a.label AS account_label, s.sms_status FROM transactions t JOIN txn_links l ON l.id = t.id LEFT JOIN emails e ON e.id = l.email_id LEFT JOIN accounts a ON a.id = t.account_id LEFT JOIN (SELECT transaction_id, min(status) AS sms_status FROM sms_rows WHERE transaction_id IS NOT NULL GROUP BY 1) s ON s.transaction_id = t.id""")
def txn_sources(t):
    linked = t["transactions"].join(t["txn_links"].select(F.col("id").alias("_l"), "email_id"), F.col("id") == F.col("_l")).drop("_l")
    return listing.with_sources(linked, t["emails"], t["accounts"], t["sms_rows"]).select("id", "email_status", "account_label", "sms_status")


_KEYS = [("txn_links", "email_id", "emails"), ("transactions", "account_id", "accounts"), ("cards", "account_id", "accounts"), ("sms_rows", "transaction_id", "transactions"), ("emails", "rule_id", "fetch_rules"), ("bank_uploads", "account_id", "accounts"), ("balance_snapshots", "account_id", "accounts"), ("raw_lots", "upload_id", "cas_uploads")]


@_query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS relation, count(*) AS violations, count(*) > 40 AS beyond_limit FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT id FROM {p})" for c, k, p in _KEYS))
def dangling_keys(t):
    return listing.dangling([(t[c], k, t[p], f"{c}.{k}") for c, k, p in _KEYS], 40)


@_query("SELECT 'sms' AS list, id FROM sms_rows WHERE status = 'parsed' AND transaction_id = 9 UNION ALL SELECT 'account', id FROM accounts WHERE bank = 'hdfc' AND type = 'bank_account' UNION ALL SELECT 'rule', id FROM fetch_rules WHERE bank = 'icici' AND NOT enabled UNION ALL SELECT 'statement', id FROM statement_uploads WHERE bank = 'kotak' AND payment_status = 'paid'")
def list_filters(t):
    kept = lambda name, table, **f: listing.exact_filters(t[table], **f).select(F.lit(name).alias("list"), F.col("id").cast("bigint").alias("id"))
    return kept("sms", "sms_rows", status="parsed", transaction_id=9).unionByName(kept("account", "accounts", bank=" HDFC ", type="bank_account")).unionByName(kept("rule", "fetch_rules", bank="icici", enabled=False)).unionByName(kept("statement", "statement_uploads", bank="kotak", payment_status="paid", account_id=listing.whole("x1")))


@_query(f"""SELECT t.id, t.account_id FROM transactions t JOIN (SELECT account_id, min(date) AS lo, max(date) AS hi FROM bank_statement_rows GROUP BY 1) s ON s.account_id = t.account_id AND t.transaction_date BETWEEN lo AND hi WHERE t.id NOT IN (SELECT id FROM ({_CAND}))
    AND NOT EXISTS (SELECT 1 FROM bank_statement_rows r WHERE r.stmt_idx % 4 = 0 AND r.account_id = t.account_id AND r.amount = t.amount AND abs(date_diff('day', r.date, t.transaction_date)) <= 1)""")
def certain_extra(t):
    return statements.certain_extra(t["bank_statement_rows"].withColumn("uncertain", F.col("stmt_idx") % 4 == 0), t["transactions"])


@_query()
def portfolio_disposals(t):
    own = t["cas_uploads"].select(F.pmod("id", F.lit(10)).alias("id"), "portfolio_key").groupBy("id").agg(F.min("portfolio_key").alias("portfolio_key"))
    return investments.disposals_by_portfolio(investments.classify(t["raw_lots"]), own)
