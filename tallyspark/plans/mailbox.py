"""Registered queries over e-mails, text messages, settings and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.functions import formatting, periods
from tallyspark.operators import listing, mailbox
from tallyspark.plans.catalogue import _paise, _query
from tallyspark.sources import messages

_TODAY = "DATE '2024-05-20'"


@_query("SELECT DISTINCT transaction_date AS d, date_trunc('quarter', transaction_date)::DATE AS quarter, (date_trunc('month', transaction_date) - INTERVAL 2 MONTH)::DATE AS first_of_three FROM transactions WHERE transaction_date IS NOT NULL")
def quarters(t):
    d = F.col("transaction_date")
    return t["transactions"].where(d.isNotNull()).select(d.alias("d")).distinct().select("d", periods.quarter_start(F.col("d")).alias("quarter"), F.element_at(periods.trailing_month_starts(F.col("d"), 3), 1).alias("first_of_three"))


@_query("""SELECT d, label, date_from, date_to FROM (SELECT DISTINCT transaction_date AS d, date_trunc('month', transaction_date)::DATE AS m, date_trunc('quarter', transaction_date)::DATE AS q FROM transactions WHERE transaction_date IS NOT NULL),
    LATERAL (VALUES ('This month', m, d), ('Last month', (m - INTERVAL 1 MONTH)::DATE, m - 1), ('This quarter', q, d), ('Last quarter', (q - INTERVAL 3 MONTH)::DATE, q - 1), ('Financial year', make_date(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END, 4, 1), d), ('Calendar year', make_date(year(d), 1, 1), d)) AS v(label, date_from, date_to)""")
def date_presets(t):
    days = t["transactions"].where("transaction_date is not null").select(F.col("transaction_date").alias("d")).distinct()
    return days.select("d", F.explode(periods.presets(F.col("d"))).alias("p")).select("d", "p.label", "p.date_from", "p.date_to")


@_query(f"""SELECT id, CASE id % 3 WHEN 0 THEN coalesce(transaction_date, DATE '2024-05-01') ELSE DATE '2024-05-01' END AS date_from, CASE id % 4 WHEN 0 THEN coalesce(transaction_date, {_TODAY}) ELSE {_TODAY} END AS date_to FROM transactions""")
def lenient_ranges(t):
    iso = F.col("transaction_date").cast("string")
    a = F.when(F.col("id") % 3 == 0, iso).when(F.col("id") % 3 == 1, "2024-02-31")
    b = F.when(F.col("id") % 4 == 0, iso).when(F.col("id") % 4 == 1, "yesterday").when(F.col("id") % 4 == 2, "")
    return t["transactions"].select("id", *periods.resolved_bounds(a, b, F.lit("2024-05-20").cast("date")))


@_query("SELECT id, received_at FROM emails WHERE received_at >= TIMESTAMP '2024-01-05' AND received_at < TIMESTAMP '2024-01-10'")
def emails_between(t):
    return t["emails"].where(periods.within_days(F.col("received_at"), "2024-01-05", "2024-01-09")).select("id", "received_at")


@_query("SELECT id, CASE coalesce(upper(trim(currency)), '') WHEN '' THEN '₹' WHEN 'INR' THEN '₹' WHEN 'USD' THEN '$' ELSE upper(trim(currency)) || ' ' END AS sign FROM transactions")
def currency_signs(t):
    return t["transactions"].select("id", periods.currency_sign(F.col("currency")).alias("sign"))


@_query("""SELECT id, '₹' || CASE WHEN abs(v) >= 10000000 THEN regexp_replace(CASE WHEN abs(v) >= 100000000 THEN format('{:.1f}', v / 10000000) ELSE format('{:.2f}', v / 10000000) END, '\\.?0+$', '') || 'Cr' WHEN abs(v) >= 100000 THEN regexp_replace(CASE WHEN abs(v) >= 1000000 THEN format('{:.1f}', v / 100000) ELSE format('{:.2f}', v / 100000) END, '\\.?0+$', '') || 'L'
    WHEN abs(v) >= 1000 THEN regexp_replace(CASE WHEN abs(v) >= 10000 THEN format('{:.1f}', v / 1000) ELSE format('{:.2f}', v / 1000) END, '\\.?0+$', '') || 'K' ELSE format('{:,.2f}', v) END AS compact
    FROM (SELECT id, cast(CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN id * 1.25 WHEN 2 THEN -(id * 1000.5) ELSE id * 100000.5 END AS DOUBLE) AS v FROM transactions)""")
def compact_amounts(t):
    i = F.col("id")
    value = F.when(i % 4 == 0, F.lit(0.0)).when(i % 4 == 1, i * F.lit(1.25)).when(i % 4 == 2, -(i * F.lit(1000.5))).otherwise(i * F.lit(100000.5))
    return t["transactions"].select("id", formatting.compact_amount(value.cast("double")).alias("compact"))


@_query("SELECT id, rule_id, status, received_at, substr(error, 1, 20) AS error, coalesce(length(error) > 20, false) AS error_truncated FROM emails")
def email_summaries(t):
    return mailbox.summaries(t["emails"], 20)


@_query("SELECT e.id, r.bank AS rule_bank FROM emails e LEFT JOIN fetch_rules r ON r.id = e.rule_id")
def emails_with_rules(t):
    return mailbox.with_rules(t["emails"], t["fetch_rules"]).select("id", "rule_bank")


@_query("SELECT e.id FROM emails e JOIN fetch_rules r ON r.id = e.rule_id WHERE r.bank = 'icici'")
def emails_of_bank(t):
    return mailbox.with_rules(t["emails"], t["fetch_rules"], "icici").select("id")


@_query(f"SELECT s.id, s.transaction_id, t.bank AS txn_bank, {_paise('t.amount')} AS txn_paise, count(*) AS n FROM sms_rows s LEFT JOIN transactions t ON t.id = s.transaction_id GROUP BY 1, 2, 3, t.amount")
def sms_with_transactions(t):
    j = mailbox.with_transactions(t["sms_rows"], t["transactions"])
    return j.groupBy("id", "transaction_id", "txn_bank", "txn_amount").agg(F.count(F.lit(1)).cast("bigint").alias("n")).select("id", "transaction_id", "txn_bank", X.paise(F.col("txn_amount")).alias("txn_paise"), "n")


@_query("SELECT id FROM emails e WHERE EXISTS (SELECT 1 FROM txn_links l WHERE l.email_id = e.id AND l.direction = 'credit' AND l.amount > 100000)")
def emails_with_large_credits(t):
    return mailbox.having_transaction(t["emails"], t["txn_links"], (F.col("direction") == "credit") & (F.col("amount") > 100000)).select("id")


@_query("SELECT email_id, array_to_string(list(id ORDER BY id)[1:3], ',') AS ids, count(*) > 3 AS truncated FROM txn_links WHERE email_id IS NOT NULL GROUP BY 1")
def email_links(t):
    return mailbox.first_links(t["txn_links"], 3).select("email_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "truncated")


@_query("SELECT sender, body, arrival, id, CASE WHEN row_number() OVER (PARTITION BY sender, body, arrival ORDER BY id) = 1 THEN 201 ELSE 204 END::BIGINT AS code FROM (SELECT DISTINCT id, sender, body, arrival FROM sms_rows)")
def sms_codes(t):
    return mailbox.stored_once(t["sms_rows"].select("id", "sender", "body", "arrival").distinct(), ["sender", "body", "arrival"], "id")


@_query("""SELECT status, outcome, next_status, count(*) AS n FROM (SELECT *, CASE WHEN status NOT IN ('pending', 'failed') THEN status WHEN err THEN 'failed' WHEN id % 11 = 0 THEN 'skipped' WHEN outcome = 'merge' AND id % 2 = 0 THEN 'enriched' ELSE 'parsed' END AS next_status FROM (
    SELECT id, CASE WHEN status = 'error' THEN 'failed' ELSE status END AS status, id % 13 = 0 AS err, CASE WHEN ledger_role IN ('provisional', 'restatement') AND direction = 'credit' AND NOT (id % 2 = 1 AND ledger_role = 'provisional') THEN 'notify_only' WHEN direction = 'declined' THEN 'declined' ELSE 'merge' END AS outcome FROM sms_rows)) GROUP BY 1, 2, 3""")
def message_states(t):
    i = F.col("id")
    rows = t["sms_rows"].withColumn("status", F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))).withColumn("outcome", mailbox.message_outcome(F.col("ledger_role"), F.col("direction"), i % 2 == 1))
    moved = mailbox.next_status(F.col("status"), i % 11 != 0, i % 2 == 0, F.col("outcome"), F.when(i % 13 == 0, F.lit("bad")))
    return rows.withColumn("next_status", moved).groupBy("status", "outcome", "next_status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@_query("SELECT e.id, r.bank AS rule_bank, CASE WHEN r.bank IS NULL THEN 'no_rule' ELSE 'reparse' END AS action FROM emails e LEFT JOIN fetch_rules r ON r.id = e.rule_id WHERE e.status = 'failed'")
def failed_emails(t):
    return mailbox.failed_again(t["emails"], t["fetch_rules"])


@_query("SELECT (SELECT count(*) FROM emails) AS emails, (SELECT count(*) FROM emails WHERE status = 'failed') AS failed_emails, (SELECT count(*) FROM sms_rows WHERE status IN ('pending', 'error')) AS open_messages, (SELECT count(*) FROM fetch_rules WHERE enabled) AS enabled_rules")
def mailbox_counters(t):
    return mailbox.counters(t["emails"], t["sms_rows"], t["fetch_rules"])


@_query("""SELECT e.id AS email_id, r.id AS rule_id FROM (SELECT id, lower(coalesce(sender, '')) AS s, lower(coalesce(subject, '')) AS j FROM emails) e, fetch_rules r WHERE CASE WHEN trim(r.sender) = '' THEN true WHEN regexp_matches(lower(trim(r.sender)), '^[^@ ]+@[^@ ]+$') THEN trim(CASE WHEN contains(s, '<') THEN regexp_extract(s, '<([^<>]*)>', 1) ELSE s END) = lower(trim(r.sender)) ELSE contains(s, lower(trim(r.sender))) END AND contains(j, lower(trim(r.subject)))""")
def email_rules(t):
    return mailbox.rule_of_sender(t["emails"], t["fetch_rules"])


@_query("SELECT id, arrival, CASE WHEN count(*) OVER (PARTITION BY arrival) > 5 THEN 'summary' ELSE 'single' END AS announce FROM sms_rows WHERE status = 'parsed'")
def booked_announcements(t):
    return mailbox.announcements(t["sms_rows"].where("status = 'parsed'").select("id", "arrival"), "arrival")


@_query("SELECT id, CASE WHEN last IS NULL THEN DATE '2024-05-20' - 90 ELSE last - 2 END AS since FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '2024-01-01' + cast(s_suppkey % 100 AS INTEGER) END AS last FROM supplier)")
def fetch_since(t):
    last = F.when(F.col("s_suppkey") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 100).cast("int")))
    return t["supplier"].select(F.col("s_suppkey").alias("id"), messages.since(last, today=F.lit("2024-05-20").cast("date")).alias("since"))


@_query("""SELECT key, trim(value) AS text, try_cast(trim(value) AS BIGINT) AS number, CASE WHEN lower(trim(value)) IN ('1', 'true', 'yes', 'on') THEN true WHEN value IS NOT NULL THEN false END AS flag, CASE WHEN value LIKE '[%' THEN 2 END::BIGINT AS items FROM settings""")
def typed_settings(t):
    s = messages.typed_settings(t["settings"])
    return s.select("key", "text", "number", "flag", F.when(F.col("items").isNotNull(), F.size("items")).cast("bigint").alias("items"))


@_query("SELECT c_custkey AS id, 'u' || c_custkey || '@bank.test' AS sender, 'Statement ' || c_custkey AS subject, 'statement.pdf' AS pdf, TIMESTAMP '2024-05-20 04:30:00' AS received_at, 'Dear customer' AS body FROM customer")
def mail_fields(t):
    m = messages.parsed_mail(_mails(t))
    return m.select(F.regexp_extract("path", r"(\d+)\.eml", 1).cast("bigint").alias("id"), "sender", "subject", messages.statement_attachment(F.col("attachments"), ["terms"]).alias("pdf"), F.col("received_at").cast("timestamp_ntz").alias("received_at"), F.trim(F.regexp_replace("body", r"[\r\n]+", "")).alias("body"))


def _mails(t):
    """A mail with two attachments for every customer, under a character set that nobody knows for every third."""
    eol = "\r\n"
    k = F.col("c_custkey").cast("string")
    head = F.concat(F.lit("From: u"), k, F.lit(f"@bank.test{eol}Subject: Statement "), k, F.lit(f"{eol}Message-ID: <m"), k, F.lit(f"@x>{eol}Date: Mon, 20 May 2024 10:00:00 +0530{eol}MIME-Version: 1.0{eol}Content-Type: multipart/mixed; boundary=cut{eol}{eol}"))
    part = lambda name: f"--cut{eol}Content-Type: application/pdf; name={name}{eol}Content-Disposition: attachment; filename={name}{eol}{eol}"
    charset = F.when(F.col("c_custkey") % 3 == 0, "; charset=x-of-old").otherwise("")
    raw = F.concat(head, F.lit(f"--cut{eol}Content-Type: text/plain"), charset, F.lit(f"{eol}{eol}Dear customer{eol}" + part("Terms_and_Conditions.pdf") + f"x{eol}" + part("statement.pdf") + "balance of "), k, F.lit(f"{eol}--cut--{eol}"))
    return t["customer"].select(F.concat(F.lit("data/hdfc/"), k, F.lit(".eml")).alias("path"), F.encode(raw, "utf-8").alias("content"))


@_query("SELECT c_custkey AS id, cast(part AS INTEGER) AS part, name, 'application/pdf' AS content_type, cast(length(body) AS BIGINT) AS size, sha256(body) AS sha FROM (SELECT c_custkey, 0 AS part, 'Terms_and_Conditions.pdf' AS name, 'x' AS body FROM customer UNION ALL SELECT c_custkey, 1, 'statement.pdf', 'balance of ' || c_custkey FROM customer)")
def mail_attachments(t):
    m = messages.mail_attachments(_mails(t))
    return m.select(F.regexp_extract("path", r"(\d+)\.eml", 1).cast("bigint").alias("id"), "part", "name", "content_type", "size", F.sha2("content", 256).alias("sha"))


@_query("SELECT count(*) AS total FROM transactions WHERE bank = 'icici' AND direction = 'debit'")
def filtered_count(t):
    return listing.counted(listing.filtered(t["transactions"], bank="icici", direction="debit"))


@_query("SELECT id, (SELECT count(*) FROM transactions WHERE source = 'sms') AS total FROM transactions WHERE source = 'sms' ORDER BY id DESC LIMIT 20 OFFSET 40")
def stable_page(t):
    return listing.page_by_id(t["transactions"].where("source = 'sms'"), 20, 40).select("id", "total")
