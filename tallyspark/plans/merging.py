"""Registered queries of the merge driver: paths, enrichment, application, claims and explicit choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import batches, matching
from tallyspark.plans.catalogue import _AT, _CP, _CPM, _FUZZY, _SAT, _USABLE, _fits, _mask, _query

_TYPES = ["bank_transfer", "upi_alert", "bank_cc_debit"]
_IN = "('bank_transfer', 'upi_alert', 'bank_cc_debit')"
#: Messages read in the other half of the day, beside the adapter's.
_TURNED = f"""SELECT seq, bank, direction, amount, currency, CASE WHEN turned THEN CASE WHEN t < 43200 AND seq % 2 = 0 THEN transaction_date ELSE transaction_date END ELSE transaction_date END AS transaction_date,
    CASE WHEN turned THEN (t + 43200) % 86400 ELSE t END AS transaction_time_s, received_time, CASE WHEN turned THEN own ELSE counterparty END AS counterparty, account_mask, CASE WHEN NOT turned THEN reference_number END AS reference_number, balance, by_email FROM (
    SELECT i.*, i.seq % 10 = 5 AS turned, s.transaction_time_s AS t0, CASE WHEN i.seq % 10 = 5 THEN s.transaction_time_s ELSE i.transaction_time_s END AS t, s.counterparty AS own FROM incoming i JOIN transactions s ON s.id = i.seq)"""


def _turned(t):
    own = t["transactions"].select(F.col("id").alias("_i"), F.col("transaction_time_s").alias("_t"), F.col("counterparty").alias("_c"))
    turned = F.col("seq") % 10 == 5
    j = t["incoming"].join(own, F.col("seq") == F.col("_i"))
    return j.withColumn("transaction_time_s", F.when(turned, (F.col("_t") + 43200) % 86400).otherwise(F.col("transaction_time_s"))).withColumn("counterparty", F.when(turned, F.col("_c")).otherwise(F.col("counterparty"))).withColumn(
        "reference_number", F.when(~turned, F.col("reference_number"))).drop("_i", "_t", "_c")


_HALF = f"""SELECT seq, max(id) AS id, bool_or(coalesce(bal_in <> bal, false)) AS balance_off FROM (SELECT i.seq, s.id, i.balance AS bal_in, s.balance AS bal FROM tin i JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND s.amount = i.amount AND coalesce(s.currency, 'INR') = coalesce(i.currency, 'INR') AND s.email_type IN {_IN}
    AND CASE WHEN i.transaction_time_s >= 43200 THEN s.transaction_time_s // 3600 BETWEEN 1 AND 11 ELSE s.transaction_time_s // 3600 = 12 END AND abs({_AT} + CASE WHEN i.transaction_time_s >= 43200 THEN -43200 ELSE 43200 END - {_SAT}) <= 600 AND {_CPM}) GROUP BY 1 HAVING count(*) = 1"""
_NEAR = _FUZZY.replace("FROM incoming i", "FROM tin i")
_DEC = f"""SELECT seq, CASE WHEN n = 0 THEN 'insert' WHEN sure IS NOT NULL THEN 'match' ELSE 'defer' END AS action, sure AS id, CASE WHEN n > 0 AND sure IS NULL THEN CASE WHEN NOT known AND n > 1 THEN 'multiple_candidates' ELSE 'balance_ambiguous' END END AS reason
    FROM (SELECT i.seq, count(c.id) AS n, bool_or(c.bal_in IS NOT NULL) AS known, CASE WHEN bool_or(c.bal_in IS NOT NULL) THEN CASE WHEN count(CASE WHEN c.bal IS NOT NULL THEN 1 END) = 1 THEN max(CASE WHEN c.bal IS NOT NULL THEN c.id END) END
      WHEN count(c.id) = 1 AND count(CASE WHEN c.bal IS NULL AND c.id IS NOT NULL THEN 1 END) = 1 THEN max(c.id) END AS sure FROM tin i LEFT JOIN (SELECT * FROM ({_NEAR}) WHERE bal_in IS NULL OR bal IS NULL OR bal = bal_in) c ON c.seq = i.seq GROUP BY i.seq)"""
_REF = """SELECT i.seq, CASE WHEN count(*) > 1 THEN 'multiple_candidates' WHEN bool_or(i.amount <> s.amount) THEN 'reference_amount_mismatch' WHEN bool_or(coalesce(i.balance <> s.balance, false)) THEN 'reference_balance_mismatch' END AS reason, max(s.id) AS id FROM tin i JOIN transactions s ON s.bank = i.bank AND s.direction = i.direction AND trim(s.reference_number) = trim(i.reference_number) AND trim(i.reference_number) <> '' GROUP BY i.seq"""
_ALL = f"""SELECT seq, path, CASE path WHEN 'reference' THEN CASE WHEN rr IS NULL THEN 'match' ELSE 'defer' END WHEN 'fuzzy' THEN fa WHEN 'other_half' THEN CASE WHEN off THEN 'insert' ELSE 'match' END ELSE 'insert' END AS action,
    CASE path WHEN 'reference' THEN CASE WHEN rr IS NULL THEN ri END WHEN 'fuzzy' THEN fi WHEN 'other_half' THEN CASE WHEN NOT off THEN hi END END AS id, CASE path WHEN 'reference' THEN rr WHEN 'fuzzy' THEN fr WHEN 'other_half' THEN CASE WHEN off THEN 'alias_balance_mismatch' END END AS reason
    FROM (SELECT i.seq, CASE WHEN r.seq IS NOT NULL THEN 'reference' WHEN i.seq IN (SELECT seq FROM ({_NEAR})) THEN 'fuzzy' WHEN h.seq IS NOT NULL THEN 'other_half' ELSE 'none' END AS path, r.reason AS rr, r.id AS ri, f.action AS fa, f.id AS fi, f.reason AS fr, h.id AS hi, h.balance_off AS off
      FROM tin i LEFT JOIN ({_REF}) r ON r.seq = i.seq LEFT JOIN ({_DEC}) f ON f.seq = i.seq LEFT JOIN ({_HALF}) h ON h.seq = i.seq)"""


def _with_tin(sql: str) -> str:
    return f"SELECT * FROM (WITH tin AS ({_TURNED}) {sql})"


@_query(_with_tin(_HALF))
def other_half_matches(t):
    return matching.other_half(_turned(t), t["transactions"], _TYPES)


@_query(_with_tin(_ALL))
def message_decisions(t):
    return matching.find_matches(_turned(t), t["transactions"], _TYPES)


_OLDNEW = [("counterparty", "{0}"), ("account_mask", "{0}"), ("reference_number", "{0}"), ("balance", "{0}"), ("transaction_date", "{0}"), ("transaction_time_s", "{0}")]
_NCP = lambda c: _CP.format(c)
_DG = lambda c: f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
_KEEP = {
    "counterparty": f"NOT ({_NCP('i.counterparty')} <> '' AND contains({_NCP('s.counterparty')}, {_NCP('i.counterparty')}) AND {_NCP('s.counterparty')} <> {_NCP('i.counterparty')})",
    "account_mask": f"{_DG('s.account_mask')} <> {_DG('i.account_mask')} AND NOT (length({_DG('i.account_mask')}) < length({_DG('s.account_mask')}) AND ends_with({_DG('s.account_mask')}, {_DG('i.account_mask')}))",
    "reference_number": "true", "balance": "true", "transaction_date": "i.transaction_date < s.transaction_date",
    "transaction_time_s": "epoch(coalesce(i.transaction_date, s.transaction_date)) + i.transaction_time_s < epoch(coalesce(s.transaction_date, i.transaction_date)) + s.transaction_time_s",
}
_CHG = " UNION ALL ".join(
    f"SELECT m.seq, m.id, '{f}' AS field, CASE WHEN s.{f} IS NULL THEN 'filled' ELSE 'overwritten' END AS kind, cast(s.{f} AS VARCHAR) AS old, cast(i.{f} AS VARCHAR) AS new FROM m JOIN tin i ON i.seq = m.seq JOIN transactions s ON s.id = m.id WHERE i.{f} IS NOT NULL AND (s.{f} IS NULL OR (i.by_email AND s.{f} <> i.{f} AND {_KEEP[f]}))"
    for f, _ in _OLDNEW)
_CHANGES = f"WITH tin AS ({_TURNED}), m AS (SELECT seq, id FROM ({_ALL}) WHERE action = 'match') {_CHG}"


def _changed(t):
    i, s = _turned(t), t["transactions"]
    return i, s, matching.changes(i, s, matching.find_matches(i, s, _TYPES))


@_query(f"SELECT * FROM ({_CHANGES})")
def message_changes(t):
    return _changed(t)[2]


@_query(f"""SELECT t.id, coalesce(c.counterparty, t.counterparty) AS counterparty, coalesce(c.mask, t.account_mask) AS account_mask, coalesce(c.time_s, t.transaction_time_s) AS transaction_time_s, CASE WHEN c.id IS NOT NULL THEN 'sms+email' ELSE t.source END AS source, c.id IS NOT NULL AS enriched FROM transactions t
    LEFT JOIN (SELECT id, max(CASE WHEN field = 'counterparty' THEN new END) AS counterparty, max(CASE WHEN field = 'account_mask' THEN new END) AS mask, max(CASE WHEN field = 'transaction_time_s' THEN cast(new AS INTEGER) END) AS time_s FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY seq) AS r FROM ({_CHANGES})) WHERE r = 1 GROUP BY 1) c ON c.id = t.id""")
def enriched_transactions(t):
    i, s, c = _changed(t)
    return matching.applied(s, i, c).select("id", "counterparty", "account_mask", "transaction_time_s", "source", "enriched")


@_query(_with_tin(f"SELECT a.seq, a.id, CASE WHEN i.by_email THEN 'email' ELSE 'sms' END AS slot, row_number() OVER (PARTITION BY a.id, i.by_email ORDER BY a.seq) = 1 AS claimed FROM ({_ALL}) a JOIN tin i ON i.seq = a.seq WHERE a.action = 'match'"))
def slot_claims(t):
    i = _turned(t)
    return matching.slot_claims(matching.find_matches(i, t["transactions"], _TYPES), i)


@_query(f"""SELECT source, count(*) AS n, count(seq) AS fresh, cast(sum(amount) * 100 AS BIGINT) AS paise FROM (SELECT CASE WHEN t.id IN (SELECT id FROM ({_CHANGES})) THEN 'sms+email' ELSE t.source END AS source, NULL AS seq, amount FROM transactions t
    UNION ALL SELECT source, seq, amount FROM (SELECT CASE WHEN by_email THEN 'email' ELSE 'sms' END AS source, seq, amount, row_number() OVER (PARTITION BY bank, direction, nullif(trim(coalesce(reference_number, '')), ''), CASE WHEN trim(coalesce(reference_number, '')) = '' THEN seq END ORDER BY seq) AS r
      FROM (WITH tin AS ({_TURNED}) SELECT i.* FROM tin i JOIN ({_ALL}) a ON a.seq = i.seq WHERE a.action = 'insert')) WHERE r = 1) GROUP BY 1""")
def booked_batch(t):
    i, s = _turned(t), t["transactions"]
    out = matching.booked(i, s, matching.find_matches(i, s, _TYPES))
    return out.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count("seq").cast("bigint").alias("fresh"), (F.sum("amount") * 100).cast("bigint").alias("paise"))


_SHORT = "(least(length(x), length(y)) >= 4 AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x)))"
_BARE = lambda c: f"regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]', '', 'g')"


@_query(f"""SELECT * FROM (WITH tin AS ({_TURNED}), p AS (SELECT seq, seq AS id FROM tin UNION ALL SELECT seq, seq + 2 FROM tin WHERE seq + 2 IN (SELECT id FROM transactions)) SELECT seq, id, coalesce(fine AND (auto OR {_SHORT}), false) AS qualifies FROM (SELECT p.seq, p.id, (p.seq, p.id) IN (SELECT seq, id FROM ({_NEAR})) AS auto, {_BARE('s.reference_number')} AS x, {_BARE('i.reference_number')} AS y,
    s.bank IS NOT DISTINCT FROM i.bank AND s.direction = i.direction AND s.amount = i.amount AND coalesce(nullif(upper(trim(s.currency)), ''), 'INR') = coalesce(nullif(upper(trim(i.currency)), ''), 'INR') AND coalesce(CASE WHEN s.transaction_time_s IS NOT NULL AND i.transaction_time_s IS NOT NULL THEN abs({_AT} - {_SAT}) <= 600 ELSE s.transaction_date = i.transaction_date END, false) AND NOT coalesce(s.balance <> i.balance, false) AS fine
    FROM p JOIN tin i ON i.seq = p.seq JOIN transactions s ON s.id = p.id))""")
def explicit_matches(t):
    i, s = _turned(t), t["transactions"]
    pairs = i.select("seq", F.col("seq").alias("id")).unionByName(i.select("seq", (F.col("seq") + 2).alias("id")))
    return matching.explicit_matches(pairs, i, s)


@_query("SELECT i.seq, s.id, sha256(concat_ws('|', cast(i.seq AS VARCHAR), cast(s.id AS VARCHAR), coalesce(cast(i.amount AS VARCHAR), '-'), coalesce(cast(i.balance AS VARCHAR), '-'), coalesce(i.reference_number, '-'), coalesce(cast(s.amount AS VARCHAR), '-'), coalesce(cast(s.balance AS VARCHAR), '-'), coalesce(s.source, '-'))) AS token FROM incoming i JOIN transactions s ON s.id = i.seq")
def preview_tokens(t):
    i = t["incoming"].withColumn("amount", F.col("amount").cast("decimal(13,2)")).withColumn("balance", F.col("balance").cast("decimal(13,2)"))
    return matching.preview_token(i, t["transactions"], i.select("seq", F.col("seq").alias("id")))


@_query("SELECT seq, first_seq FROM (SELECT seq, min(seq) OVER (PARTITION BY bank, direction, trim(reference_number), a) AS first_seq FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE amount END AS a, 'R' || seq % 40 AS reference_number FROM (SELECT * EXCLUDE (reference_number) FROM incoming))) WHERE seq <> first_seq")
def batch_repeats(t):
    i = t["incoming"].withColumn("amount", F.when(F.col("seq") % 2 == 0, F.lit(1)).otherwise(F.col("amount"))).withColumn("reference_number", F.concat(F.lit("R"), (F.col("seq") % 40).cast("string")))
    return matching.batch_repeats(i)


_BY = "CASE id % 3 WHEN 0 THEN 'card_mask' WHEN 1 THEN 'none' END"


@_query(f"""SELECT seq, id FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n, bool_or(cp) OVER (PARTITION BY seq) AS any_cp, bool_or(untimed) OVER (PARTITION BY seq) AS any_untimed, max(tier) OVER (PARTITION BY seq) AS best FROM (SELECT *, CASE WHEN cp THEN 3 WHEN by_card THEN 2 WHEN none THEN 1 ELSE 0 END AS tier FROM (
    SELECT i.seq, s.id, {_CPM} AS cp, true AS untimed, coalesce(s.who = 'card_mask' AND i.who = 'card_mask' AND {_USABLE.format(_mask('i.card_mask')).replace('>= 3', '> 0')} AND {_USABLE.format(_mask('s.card_mask')).replace('>= 3', '> 0')} AND {_fits(_mask('i.card_mask'), _mask('s.card_mask'))}, false) AS by_card, coalesce(s.who = 'none' AND i.who = 'none', false) AS none
    FROM (SELECT id AS seq, bank, direction, 1 AS amount, transaction_date, CASE WHEN id % 2 = 0 THEN counterparty END AS counterparty, card_mask, {_BY} AS who FROM transactions WHERE id % 5 = 0) i JOIN (SELECT *, {_BY} AS who FROM transactions) s ON s.bank = i.bank AND s.direction = i.direction AND s.transaction_date = i.transaction_date))) WHERE tier > 0 AND tier = best""")
def untimed_tiers(t):
    who = F.when(F.col("id") % 3 == 0, "card_mask").when(F.col("id") % 3 == 1, "none")
    stored = t["transactions"].withColumn("identifies_by", who).withColumn("amount", F.lit(1)).withColumn("currency", F.lit("INR")).withColumn("account_mask", F.lit(None).cast("string"))
    i = stored.where("id % 5 = 0").withColumn("transaction_time_s", F.lit(None).cast("int")).withColumn("counterparty", F.when(F.col("id") % 2 == 0, F.col("counterparty"))).withColumnRenamed("id", "seq")
    return matching.fuzzy_candidates(i.drop("email_type", "created_at"), stored, parts=True).select("seq", "id")


@_query(f"""SELECT * FROM (WITH tin AS (SELECT * FROM incoming) SELECT seq, id, CASE WHEN seq % 7 = 0 THEN 'stale' WHEN seq % 3 = 0 THEN 'created' WHEN coalesce(fine AND (auto OR {_SHORT}), false) THEN 'merged' ELSE 'refused' END AS outcome FROM (SELECT i.seq, s.id, (i.seq, s.id) IN (SELECT seq, id FROM ({_NEAR})) AS auto, {_BARE('s.reference_number')} AS x, {_BARE('i.reference_number')} AS y,
    s.bank IS NOT DISTINCT FROM i.bank AND s.direction = i.direction AND s.amount = i.amount AND coalesce(nullif(upper(trim(s.currency)), ''), 'INR') = coalesce(nullif(upper(trim(i.currency)), ''), 'INR') AND coalesce(CASE WHEN s.transaction_time_s IS NOT NULL AND i.transaction_time_s IS NOT NULL THEN abs({_AT} - {_SAT}) <= 600 ELSE s.transaction_date = i.transaction_date END, false) AND NOT coalesce(s.balance <> i.balance, false) AS fine
    FROM tin i JOIN transactions s ON s.id = i.seq))""")
def resolved_duplicates(t):
    i, s = t["incoming"], t["transactions"]
    pairs = i.select("seq", F.col("seq").alias("id"))
    tokens = matching.preview_token(i, s, pairs)
    choices = tokens.select("seq", "id", F.when(F.col("seq") % 3 == 0, "create_new").otherwise("merge").alias("action"), F.when(F.col("seq") % 7 == 0, "old").otherwise(F.col("token")).alias("token"))
    return matching.resolved_duplicates(choices, tokens, matching.explicit_matches(pairs, i, s))


_PAIR = """SELECT id * 2 AS seq, bank, direction, amount, currency, transaction_date, transaction_time_s, false AS received_time, counterparty, cast(NULL AS VARCHAR) AS account_mask, cast(NULL AS VARCHAR) AS reference_number, cast(NULL AS DECIMAL(12, 2)) AS balance, email_type, false AS by_email FROM transactions WHERE id % 5 = 0
    UNION ALL SELECT id * 2 + 1, bank, direction, amount, currency, transaction_date, least(transaction_time_s + 45, 86399), false, counterparty, NULL, 'E' || id, NULL, email_type, true FROM transactions WHERE id % 5 = 0"""
_COLS = "bank, direction, amount, currency, transaction_date, transaction_time_s, received_time, counterparty, account_mask, reference_number, balance, email_type"


@_query(f"""SELECT * FROM (WITH st AS (SELECT id, {_COLS} FROM transactions WHERE id % 5 <> 0), m AS ({_PAIR}), n AS (SELECT seq, (SELECT max(id) FROM st) + 1 + seq - (SELECT min(seq) FROM m) AS fresh FROM m),
    d1 AS (SELECT * FROM (WITH tin AS (SELECT * FROM m WHERE NOT by_email), transactions AS (SELECT * FROM st) {_ALL})),
    t2 AS (SELECT * FROM st UNION ALL SELECT fresh, {_COLS} FROM m JOIN n USING (seq) WHERE seq IN (SELECT seq FROM d1 WHERE action = 'insert')),
    d2 AS (SELECT * FROM (WITH tin AS (SELECT * FROM m WHERE by_email), transactions AS (SELECT * FROM t2) {_ALL}))
    SELECT seq, path, action, CASE WHEN action = 'insert' THEN fresh ELSE id END AS id, reason FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) JOIN n USING (seq))""")
def batch_merged(t):
    """A batch that holds the text message and the e-mail of events that aren't stored."""
    s = t.sorted_with("customer")["transactions"]
    own = s.where("id % 5 = 0").withColumns({"received_time": F.lit(False), "account_mask": F.lit(None).cast("string"), "reference_number": F.lit(None).cast("string"), "balance": F.lit(None).cast("decimal(12,2)")})
    own = own.select("id", *_COLS.split(", "))
    sms = own.withColumn("seq", F.col("id") * 2).withColumn("by_email", F.lit(False))
    mail = own.withColumn("seq", F.col("id") * 2 + 1).withColumn("by_email", F.lit(True)).withColumn("reference_number", F.concat(F.lit("E"), F.col("id").cast("string"))).withColumn("transaction_time_s", F.least(F.col("transaction_time_s") + 45, F.when(F.col("transaction_time_s").isNotNull(), F.lit(86399))))
    return batches.merge_batch(sms.unionByName(mail).drop("id"), s.where("id % 5 <> 0"), _TYPES).decisions.select("seq", "path", "action", "id", "reason")
