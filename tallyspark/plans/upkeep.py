"""Registered queries over rules, categories, links, manual items, audit rows and sync state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.functions.vocabulary import known_slugs
from tallyspark.operators import sync, upkeep
from tallyspark.plans.catalogue import _in, _paise, _query

_CHANGES = "SELECT c_custkey AS change_id, CASE c_custkey % 5 WHEN 0 THEN ' Acme.Pay@UPI ' WHEN 1 THEN '**' WHEN 2 THEN 'swiggy' WHEN 3 THEN 'shop ' || c_custkey % 7 ELSE 'Zomato' END AS pattern, CASE c_custkey % 4 WHEN 0 THEN 'dining' WHEN 1 THEN 'rent' WHEN 2 THEN 'Bad Slug' ELSE 'dinng' END AS category, c_custkey % 50 AS priority FROM customer"
_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(pattern, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_RULES = f"SELECT change_id, {_NORM} AS pattern, category, priority, CASE WHEN {_NORM} = '' THEN 'blank_pattern' WHEN NOT regexp_matches(category, '^[a-z][a-z0-9_]{{1,40}}$') THEN 'invalid_slug' WHEN category NOT IN {_in(known_slugs())} THEN 'unknown_category' ELSE 'ok' END AS verdict FROM ({_CHANGES})"


def _changes(t):
    k = F.col("c_custkey")
    pattern = F.when(k % 5 == 0, " Acme.Pay@UPI ").when(k % 5 == 1, "**").when(k % 5 == 2, "swiggy").when(k % 5 == 3, F.concat(F.lit("shop "), (k % 7).cast("string"))).otherwise("Zomato")
    return t["customer"].select(k.alias("change_id"), pattern.alias("pattern"), F.when(k % 4 == 0, "dining").when(k % 4 == 1, "rent").when(k % 4 == 2, "Bad Slug").otherwise("dinng").alias("category"), (k % 50).alias("priority"))


@_query(_RULES)
def rule_changes(t):
    return upkeep.rule_changes(_changes(t), known_slugs())


@_query(f"SELECT pattern, category, active, priority FROM merchant_rules WHERE pattern NOT IN (SELECT pattern FROM ({_RULES}) WHERE verdict = 'ok') UNION ALL SELECT pattern, category, true, priority FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY change_id DESC) AS r FROM ({_RULES}) WHERE verdict = 'ok') WHERE r = 1")
def merchant_rule_upsert(t):
    rules = t["merchant_rules"].select("pattern", "category", "active", F.col("priority").cast("bigint").alias("priority"))
    return upkeep.upserted_rules(rules, _changes(t), known_slugs())


@_query(f"""SELECT id, ok AS applied, CASE WHEN ok AND raw <> '' THEN slug END AS category, CASE WHEN ok THEN 'manual' END AS category_method, CASE WHEN ok THEN 'resolved' END AS review_status FROM (SELECT *, raw = '' OR (slug IS NOT NULL AND (slug IN {_in(known_slugs())} OR made)) AS ok FROM (
    SELECT id, trim(raw) AS raw, made, CASE WHEN regexp_matches(regexp_replace(lower(trim(raw)), '[ -]+', '_', 'g'), '^[a-z][a-z0-9_]{{1,40}}$') THEN regexp_replace(lower(trim(raw)), '[ -]+', '_', 'g') END AS slug FROM (SELECT id, id % 7 = 0 AS made, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN ' Fees-Charges ' WHEN 2 THEN 'goceries' WHEN 3 THEN '9lives' WHEN 4 THEN 'Rent' ELSE '  ' END AS raw FROM transactions)))""")
def manual_categories(t):
    i = F.col("id")
    raw = F.when(i % 6 == 0, "").when(i % 6 == 1, " Fees-Charges ").when(i % 6 == 2, "goceries").when(i % 6 == 3, "9lives").when(i % 6 == 4, "Rent").otherwise("  ")
    return upkeep.assigned(t["transactions"].select("id", raw.alias("raw"), (i % 7 == 0).alias("create")), known_slugs())


_VOC = "CASE WHEN id % 3 <> 0 THEN id % 5 END"


def _versioned(t):
    return t["transactions"].withColumn("vocab_version", F.when(F.col("id") % 3 != 0, F.col("id") % 5))


@_query(f"SELECT id FROM (SELECT *, {_VOC} AS v FROM transactions) WHERE category_method IS NULL OR category_method = 'pending_llm' OR (category = 'unknown' AND category_method = 'llm' AND (v IS NULL OR v < 3)) ORDER BY id LIMIT 400")
def categorization_backlog(t):
    return upkeep.needs_work(_versioned(t), 3, 400).select("id")


@_query(f"SELECT v AS vocab_version, count(*) AS n FROM (SELECT *, {_VOC} AS v FROM transactions) WHERE category = 'unknown' AND category_method = 'llm' AND coalesce(v, 0) < 4 GROUP BY 1")
def requeued_unknowns(t):
    return upkeep.requeued(_versioned(t), 4)


@_query(f"SELECT id, CASE WHEN NOT stale THEN category END AS category, CASE WHEN stale THEN 'pending_llm' ELSE category_method END AS category_method FROM (SELECT *, coalesce(category = 'unknown' AND category_method = 'llm' AND coalesce({_VOC}, 0) < 4, false) AS stale FROM transactions)")
def requeued_rows(t):
    return upkeep.requeue(_versioned(t), 4).select("id", "category", "category_method")


@_query("SELECT id FROM transactions WHERE id % 2 = 0 AND coalesce(CASE WHEN id % 3 <> 0 THEN id % 5 END, 0) < 3 ORDER BY id LIMIT 50")
def reviews_to_notify(t):
    i = F.col("id")
    return upkeep.to_notify(t["transactions"].select("id", F.when(i % 2 == 0, "pending").alias("review_status"), F.when(i % 3 != 0, i % 5).alias("tries")), 3).select("id")


@_query("""SELECT t.id, sha256('{"account_type":"' || coalesce(a.type, '') || '","amount":"' || cast(t.amount AS VARCHAR) || '","bank":"' || coalesce(t.bank, '') || '","channel":"' || coalesce(t.channel, '') || '","counterparty":"' || regexp_replace(lower(coalesce(t.counterparty, '')), '[^a-z0-9]', '', 'g') || '","currency":"' || coalesce(t.currency, 'INR') || '","direction":"' || t.direction || '","email_type":"' || t.email_type
    || '","raw_description":"' || trim(regexp_replace(regexp_replace(lower(coalesce(t.raw_description, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || '"}') AS digest FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id""")
def input_digests(t):
    a = t["accounts"].select(F.col("id").alias("_a"), F.col("type").alias("_type"))
    return t["transactions"].join(a, F.col("account_id") == F.col("_a"), "left").select("id", upkeep.input_digest(F.col("_type")).alias("digest"))


@_query("""SELECT id, CASE WHEN NOT told OR weak OR against THEN 'unknown' ELSE slug END AS category, 'llm' AS method, cast(round(CASE WHEN NOT told THEN 0 WHEN weak THEN coalesce(c, 0) WHEN against THEN least(c, 0.4) ELSE c END * 100) AS BIGINT) AS percent, CASE WHEN told AND (weak OR against) THEN 'pending' END AS review FROM (
    SELECT *, slug IS NULL OR slug = 'needs_review' OR coalesce(c, 0) < 0.6 AS weak, coalesce((slug IN ('salary', 'refund', 'investment_redemption') AND direction = 'debit') OR (slug IN ('groceries', 'rent', 'dining', 'investment') AND direction = 'credit'), false) AS against FROM (
    SELECT id, direction, id % 8 <> 1 AS told, CASE id % 5 WHEN 0 THEN 'groceries' WHEN 1 THEN 'salary' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'travel' END AS slug, CASE WHEN id % 9 <> 0 THEN cast((id % 10) AS DOUBLE) / 10 END AS c FROM transactions))""")
def model_verdicts(t):
    i = F.col("id")
    slug = F.when(i % 5 == 0, "groceries").when(i % 5 == 1, "salary").when(i % 5 == 2, "needs_review").when(i % 5 == 3, "travel")
    sure = F.when(i % 9 != 0, (i % 10).cast("double") / 10)
    return t["transactions"].select("id", *upkeep.model_verdict(slug, sure, F.col("direction"), F.lit(None).cast("string"), i % 8 != 1)).select("id", "category", "method", F.round(F.col("confidence") * 100).cast("bigint").alias("percent"), "review")


_REQ = "SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN account_id WHEN 2 THEN 999999999 ELSE coalesce(account_id, 1) END AS account_id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 77 WHEN 2 THEN coalesce(account_id, 5) * 10 + 1 END AS card_id FROM transactions"


@_query(f"""SELECT id, CASE WHEN error IS NULL THEN want END AS account_id, CASE WHEN error IS NULL THEN card_id END AS card_id, error FROM (SELECT r.id, r.card_id, coalesce(r.account_id, c.account_id) AS want, CASE WHEN r.card_id IS NOT NULL AND c.id IS NULL THEN 'card_not_found' WHEN c.account_id <> coalesce(r.account_id, c.account_id) THEN 'card_account_mismatch' WHEN coalesce(r.account_id, c.account_id) IS NOT NULL AND a.id IS NULL THEN 'account_not_found' WHEN a.bank <> t.bank THEN 'bank_mismatch' END AS error
    FROM ({_REQ}) r JOIN transactions t ON t.id = r.id LEFT JOIN cards c ON c.id = r.card_id LEFT JOIN accounts a ON a.id = coalesce(r.account_id, c.account_id))""")
def relinked_transactions(t):
    i = F.col("id")
    req = t["transactions"].select("id", F.when(i % 6 == 0, F.lit(None)).when(i % 6 == 1, F.col("account_id")).when(i % 6 == 2, 999999999).otherwise(F.coalesce("account_id", F.lit(1))).alias("account_id"),
                                   F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, 77).when(i % 5 == 2, F.coalesce("account_id", F.lit(5)) * 10 + 1).alias("card_id"))
    return upkeep.relinked(req, t["transactions"], t["accounts"], t["cards"])


@_query("SELECT id FROM transactions WHERE account_id IS NULL AND bank = (SELECT bank FROM accounts WHERE id = 7)")
def linkable_rows(t):
    return upkeep.linkable(t["transactions"], t["accounts"], 7).select("id")


@_query("""SELECT e.id AS snapshot_id, CASE WHEN s.manual_item_id IS NULL THEN 'not_found' WHEN e.d <> s.as_of_date AND EXISTS (SELECT 1 FROM balance_snapshots o WHERE o.manual_item_id = s.manual_item_id AND o.as_of_date = e.d AND o.id <> e.id) THEN 'collision' ELSE 'moved' END AS outcome
    FROM (SELECT id, as_of_date + cast(id % 3 AS INTEGER) AS d FROM balance_snapshots) e JOIN balance_snapshots s ON s.id = e.id""")
def manual_edits(t):
    edits = t["balance_snapshots"].select(F.col("id").alias("snapshot_id"), F.date_add("as_of_date", (F.col("id") % 3).cast("int")).alias("as_of_date"))
    return upkeep.manual_edits(edits, t["balance_snapshots"])


@_query(f"SELECT manual_item_id, as_of_date, {_paise('value')} AS value_paise FROM (SELECT *, row_number() OVER (PARTITION BY manual_item_id, as_of_date ORDER BY fresh DESC, id DESC) AS r FROM (SELECT manual_item_id, as_of_date, value, 0 AS fresh, id FROM balance_snapshots WHERE manual_item_id IS NOT NULL UNION ALL SELECT manual_item_id, as_of_date, value + 7, 1, id FROM balance_snapshots WHERE manual_item_id IS NOT NULL AND id % 4 = 0)) WHERE r = 1")
def manual_balances(t):
    own = t["balance_snapshots"].select("id", "manual_item_id", "as_of_date", F.col("value").cast("decimal(18,2)").alias("value"))
    changes = own.where("manual_item_id is not null and id % 4 = 0").withColumn("value", (F.col("value") + 7).cast("decimal(18,2)"))
    return upkeep.manual_balances(own, changes).select("manual_item_id", "as_of_date", X.paise(F.col("value")).alias("value_paise"))


_LOG = "SELECT s.user_id * 1000 + s.event_id % 1000 AS run_id, s.event_type AS operation, s.ts AS started_at, coalesce(e.status, 'running') AS status, e.fin AS ended_at FROM (SELECT * FROM events WHERE event_type IN ('click', 'view')) s LEFT JOIN (SELECT event_id, min(fin) AS fin, min_by(st, fin) AS status FROM (SELECT event_id, ts + INTERVAL 1 MINUTE AS fin, 'ok' AS st FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, ts + INTERVAL 2 MINUTE, 'failed' FROM events WHERE event_id % 2 = 0) GROUP BY 1) e ON e.event_id = s.event_id"


def _log(t):
    e = t["events"]
    run = (F.col("user_id") * 1000 + F.col("event_id") % 1000).alias("run_id")
    starts = e.where("event_type in ('click', 'view')").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("operation"), F.col("ts").alias("started_at"), run.alias("shown"))
    ends = e.where("event_id % 3 = 0").select(F.col("event_id").alias("run_id"), F.lit("ok").alias("status"), F.expr("ts + interval 1 minute").alias("ended_at")).unionByName(e.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.lit("failed").alias("status"), F.expr("ts + interval 2 minute").alias("ended_at")))
    log = upkeep.audit_log(starts, ends)
    return log.join(starts.select(F.col("run_id").alias("_r"), "shown"), F.col("run_id") == F.col("_r")).select(F.col("shown").alias("run_id"), "operation", "started_at", "status", "ended_at")


@_query(_LOG)
def audit_log(t):
    return _log(t)


@_query(f"SELECT run_id, started_at, status FROM ({_LOG}) WHERE operation = 'click' ORDER BY started_at DESC, run_id DESC LIMIT 200")
def recent_runs(t):
    return upkeep.recent_runs(_log(t), 500, operation="click").select("run_id", "started_at", "status")


@_query("SELECT bank, reference_number, direction, min(id) AS id FROM transactions t WHERE reference_number IS NOT NULL AND id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM transactions s WHERE s.id % 2 = 0 AND s.reference_number = t.reference_number AND s.bank IS NOT DISTINCT FROM t.bank AND s.direction = t.direction) GROUP BY 1, 2, 3")
def landed_rows(t):
    rows = t["transactions"].where("reference_number is not null").select("bank", "reference_number", "direction", "id")
    return upkeep.landing(rows.where("id % 2 = 1"), rows.where("id % 2 = 0").drop("id"), ["bank", "reference_number", "direction"], "id")


@_query("SELECT id, CASE WHEN id % 4 <> 0 THEN reference_number END AS reference_number, CASE WHEN category IS NOT NULL AND category <> '' AND category_method IS NULL THEN 'manual' ELSE category_method END AS category_method FROM transactions")
def repaired_rows(t):
    rows = t["transactions"].withColumn("channel", F.when(F.col("id") % 8 == 0, "nach").otherwise(F.col("channel"))).withColumn("email_type", F.when(F.col("id") % 8 == 4, "bank_nach_debit").otherwise(F.col("email_type")))
    return upkeep.repaired(rows).select("id", "reference_number", "category_method")


@_query("SELECT id, CASE WHEN coalesce(due_date, '') <> '' AND payment_status IS NULL AND created_on >= DATE '1998-01-01' THEN 'unpaid' ELSE payment_status END AS payment_status FROM statement_uploads")
def tracked_statements(t):
    return upkeep.tracked(t["statement_uploads"], "1998-01-20").select("id", "payment_status")


_ST = "event_id AS id, event_id % 7 AS target, event_id % 5 AS desired, 1000 - event_id % 60 AS first_dirty_s, 1000 - event_id % 9 AS last_dirty_s, event_id % 13 = 0 AS force"


@_query(f"SELECT id, least(target, desired) AS applied, desired, CASE WHEN target < desired THEN first_dirty_s END AS first_dirty_s, CASE WHEN target < desired THEN last_dirty_s END AS last_dirty_s, target < desired AND force AS force, target >= desired AS caught_up FROM (SELECT {_ST} FROM events)")
def caught_up_states(t):
    return upkeep.caught_up(t["events"].selectExpr(*_ST.split(", ")))


@_query("""SELECT id, action, CASE WHEN action = 'failed' THEN f + 1 ELSE 0 END AS failures, CASE WHEN action = 'failed' THEN 1000 + 60 * CASE least(f + 1, 5) WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 10 ELSE 15 END END AS next_attempt_s, CASE WHEN action = 'failed' THEN r ELSE b END AS remote_hash FROM (SELECT *, CASE WHEN b IS NOT DISTINCT FROM r THEN 'no_op' WHEN healthy THEN 'reloaded' ELSE 'failed' END AS action FROM (
    SELECT event_id AS id, 'h' || event_id % 4 AS b, CASE WHEN event_id % 5 <> 0 THEN 'h' || event_id % 3 END AS r, event_id % 2 = 0 AS healthy, event_id % 8 AS f FROM events))""")
def sync_attempts(t):
    k = F.col("event_id")
    s = t["events"].select(k.alias("id"), F.concat(F.lit("h"), (k % 4).cast("string")).alias("body_hash"), F.when(k % 5 != 0, F.concat(F.lit("h"), (k % 3).cast("string"))).alias("remote_hash"), (k % 2 == 0).alias("healthy"), (k % 8).alias("failures"), F.lit(1000).alias("now_s"))
    return upkeep.after_attempt(s, sync.backoff_minutes(F.col("failures") + 1))


@_query("""SELECT s.id AS source_id, v.sender FROM (SELECT s_suppkey AS id, s_suppkey % 4 <> 0 AS active, CASE WHEN s_suppkey % 3 <> 0 THEN 1000000 - s_suppkey * 40000 END AS polled FROM supplier) s, (VALUES ('cas@cdsl.test'), ('cas@nsdl.test')) AS v(sender) WHERE s.active AND (polled IS NULL OR 1000000 - polled >= 86400) AND NOT (s.id % 5 = 0 AND v.sender = 'cas@cdsl.test')""")
def managed_rules(t):
    k = F.col("s_suppkey")
    sources = t["supplier"].select(k.alias("id"), (k % 4 != 0).alias("active"), F.when(k % 3 != 0, 1000000 - k * 40000).alias("last_polled_s"))
    rules = t["supplier"].where("s_suppkey % 5 = 0").select(k.alias("source_id"), F.lit("CAS@CDSL.test").alias("sender"))
    return upkeep.auto_rules(sources, rules, ["cas@cdsl.test", "cas@nsdl.test"], F.lit(1000000))


@_query("SELECT commit_id, changed, first_s, last_s, sum(changed) OVER (ORDER BY commit_id)::BIGINT AS revision FROM (SELECT event_id // 50 AS commit_id, count(*) AS changed, min(event_id * 3 % 101) AS first_s, max(event_id * 3 % 101) AS last_s FROM events GROUP BY 1)")
def change_revisions(t):
    k = F.col("event_id")
    return upkeep.revisions(t["events"].select(F.expr("event_id div 50").alias("commit_id"), (k * 3 % 101).alias("at_s")))
