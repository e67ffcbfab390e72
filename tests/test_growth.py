"""Work that must not grow with pairs: lookups once a mask, mails dealt over tasks, pairs that aren't shuffled, sorts that serve twice."""

import email
import email.policy

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import investments, matching, upkeep, uploads
from tallyspark.sources import messages


def _most_rows(spark, df, node):
    """The most rows that an operator of this kind made."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            plan.append(p.plan())
        m = p.metrics().get("numOutputRows")
        if node in p.nodeName() and m.isDefined():
            found.append(m.get().value())
        plan += [p.children().apply(k) for k in range(p.children().size())]
    return max(found, default=0)


def test_card_statements_that_show_alike_are_looked_up_once(spark):
    accounts = spark.range(400).select("id", F.lit("hdfc").alias("bank"), F.lit("credit_card").alias("type"), F.lpad(F.col("id").cast("string"), 10, "0").alias("account_number"), F.lit(True).alias("active"))
    cards = spark.range(400).select(F.col("id").alias("account_id"), F.concat(F.lit("XX"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("card_mask"))
    s = spark.range(3000).select("id", F.lit("hdfc").alias("bank"), F.when(F.col("id") % 3 == 0, "XX07").when(F.col("id") % 3 == 1, "XX0005").alias("mask"))
    df = uploads.account_of_mask(s, accounts, cards)
    assert _most_rows(spark, df, "Join") <= 3000
    got = {r["id"]: (r["account_id"], r["matches"]) for r in df.collect()}
    assert (len(got), got[0], got[1], got[2]) == (3000, (None, 4), (5, 1), (None, 0))


def test_bank_statements_that_show_alike_are_looked_up_once(spark):
    accounts = spark.range(400).select("id", F.lit("hdfc").alias("bank"), F.lit("bank_account").alias("type"), F.lpad(F.col("id").cast("string"), 10, "0").alias("account_number"), F.lit(True).alias("active"))
    s = spark.range(3000).select("id", F.lit("hdfc").alias("bank"), F.when(F.col("id") % 3 == 0, "X123").when(F.col("id") % 3 == 1, "XX0005").otherwise("123").alias("mask"))
    df = uploads.bank_account_of(s, accounts)
    assert _most_rows(spark, df, "Join") < 30_000
    got = {r["id"]: r["account_id"] for r in df.collect()}
    assert (len(got), got[0], got[1], got[2]) == (3000, None, 5, 123)


@pytest.mark.parametrize("read", [messages.parsed_mail, messages.mail_attachments])
def test_mails_of_one_split_are_dealt_over_tasks(spark, read):
    raw = b"From: a@b.test\r\nSubject: s\r\nContent-Type: application/pdf; name=a.pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nx"
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(raw).alias("content"))
    rows = read(files).select("path", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 400 and len({r["p"] for r in rows}) > 1


HEADERS = ["u1@bank.test", "<m.1@x>", "Statement 7", "a  b", " lead", "trail ", "=?utf-8?q?caf=C3=A9?=", "x =?utf-8?b?w6k=?= y", "A B <a@b.c>", "a=b? c", "caf\xe9", "a.@b", '"q" <x@y>', "a@b, c@d", "(c) a@b", "\x07", "tab\there", "<>", "@", ""]


def test_headers_read_as_the_default_policy_reads_them():
    for v in HEADERS:
        for name in ("From", "Subject", "Message-ID"):
            raw = f"{name}: {v}\r\nX-Y: z\r\n\r\nbody".encode()
            want = email.message_from_bytes(raw, policy=email.policy.default)
            try:
                want = str(want[name]).encode("utf-8", "replace").decode()
            except Exception:  # noqa: BLE001
                want = None
            assert messages._header(messages._message(raw), name) == want, (name, v)


def test_a_header_is_read_once(monkeypatch):
    calls = []
    messages._read_header.cache_clear()
    default = email.policy.default.header_factory
    monkeypatch.setattr(type(default), "__call__", lambda self, name, value, f=type(default).__call__: calls.append(name) or f(self, name, value))
    m = messages._message(b"Content-Type: application/pdf; name=a.pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nx")
    for _ in range(5):
        messages._attachments(m)
    assert calls.count("Content-Disposition") == 1


def test_pairs_of_untimed_messages_are_not_shuffled(spark):
    s = spark.range(1000).select("id", F.lit("hdfc").alias("bank"), F.lit("debit").alias("direction"), F.lit(1).alias("amount"), F.lit("INR").alias("currency"), F.lit("2024-01-01").cast("date").alias("transaction_date"), F.lit(5).alias("transaction_time_s"), F.lit(False).alias("received_time"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string"), F.lit("x")).alias("counterparty"), F.lit(None).cast("string").alias("account_mask"), F.lit(None).cast("int").alias("balance"))
    i = s.where("id % 2 = 0").withColumn("transaction_time_s", F.lit(None).cast("int")).withColumnRenamed("id", "seq")
    df = matching.fuzzy_candidates(i, s).select("seq", "id")
    assert df.count() == 500 * 20
    assert _most_rows(spark, df, "Sort") == 0 and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_landing_needs_no_join_and_keeps_nulls_and_types(spark):
    rows = spark.createDataFrame([(1, "a", 9), (2, "a", 9), (3, None, 9), (4, None, 8), (5, "b", None), (6, "c", 1)], "raw_id bigint, k string, n int")
    stored = spark.createDataFrame([(None, 9), ("c", 1), ("c", 1), ("z", 1)], "k string, n bigint")
    df = upkeep.landing(rows, stored, ["k", "n"], "raw_id")
    assert dict(df.dtypes) == dict(rows.dtypes) and sorted(r["raw_id"] for r in df.collect()) == [1, 4, 5]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def _untimed(spark, n, **columns):
    made = {"bank": F.lit("hdfc"), "direction": F.lit("debit"), "amount": F.lit(1), "currency": F.lit("INR"), "transaction_date": F.lit("2024-01-01").cast("date"), "transaction_time_s": F.lit(None).cast("int"), "received_time": F.lit(False),
            "counterparty": F.lit("Acme"), "account_mask": F.lit(None).cast("string"), "balance": F.lit(None).cast("int")}
    return spark.range(n).select("id", *[c.alias(k) for k, c in (made | columns).items()])


def test_rows_that_show_the_same_are_compared_once(spark, monkeypatch):
    s, i = _untimed(spark, 600), _untimed(spark, 300).withColumnRenamed("id", "seq")
    df = matching.fuzzy_candidates(i, s, parts=True).select("seq", "id")
    assert _most_rows(spark, df, "Join") <= 600
    assert df.distinct().count() == df.count() == 300 * 600
    # many rows that show the same are some parts, not one
    monkeypatch.setattr(matching, "PART", 50)
    df = matching.fuzzy_candidates(i, s, parts=True).select("seq", "id")
    assert 30 < _most_rows(spark, df.repartition(1), "ObjectHashAggregate") <= 600
    assert df.distinct().count() == df.count() == 300 * 600


@pytest.mark.parametrize("part", [0, 2, 1024])
def test_untimed_messages_meet_the_rows_that_a_loop_finds(spark, monkeypatch, part):
    monkeypatch.setattr(matching, "PART", part)
    pick = lambda salt, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    odd = lambda salt: {
        "bank": pick(salt + "b", "hdfc", "sbi", None), "direction": pick(salt + "d", "debit", "debit", "credit"), "amount": pick(salt + "a", "1", "1.5", None).cast("decimal(9,2)"), "currency": pick(salt + "c", "INR", None, "USD"),
        "transaction_date": pick(salt + "t", "2024-01-01", "2024-01-01", "2024-01-02", None).cast("date"), "counterparty": pick(salt + "n", "Acme", "acme ltd", "Ravi", "", " ", None), "account_mask": pick(salt + "m", "XX12", "9912", "X34", "", "?", None),
        "identifies_by": pick(salt + "w", "card_mask", "card_mask", "none", None), "card_mask": pick(salt + "k", "XX1234", "1234", "X4", "XX99", "34X", "", None), "balance": pick(salt + "l", "5", None).cast("decimal(9,2)"), "by_email": pick(salt + "e", "true", "false", None).cast("boolean"),
        "source": pick(salt + "s", "sms", "email", "sms+email", None)}
    s = _untimed(spark, 500, **odd("s"), transaction_time_s=pick("st", "5", None).cast("int"))
    # some messages have a seq in common, some have none
    i = _untimed(spark, 400, **odd("i")).withColumn("seq", F.when(F.col("id") < 250, F.col("id")).when(F.col("id") < 350, F.floor(F.col("id") / 2))).drop("id", "source")
    stored, asked, pairs = [r.asDict() for r in s.collect()], [r.asDict() for r in i.collect()], []
    bare = lambda c: "".join(x for x in (c or "").lower() if x.isalnum())
    mask = lambda c: c or "" if set(c or "") <= set("0123456789X") else ""
    fits = lambda a, b: all(x == y or "X" in (x, y) for x, y in zip(a[::-1], b[::-1]))
    for a in asked:
        for b in stored:
            if any(a[c] is None or a[c] != b[c] for c in ("bank", "direction", "amount", "transaction_date")) or (a["currency"] or "INR") != (b["currency"] or "INR"):
                continue
            if mask(a["account_mask"]) and mask(b["account_mask"]) and not fits(mask(a["account_mask"]), mask(b["account_mask"])):
                continue
            x, y, j, k = bare(a["counterparty"]), bare(b["counterparty"]), mask(a["card_mask"]), mask(b["card_mask"])
            card = a["identifies_by"] == b["identifies_by"] == "card_mask" and j[-1:].isdigit() and k[-1:].isdigit() and fits(j, k)
            tier = 3 if x and y and (x in y or y in x) else 2 if card else int(a["identifies_by"] == b["identifies_by"] == "none")
            is_open = not (b["source"] == "sms+email" or b["source"] == ("email" if a["by_email"] else "sms"))
            pairs.append((a["seq"], tier, (a["seq"], b["id"], a["balance"], b["balance"], is_open)))
    best = {q: max(t for p, t, _ in pairs if p == q) for q in {p for p, _, _ in pairs}}
    want = [row for q, tier, row in pairs if tier == best[q] > 0]
    assert {t for _, t, _ in pairs} == {0, 1, 2, 3} and {best[q] for q, *_ in want} == {1, 2, 3} and None in {q for q, *_ in want}
    got = [tuple(r) for r in matching.fuzzy_candidates(i, s, slots=True, parts=part > 0).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
