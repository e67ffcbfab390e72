"""Hand-worked cases of the finance operators."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import expressions as X
from tallyspark.operators import investments, listing, statements


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_masks(spark):
    cases = {"XX1234": "XX1234", "0000 XXXX-XXXX 4321": "0000XXXXXXXX4321", "730***11#x": "730XXX11XX", "12A3456": "", "": ""}
    for raw, want in cases.items():
        assert one(spark, X.normalize_mask(F.lit(raw))) == want
    for a, b, want in [("XX1234", "0001234", True), ("XX1234", "1235", False), ("12X4", "1234", True), ("", "1234", False), ("234", "991234", True)]:
        assert one(spark, X.mask_matches(F.lit(a), F.lit(b))) is want
    assert one(spark, X.trailing_digits(F.lit("123XXX"))) == 0


def test_text(spark):
    assert one(spark, X.normalize_text(F.lit("  SWIGGY*Order\t#12 "))) == "swiggy order 12"
    assert one(spark, X.normalize_counterparty(F.lit("Foo Bar @upi"))) == "foobarupi"
    assert one(spark, X.redact_pii(F.lit("call +91 98765 43210 ref 123456789012345678"))) == "call [redacted-phone]ref [redacted-num]"
    assert one(spark, X.is_blank(F.lit(" \t\x0b"))) is True
    assert one(spark, X.parse_amount(F.lit("25,000.00"))) == Decimal("25000.00")
    assert one(spark, X.parse_amount(F.lit("soon"))) is None


def test_page_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, dt.date(2024, 1, 1)), (3, dt.date(2024, 1, 1))], "id long, transaction_date date")
    assert [r.id for r in listing.page(df, descending=True).collect()] == [3, 2, 1]
    assert [r.id for r in listing.page(df, descending=False).collect()] == [2, 3, 1]


def rows(spark, data):
    return spark.createDataFrame(data, "stmt_idx long, account_id long, direction string, date date, amount decimal(12,2), reference_number string, balance decimal(12,2), narration string")


def stored(spark, data):
    return spark.createDataFrame(data, "id long, account_id long, direction string, amount decimal(12,2), transaction_date date, reference_number string")


def test_reconcile_prefers_references_then_offsets_and_refuses_contention(spark):
    d, m = dt.date(2024, 1, 10), Decimal("5.00")
    stmt = rows(spark, [(1, 7, "debit", d, m, "R1", None, None), (2, 7, "debit", d, m, None, None, None), (3, 7, "debit", dt.date(2024, 2, 1), m, None, None, None),
                        (4, 8, "debit", d, m, None, None, None), (5, 8, "debit", d, m, None, None, None), (6, 9, "credit", d, m, None, None, None)])
    txns = stored(spark, [(10, 7, "debit", m, d, "R1"), (11, 7, "debit", m, d, None), (12, 7, "debit", m, dt.date(2024, 1, 31), None), (13, 8, "debit", m, d, None)])
    got = {r.stmt_idx: (r.id, r.status) for r in statements.reconcile(stmt, txns).collect()}
    assert got == {1: (10, "reference"), 2: (11, "date"), 3: (12, "date-1"), 4: (None, "ambiguous"), 5: (None, "ambiguous"), 6: (None, "missing")}


def test_disposals_refuse_to_guess(spark):
    d = dt.date(2024, 1, 1)
    schema = "raw_id long, upload_id long, scope string, isin string, source_ref string, transaction_type string, reference string, acquired_on date, units decimal(20,6), nav decimal(20,6), amount decimal(20,2)"
    raw = spark.createDataFrame([
        (1, 1, "MF", "a", "F", "purchase", None, d, Decimal(10), Decimal(2), Decimal(20)), (2, 1, "MF", "a", "F", "redemption", None, dt.date(2024, 2, 1), Decimal(4), Decimal(2), Decimal(8)),
        (3, 1, "MF", "b", "F", "purchase", None, d, Decimal(10), Decimal(2), Decimal(20)), (4, 1, "MF", "b", "F", "purchase", None, d, Decimal(10), Decimal(2), Decimal(20)), (5, 1, "MF", "b", "F", "redemption", None, dt.date(2024, 2, 1), Decimal(4), Decimal(2), Decimal(8)),
        (6, 1, "MF", "c", "F", "purchase", "X", d, Decimal(10), Decimal(2), Decimal(20)), (7, 1, "MF", "c", "F", "purchase", None, d, Decimal(10), Decimal(2), Decimal(20)), (8, 1, "MF", "c", "F", "sold", "X", dt.date(2024, 2, 1), Decimal(4), Decimal(2), Decimal(8))], schema)
    got = {r.instrument: (r.resolved, r.disposals, r.units_left) for r in investments.disposals(investments.classify(raw)).collect()}
    assert got == {"A": (True, 1, Decimal("6.000000")), "B": (False, 0, None), "C": (True, 1, Decimal("16.000000"))}


def test_canonical_lots_take_the_largest_multiplicity(spark):
    d = dt.date(2024, 1, 1)
    lot = lambda i, u: (i, u, "MF", "a", "F", "purchase", None, d, Decimal(10), Decimal(2), Decimal(20))
    schema = "raw_id long, upload_id long, scope string, isin string, source_ref string, transaction_type string, reference string, acquired_on date, units decimal(20,6), nav decimal(20,6), amount decimal(20,2)"
    raw = spark.createDataFrame([lot(1, 1), lot(2, 1), lot(3, 2)], schema)
    got = sorted((r.occurrence, r.uploads, r.first_upload) for r in investments.canonical_lots(investments.classify(raw)).collect())
    assert got == [(0, 2, 1), (1, 1, 1)]


def test_formats(spark):
    from tallyspark.functions import formatting

    for value, want in [("1234567.891", "₹12,34,567.89"), ("-999.995", "-₹1,000.00"), ("12.5", "₹12.50"), (None, "₹0.00"), ("100000", "₹1,00,000.00")]:
        assert one(spark, formatting.indian_amount(F.lit(value).cast("decimal(20,4)"))) == want
    for value, want in [("23400000", "₹2.34Cr"), ("1250000", "₹12.5L"), ("1500", "₹1.5K"), ("999.5", "₹999.50")]:
        assert one(spark, formatting.compact_amount(F.lit(value).cast("decimal(20,2)"))) == want


def test_scalar_functions(spark):
    from tallyspark.functions import udfs

    assert one(spark, udfs.redact_names(["alex", "doe", "x"])(F.lit("ALEX QUINN DOE paid at Shop"))) == "[redacted-name] paid at Shop"
    assert one(spark, udfs.narration_names(F.lit("UPI/RAZ*SWIGGY/12"), F.lit("raz*swiggy"))) is True
    assert one(spark, udfs.narration_names(F.lit("CAFÉTERIA bill"), F.lit("cafe"))) is False
    token = one(spark, udfs.portfolio_token("s")(F.lit(" p1 ")))
    assert token == one(spark, udfs.portfolio_token("s")(F.lit("P1"))) and token.startswith("P-") and len(token) == 18
    assert one(spark, udfs.portfolio_token(" ")(F.lit("P1"))) is None


def test_mail_folder(spark, tmp_path):
    from tallyspark.sources.messages import mail_folder

    (tmp_path / "hdfc").mkdir()
    (tmp_path / "hdfc" / "a.eml").write_bytes(b"Message-ID: <1@x>\r\nFrom: Bank <a@b.c>\r\nSubject: Alert\r\nDate: Mon, 01 Jan 2024 10:00:00 +0530\r\nContent-Type: text/plain\r\n\r\nRs 5 debited\r\n")
    r = mail_folder(spark, f"file://{tmp_path}").first()
    assert (r.bank, r.message_id, r.subject, r.received_at.isoformat(), r.body.strip()) == ("hdfc", "<1@x>", "Alert", "2024-01-01T04:30:00", "Rs 5 debited")


def test_journal_is_written_in_order(spark, tmp_path):
    from tallyspark.operators import journal

    texts = spark.createDataFrame([(3, dt.date(2024, 1, 2), "c"), (1, dt.date(2024, 1, 2), "b"), (2, dt.date(2024, 1, 1), "a")], "id long, date date, text string").repartition(3)
    journal.write_journal(texts, f"file://{tmp_path}/j")
    files = sorted((tmp_path / "j").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "a\nb\nc\n"
    assert journal.digest(texts).first() == journal.digest(texts.coalesce(1)).first() != journal.digest(texts.where("id < 3")).first()


def test_replacement_respects_precedence(spark):
    from tallyspark.sources.messages import replaced, upserted

    stored = spark.createDataFrame([(1, "A", 2), (2, "B", 1)], "id long, k string, rank int")
    new = spark.createDataFrame([(3, "A", 1), (4, "B", 1), (5, "C", 1)], "id long, k string, rank int")
    assert sorted(r.id for r in replaced(stored, new, ["k"], "rank").collect()) == [1, 4, 5]
    assert sorted(r.id for r in upserted(stored, new, ["k"], "id").collect()) == [3, 4, 5]


def plain_disposals(events):
    """(source, instrument): resolved, disposals taken and units left, event by event."""
    out = {}
    for key in {(e[0], e[1]) for e in events}:
        own = sorted((e for e in events if (e[0], e[1]) == key), key=lambda e: (e[2], e[3], e[4]))
        lots, resolved, taken = [], True, 0
        for _, _, _, sold, _, units, ref in own:
            if not sold:
                lots.append([units, ref])
                continue
            able = [x for x in lots if units is not None and x[0] >= units > 0]
            named = [x for x in able if ref is not None and x[1] == ref]
            pick = named if len(named) == 1 else able if len(able) == 1 else []
            if not pick:
                resolved = False
                break
            pick[0][0] -= units
            taken += 1
        out[key] = (resolved, taken, sum((x[0] for x in lots), Decimal(0)) if resolved else None)
    return out


def test_disposals_equal_a_plain_loop(spark):
    import random

    rnd, events = random.Random(8), []
    for k in range(60):
        for i in range(rnd.randrange(1, 14)):
            sold = i > 0 and rnd.random() < 0.5
            units = None if sold and rnd.random() < 0.03 else Decimal(rnd.choice([2, 2, 5])) if rnd.random() < 0.97 else Decimal("0.5")
            events.append((f"F{k % 3}", f"I{k}", dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(9)), sold, k * 100 + i, units, rnd.choice([None, "A", "B"])))
    # one instrument that is bought and sold out again and again: stretches of two events
    events += [("F", "long", dt.date(2000, 1, 1) + dt.timedelta(days=i), i % 2 == 1, 10_000 + i, Decimal(3), None) for i in range(3000)]
    df = spark.createDataFrame([(i, src, ins, on, "disposal_transaction" if sold else None, u, r) for src, ins, on, sold, i, u, r in events], "raw_id long, source_ref string, instrument string, acquired_on date, reason string, units decimal(20,6), reference string")
    out = investments.disposals(df)
    want = plain_disposals(events)
    assert {(r.source_ref, r.instrument): (r.resolved, r.disposals, r.units_left) for r in out.collect()} == want
    assert want["F", "long"] == (True, 1500, 0) and sum(r for r, _, _ in want.values()) > 10 and sum(not r for r, _, _ in want.values()) > 10
    assert "Python" not in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")


def test_whole_tokens_are_quoted_in_both_forms(spark):
    from pyspark.sql import functions as F

    from tallyspark.functions import udfs

    udfs.register(spark)
    rows = [("a.b c", "a.b"), ("aXb c", "a.b"), ("x \\E y", "\\E"), ("xab", "ab"), ("ab", ""), ("(q\\Ew) ", "q\\Ew"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "t string, k string")
    got = df.select(udfs.contains_whole_token(F.col("t"), F.col("k")).alias("x"), F.expr("contains_whole_token(t, k)").alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [True, False, True, False, False, True, False, False]


def test_dates_are_read_however_they_are_written(spark):
    from pyspark.sql import functions as F

    from tallyspark.functions import expressions as X

    want = {"1/2/2024": "2024-02-01", "13/1/24": "2024-01-13", "1-13-2024": "2024-01-13", " 3rd Mar 1999 ": "1999-03-03", "March 3, 2001": "2001-03-03", "Tue, 5 September 2023": "2023-09-05", "5sep23": "2023-09-05", "2024-02-29": "2024-02-29", "20240229": "2024-02-29",
            "2024 Jan 7": "2024-01-07", "07.08.73": "2073-08-07", "07.08.75": "1975-08-07", "1st of June 2020 at": None, "29/2/2023": None, "13/13/2024": None, "soon": None, "": None, "5/2024": None, "12/11/2020 5:07 pm": "2020-11-12", "2020-11-12T05:07:00+05:30": "2020-11-12", "0/1/2024": None}
    got = {r.t: r.d for r in spark.createDataFrame([(k,) for k in [*want, None]], "t string").select("t", X.parse_date_leniently(F.col("t"), 2024).cast("string").alias("d")).collect()}
    assert got == want | {None: None}


def test_a_raised_vocabulary_requeues_unknowns(spark):
    from tallyspark.operators import upkeep

    cats, version = upkeep.with_categories(spark.createDataFrame([("dining", True), ("old", False)], "slug string, active boolean"), ["dining", "pets", "pets", "rent"], 3)
    assert version == 5 and sorted(map(tuple, cats.collect())) == [("dining", True), ("old", False), ("pets", True), ("rent", True)]
    rows = [(1, "unknown", "llm", 3), (2, "unknown", "llm", None), (3, "unknown", "llm", 5), (4, "unknown", "rule", 1), (5, "dining", "llm", 1), (6, None, None, None)]
    got = upkeep.requeue(spark.createDataFrame(rows, "id long, category string, category_method string, vocab_version int"), version)
    assert sorted(map(tuple, got.collect())) == [(1, None, "pending_llm", 3), (2, None, "pending_llm", None), *rows[2:]]


def test_revisions_over_many_levels(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import upkeep

    changes = spark.range(3000).select((F.col("id") * 7919 % 1000 - 300).alias("commit_id"), F.col("id").alias("at_s"))
    got = {r.commit_id: r.revision for r in upkeep.revisions(changes, width=5).collect()}
    assert got == {c: 3 * (i + 1) for i, c in enumerate(range(-300, 700))}
