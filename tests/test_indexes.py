"""Joins that would be theta joins: as-of by slots, patterns by q-grams."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import asof, classify, ledger, linking, substrings

D = dt.date(2020, 1, 1)


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_as_of_equals_a_plain_search(spark):
    rnd = random.Random(2)
    day = lambda: D + dt.timedelta(days=rnd.randrange(-900, 900))
    rates = [(rnd.choice("abc"), day(), rnd.randrange(1000)) for _ in range(60)] + [("d", None, 1), (None, D, 2), ("e", D, 7)]
    rows = [(i, rnd.choice(["a", "b", "c", "d", "e", "zz", None]), rnd.choice([None, *[day()] * 20])) for i in range(700)] + [(5, "e", D), (5, "e", D), (6, "e", D - dt.timedelta(days=1))]
    got = asof.as_of(spark.createDataFrame(rows, "id long, k string, d date"), "k", "d", spark.createDataFrame(rates, "k2 string, d2 date, v long"), "k2", "d2", "v", "v", slot_days=9)

    def best(k, d):
        known = [(b, v) for a, b, v in rates if a is not None and a == k and b is not None and d is not None and b <= d]
        return max(known)[1] if known else None

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, k, d, best(k, d)) for i, k, d in rows), key=repr)


def test_as_of_of_one_key_grows_with_the_sum(spark):
    usd = F.concat(F.lit("US"), F.when(F.col("id") >= 0, "D"))  # no literal, which would be folded out of the join
    rates = spark.range(10_000).select(usd.alias("currency"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("rate"))
    rows = spark.range(1_000_000).select("id", usd.alias("currency"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7919 % 11_000).cast("int")).alias("transaction_date"))
    out = ledger.fx_as_of(rows, rates)
    began = time.time()
    off = out.where(F.col("rate") != F.least(F.datediff("transaction_date", F.lit("1990-01-01").cast("date")), F.lit(9999)))
    assert off.isEmpty() and out.where("rate is null").isEmpty() and time.time() - began < 60
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out)


@pytest.mark.parametrize("q", [2, 4])
def test_patterns_are_found_by_their_rarest_grams(spark, q):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    texts = [(i, word(rnd.randrange(0, 30))) for i in range(150)] + [(900, None), (901, "aaaaaaaa")]
    patterns = [(i, word(rnd.randrange(1, 7))) for i in range(120)] + [(500, "aaaa"), (501, "a"), (502, None), (503, "")]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame(patterns, "rule long, pattern string"), "pattern", q)
    assert sorted((r.id, r.rule) for r in got.collect()) == sorted((i, k) for i, t in texts for k, p in patterns if t and p and p in t)


def test_many_rules_need_no_nested_loop(spark, sf):
    from tallyspark.sources.adapter import FinanceTables

    t = FinanceTables(spark, sf)
    few = t["merchant_rules"]
    want = sorted(map(tuple, classify.merchant_match(t["transactions"], few).collect()))
    assert sorted(map(tuple, classify.merchant_match(t["transactions"], few, few=0).collect())) == want and want
    others = spark.range(200_000).select((F.col("id") + 1000).cast("int").alias("id"), F.concat(F.lit("no such shop "), F.hex("id")).alias("pattern"), F.lit("misc").alias("category"), F.lit(True).alias("active"), F.lit(500).alias("priority"))
    many = classify.merchant_match(t["transactions"], few.unionByName(others.select(*few.columns)))
    assert sorted(map(tuple, many.collect())) == want
    assert "NestedLoop" not in plan(many) and "CartesianProduct" not in plan(many)


def agree(a, b):
    return all(x == y or "X" in (x, y) for x, y in zip(reversed(a), reversed(b)))


def test_loose_masks_meet_by_shape(spark, monkeypatch):
    rnd = random.Random(6)
    ask = [(i, rnd.choice("ab"), rnd.choice(["", "XX", "1X", "12"]) + "".join(rnd.choice("12") for _ in range(rnd.choice([3, 4])))) for i in range(120)]
    stored = [(rnd.choice("ab"), "".join(rnd.choice("12X") for _ in range(rnd.randrange(1, 7))), i) for i in range(150)] + [("a", "XX", 900), ("b", "", 901)]
    asked, kept = spark.createDataFrame(ask, "id long, bank_key string, mask string"), spark.createDataFrame(stored, "bank_key string, stored string, hit long")
    want = sorted((i, h) for i, b, m in ask for c, s, h in stored if b == c and s and agree(m, s))
    monkeypatch.setattr(linking, "is_small", lambda df: False)
    for most in (linking.SHAPES, 1):
        monkeypatch.setattr(linking, "SHAPES", most)
        assert sorted((r.id, r.hit) for r in linking.mask_candidates(asked, kept).collect()) == want


def test_a_million_masks_with_hidden_last_digits(spark):
    stored = spark.range(1_000_000).select(F.lit("a").alias("bank_key"), F.concat(F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("XX")).alias("stored"), F.col("id").alias("hit"))
    ask = spark.range(20_000).select("id", F.lit("a").alias("bank_key"), F.concat(F.lpad((F.col("id") * 37).cast("string"), 7, "0"), F.lit("12")).alias("mask"))
    out = linking.mask_candidates(ask, stored)
    assert out.count() == 20_000 and out.where("hit <> id * 37").isEmpty()


def test_fetch_rules_by_index_equal_the_plain_join(spark):
    from tallyspark.sources import messages

    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcAB@.") for _ in range(n))
    m = spark.createDataFrame([(i, rnd.choice([None, text(12), text(12)]), rnd.choice([None, text(20), text(20)])) for i in range(80)], "id long, sender string, subject string")
    r = spark.createDataFrame([(i, rnd.choice([None, " ", text(2), " " + text(3)]), rnd.choice([None, "", text(1), text(4)])) for i in range(60)], "id long, sender string, subject string")
    plain = sorted(map(tuple, messages.rules_for(m, r).collect()))
    assert sorted(map(tuple, messages.rules_for(m, r, few=0).collect())) == plain and len(plain) > 300
