"""Card statement reconciliation against a plain version over whole tables."""

import datetime as dt
import itertools
import random
from decimal import Decimal

from tallyspark.functions import udfs
from tallyspark.operators import card_statements

DAY = dt.date(2024, 3, 1)


def agree(a, b):
    """Whether two masks can be one card: equal digits wherever both show one, from the right."""
    return bool(a and b) and all(x == y or "X" in (x, y) for x, y in zip(reversed(a), reversed(b)))


def one_card(mask, cards):
    own = [c for c in cards if agree(mask, c)]
    return bool(own) and all(agree(x, y) for x, y in itertools.product(own, own))


def names(row, txn):
    told = row["narration"].lower().split()
    conflict = row["card"] and txn["card"] and not agree(row["card"], txn["card"])
    return not conflict and (txn["who"] in told or " ".join(told) == txn["text"])


def plain(rows, txns, cards):
    can = {r["i"]: {t["i"] for t in txns if t["amount"] == r["amount"] and abs((t["date"] - r["date"]).days) <= 1} for r in rows}
    by_id, by_row, free, won = {t["i"]: t for t in txns}, {r["i"]: r for r in rows}, {t["i"] for t in txns}, {}
    for r in rows:
        for step in (0, -1, 1):
            fit = sorted(i for i in can[r["i"]] & free if (by_id[i]["date"] - r["date"]).days == step and (not by_id[i]["card"] or not cards or any(agree(by_id[i]["card"], c) for c in cards)))
            if fit:
                won[r["i"]] = fit[0]
                free.remove(fit[0])
                break
    doubt = []
    for s, i in won.items():
        rivals = [o for o in can if o != s and i in can[o]]
        mine, theirs = by_row[s]["card"], by_id[i]["card"]
        if agree(mine, theirs) and one_card(mine, cards) and one_card(theirs, cards):
            rivals = [o for o in rivals if not (by_row[o]["card"] and theirs and not agree(by_row[o]["card"], theirs))]
        if rivals and len({by_row[o]["narration"].strip() for o in [s, *rivals]}) > 1:
            doubt.append(s)
    group = {s: {s} for s in doubt}
    for a, b in itertools.combinations(doubt, 2):
        if can[a] & can[b] and group[a] is not group[b]:
            both = group[a] | group[b]
            for s in both:
                group[s] = both
    kept = set()
    for g in {id(g): g for g in group.values()}.values():
        ids = {won[s] for s in g}
        named = {s: [i for i in can[s] if names(by_row[s], by_id[i])] for s in g}
        if len(g) < 2 or any(len(n) != 1 or n[0] not in ids for n in named.values()) or {n[0] for n in named.values()} != ids:
            continue
        if any(sum(names(by_row[o], by_id[i]) for o in can if i in can[o]) != 1 for i in ids):
            continue
        won |= {s: n[0] for s, n in named.items()}
        kept |= g
    out = {}
    for r in rows:
        s = r["i"]
        if s in won and (s not in doubt or s in kept):
            step = (by_id[won[s]]["date"] - r["date"]).days
            out[s] = won[s], {0: "date", -1: "date-1", 1: "date+1"}[step]
        else:
            out[s] = None, "ambiguous" if can[s] else "missing"
    return out


def frames(spark, rows, txns, cards, account=1):
    row = [(r["i"], account, "debit", Decimal(r["amount"]), r["date"], r["card"], r["narration"]) for r in rows]
    txn = [(t["i"], account, "debit", Decimal(t["amount"]), t["date"], t["card"], t["who"], t["text"]) for t in txns]
    return (spark.createDataFrame(row, "stmt_idx long, account_id long, direction string, amount decimal(12,2), date date, card_number string, narration string"),
            spark.createDataFrame(txn, "id long, account_id long, direction string, amount decimal(12,2), transaction_date date, card_mask string, counterparty string, raw_description string"),
            spark.createDataFrame([(account, None)], "id long, account_number string"),
            spark.createDataFrame([(account, c) for c in cards], "account_id long, card_mask string"))


def test_reconciliation_equals_a_plain_version(spark):
    rnd, kinds = random.Random(4), set()
    joined, wanted = None, {}
    for account in range(1, 40):
        cards = rnd.choice([[], ["XX1234"], ["XX1234", "XX5678"], ["XX12", "5100XX99"]])
        pick = lambda: rnd.choice(["", "XX1234", "XX5678", "XX34", "XX9999"])  # noqa: B023, E731
        word = lambda: rnd.choice(["zomato", "uber", "metro"])
        rows = [{"i": account * 100 + k, "amount": rnd.choice([5, 9]), "date": DAY + dt.timedelta(rnd.randrange(4)), "card": pick(), "narration": rnd.choice(["", f"{word()} order", f"pay {word()}"])} for k in range(7)]
        txns = [{"i": account * 100 + 50 + k, "amount": rnd.choice([5, 9]), "date": DAY + dt.timedelta(rnd.randrange(4)), "card": pick(), "who": word(), "text": rnd.choice(["", "pay uber"])} for k in range(7)]
        wanted |= plain(rows, txns, cards)
        made = frames(spark, rows, txns, cards, account)
        joined = made if joined is None else tuple(a.unionByName(b) for a, b in zip(joined, made))
    got = {r.stmt_idx: (r.id, r.status) for r in card_statements.reconcile(*joined).collect()}
    assert got == wanted
    kinds = {s for _, s in got.values()}
    assert kinds == {"date", "date-1", "date+1", "ambiguous", "missing"}


def test_contested_rows_keep_what_they_name(spark):
    rows = [{"i": 1, "amount": 5, "date": DAY, "card": "", "narration": "paid uber"}, {"i": 2, "amount": 5, "date": DAY, "card": "", "narration": "paid zomato"}, {"i": 3, "amount": 7, "date": DAY, "card": "", "narration": "x"}]
    txns = [{"i": 11, "amount": 5, "date": DAY, "card": "", "who": "zomato", "text": ""}, {"i": 12, "amount": 5, "date": DAY, "card": "", "who": "uber", "text": ""}]
    assert {r.stmt_idx: (r.id, r.status) for r in card_statements.reconcile(*frames(spark, rows, txns, [])).collect()} == {1: (12, "date"), 2: (11, "date"), 3: (None, "missing")} == plain(rows, txns, [])


def test_names_take_in_their_neighbours():
    marks = lambda s: udfs._with_marks(s, ["ravi", "doe"])
    assert marks("paid Ravi Kumar Singh today") == "paid [redacted-name] today"
    assert marks("to ravi via doe k") == "to [redacted-name] k"
    assert marks("ravi one two doe") == "[redacted-name] one two [redacted-name]"
    assert marks("no one here") == "no one here" and marks("") == ""


def test_functions_have_names_in_sql(spark):
    udfs.register(spark)
    row = spark.sql(r"SELECT normalized_text('A.b  c') a, normalized_counterparty('É-1 x') b, normalized_mask('xx-12*') c, masks_agree('XX12', '5112') d, contains_whole_token('raz*swiggy/12', 'raz*swiggy') e, contains_whole_token('cafeteria', 'cafe') f").first()
    assert tuple(row) == ("a b c", "é1x", "XX12X", True, True, False)


def test_disposals_of_a_portfolio_are_those_of_its_rows(spark, sf):
    from pyspark.sql import functions as F

    from tallyspark.operators import investments
    from tallyspark.sources.adapter import FinanceTables

    raw = investments.classify(FinanceTables(spark, sf)["raw_lots"])
    uploads = spark.createDataFrame([(i, f"P{i % 3}") for i in range(1, 11)], "id long, portfolio_key string")
    got = {(r.portfolio_key, r.source_ref, r.instrument): (r.resolved, r.disposals) for r in investments.disposals_by_portfolio(raw, uploads).collect()}
    one = investments.disposals(raw.where(F.col("upload_id").isin([1]))).collect()
    alone = investments.disposals_by_portfolio(raw, uploads.where("id = 1")).collect()
    assert sorted((r.source_ref, r.instrument) for r in one) == sorted((r.source_ref, r.instrument) for r in alone)
    assert len(got) > 100 and {k[0] for k in got} == {"P0", "P1", "P2"}
