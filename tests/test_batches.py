"""Batches whose messages meet each other: rounds against a plain loop, message by message."""

import datetime as dt
import random
import re

import pytest

from tallyspark.operators import batches

TYPES = ["alias"]
STORED = "id bigint, bank string, direction string, amount decimal(12,2), currency string, transaction_date date, transaction_time_s int, received_time boolean, counterparty string, account_mask string, reference_number string, balance decimal(12,2), email_type string, source string"
INCOMING = STORED.replace("id bigint", "seq bigint").replace("source string", "by_email boolean")
DAY = dt.date(1970, 1, 1)


def moment(r, shift=0):
    return (r["transaction_date"] - DAY).days * 86400 + r["transaction_time_s"] + shift


def alike(a, b):
    x, y = (re.sub("[^a-z0-9]", "", (v or "").lower()) for v in (a, b))
    return bool(x and y and (x in y or y in x))


def last4(mask):
    return re.sub("[^0-9]", "", mask or "")


def find(m, rows, types):
    """(path, action, row, reason) of one message against the rows."""
    same = lambda r: r["bank"] == m["bank"] and r["direction"] == m["direction"]
    event = lambda r: same(r) and r["amount"] == m["amount"] and (r["currency"] or "INR") == (m["currency"] or "INR") and r["transaction_date"] is not None
    ref = (m["reference_number"] or "").strip()
    hits = [r for r in rows if ref and same(r) and r["reference_number"] is not None and r["reference_number"].strip() == ref]
    if hits:
        if len(hits) > 1:
            return "reference", "defer", None, "multiple_candidates"
        if hits[0]["amount"] != m["amount"]:
            return "reference", "defer", None, "reference_amount_mismatch"
        if None not in (hits[0]["balance"], m["balance"]) and hits[0]["balance"] != m["balance"]:
            return "reference", "defer", None, "reference_balance_mismatch"
        return "reference", "match", hits[0], None
    if m["transaction_date"] is None:
        return "none", "insert", None, None
    near, timed = [], m["transaction_time_s"] is not None
    own = 60 if m["received_time"] else 600
    for r in rows:
        if not event(r):
            continue
        if not timed:
            good = r["transaction_date"] == m["transaction_date"]
        elif r["transaction_time_s"] is None:
            good = (moment(m) - own) // 86400 <= (r["transaction_date"] - DAY).days <= (moment(m) + own) // 86400
        else:
            good = abs(moment(m) - moment(r)) <= (60 if m["received_time"] or r["received_time"] else 600)
        if good and (not last4(m["account_mask"]) or not last4(r["account_mask"]) or last4(m["account_mask"]) == last4(r["account_mask"])):
            near.append(r)
    by_cp = [r for r in near if alike(r["counterparty"], m["counterparty"])]
    if not timed or any(r["transaction_time_s"] is None for r in near):
        near = by_cp
    elif len(near) > 1 and by_cp:
        near = by_cp
    if near:
        left = [r for r in near if m["balance"] is None or r["balance"] is None or r["balance"] == m["balance"]]
        if not left:
            return "fuzzy", "insert", None, None
        if m["balance"] is not None:
            equal = [r for r in left if r["balance"] is not None]
            return ("fuzzy", "match", equal[0], None) if len(equal) == 1 else ("fuzzy", "defer", None, "balance_ambiguous")
        channel = "email" if m["by_email"] else "sms"
        if len(left) == 1 and left[0]["balance"] is None and left[0]["source"] not in (channel, "sms+email"):
            return "fuzzy", "match", left[0], None
        return "fuzzy", "defer", None, "multiple_candidates" if len(left) > 1 else "source_slot_filled"
    if timed:
        late = m["transaction_time_s"] >= 43200
        half = [r for r in rows if event(r) and r["email_type"] in types and r["transaction_time_s"] is not None and alike(r["counterparty"], m["counterparty"])
                and (1 <= r["transaction_time_s"] // 3600 <= 11 if late else r["transaction_time_s"] // 3600 == 12) and abs(moment(r) - moment(m, -43200 if late else 43200)) <= 600]
        if len(half) == 1:
            if None not in (half[0]["balance"], m["balance"]) and half[0]["balance"] != m["balance"]:
                return "other_half", "insert", None, "alias_balance_mismatch"
            return "other_half", "match", half[0], None
    return "none", "insert", None, None


def enrich(r, m):
    old, changed = dict(r), {}
    at = lambda x, d: (d - DAY).days * 86400 + x["transaction_time_s"]
    for f in ("counterparty", "account_mask", "reference_number", "balance", "transaction_date", "transaction_time_s"):
        a, b = old[f], m[f]
        if b is None:
            continue
        if a is None:
            changed[f] = b
        elif m["by_email"] and a != b:
            if f == "counterparty":
                x, y = (re.sub("[^a-z0-9]", "", v.lower()) for v in (a, b))
                keep = y != "" and y in x and x != y
            elif f == "account_mask":
                keep = last4(a) == last4(b) or (len(last4(b)) < len(last4(a)) and last4(a).endswith(last4(b)))
            elif f == "transaction_date":
                keep = b >= a
            elif f == "transaction_time_s":
                keep = at(m, m["transaction_date"] or old["transaction_date"]) >= at(old, old["transaction_date"] or m["transaction_date"])
            else:
                keep = False
            if not keep:
                changed[f] = b
    r.update(changed)
    if "transaction_time_s" in changed:
        r["received_time"] = bool(m["received_time"])
    if r["source"] is not None and r["source"] != ("email" if m["by_email"] else "sms"):
        r["source"] = "sms+email"


def one_by_one(messages, stored, types=TYPES):
    rows, out = [dict(r, seq=None) for r in stored], []
    top, low = max((r["id"] for r in rows), default=0), min((m["seq"] for m in messages), default=0)
    for m in sorted(messages, key=lambda m: m["seq"]):
        path, action, row, reason = find(m, rows, types)
        if action == "match":
            enrich(row, m)
        elif action == "insert":
            row = {k: v for k, v in m.items() if k != "by_email"} | {"id": top + 1 + m["seq"] - low, "source": "email" if m["by_email"] else "sms"}
            rows.append(row)
        out.append((m["seq"], path, action, row["id"] if row else None, reason))
    return out, rows


def table(spark, rows, schema):
    names = [x.split()[0] for x in schema.replace("(12,2)", "").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), names


def random_rows(seed, n_stored, n_messages, amounts=(500, 900), minutes=90):
    from decimal import Decimal

    rnd = random.Random(seed)

    def event():
        stated = rnd.random() < 0.85
        at = rnd.randrange(-minutes * 60, minutes * 60) if rnd.random() < 0.8 else rnd.randrange(-minutes * 60, minutes * 60) + 43200
        d, s = divmod(at, 86400)
        return {"bank": "b", "direction": rnd.choice(["debit"] * 4 + ["credit"]), "amount": Decimal(rnd.choice(amounts)), "currency": rnd.choice([None, "INR", "INR", "USD"]), "transaction_date": None if rnd.random() < 0.03 else dt.date(2024, 1, 2) + dt.timedelta(days=d),
                "transaction_time_s": s if stated else None, "received_time": stated and rnd.random() < 0.2, "counterparty": rnd.choice([None, "Shop", "shop*one", "Fuel"]), "account_mask": rnd.choice([None, "XX1111", "XX2222"]),
                "reference_number": rnd.choice([None] * 5 + [" R1", "R2", "R3"]), "balance": rnd.choice([None, None, None, Decimal(10), Decimal(20)]), "email_type": rnd.choice(["alias", "other"])}

    return [event() | {"id": i, "source": rnd.choice(["sms", "email", "sms+email"])} for i in range(1, n_stored + 1)], [event() | {"seq": 7 + 3 * i, "by_email": rnd.random() < 0.5} for i in range(n_messages)]


@pytest.mark.parametrize("seed,stored,messages,amounts,minutes", [(1, 5, 9, (500, 900), 60), (3, 40, 70, tuple(range(100, 170)), 30)])
def test_rounds_equal_one_by_one(spark, seed, stored, messages, amounts, minutes):
    s, m = random_rows(seed, stored, messages, amounts, minutes)
    got = batches.merge_batch(table(spark, m, INCOMING)[0], table(spark, s, STORED)[0], TYPES)
    want, rows = one_by_one(m, s)
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.decisions.collect()) == sorted(want, key=lambda x: x[0])
    names = [*(x.split()[0] for x in STORED.split(", ")), "seq"]
    assert sorted((tuple(r[n] for n in names) for r in got.table.collect()), key=repr) == sorted((tuple(r[n] for n in names) for r in rows), key=repr)
    assert got.rounds < messages


def test_both_messages_of_one_event_are_one_row(spark):
    from decimal import Decimal

    base = {"bank": "b", "direction": "debit", "amount": Decimal(500), "currency": "INR", "transaction_date": dt.date(2024, 1, 2), "transaction_time_s": 36000, "received_time": False, "counterparty": "Shop", "account_mask": None, "reference_number": None, "balance": None, "email_type": "other"}
    m = [base | {"seq": 1, "by_email": False}, base | {"seq": 2, "by_email": True, "transaction_time_s": 35990, "reference_number": "R9"}]
    m += [x | {"seq": x["seq"] + 10 * k, "amount": Decimal(500 + k), "reference_number": x["reference_number"] and f"Q{k}"} for k in range(1, 30) for x in m[:2]]
    got = batches.merge_batch(table(spark, m, INCOMING)[0], table(spark, [], STORED)[0])
    rows = got.table.collect()
    assert len(rows) == 30 and {r.source for r in rows} == {"sms+email"} and len({r.reference_number for r in rows}) == 30 and got.rounds == 2
    # the second text message of one channel isn't the same event for sure
    again = batches.merge_batch(table(spark, [base | {"seq": 1, "by_email": False}, base | {"seq": 2, "by_email": False}], INCOMING)[0], table(spark, [], STORED)[0])
    assert [(r.action, r.reason) for r in again.decisions.orderBy("seq").collect()] == [("insert", None), ("defer", "source_slot_filled")]


def test_empty_batches_and_tables(spark):
    s, m = random_rows(5, 4, 6)
    none = batches.merge_batch(table(spark, [], INCOMING)[0], table(spark, s, STORED)[0], TYPES)
    assert none.rounds == 0 and none.decisions.collect() == [] and none.table.count() == 4
    first = batches.merge_batch(table(spark, m[:1], INCOMING)[0], table(spark, [], STORED)[0], TYPES)
    assert first.rounds == 1 and [r.action for r in first.decisions.collect()] == ["insert"]
