"""Batches of messages that meet each other: the merge driver by chains.

Messages are merged in the order of ``seq``, each against the table as the earlier ones left it.  Messages whose work can't
touch don't wait for each other: they are in different *chains*.  What a message can touch are the days that its time window and
the same window twelve hours off reach, of its bank, direction, amount and currency, and its reference (bank, direction), with
the days of rows that hold that.  Messages that share a day or a reference, directly or over others, are one chain.

Chains are found by joins, sorts and, where references join days of different events, by labels that spread (rounds grow with
the logarithm of the longest path); then each chain's rows and messages are sorted into one task and merged as they come.
Nothing comes to the driver but two bounds and whether labels still change, however long chains are.  A task holds the rows of
one chain at a time; one chain's messages wait for each other and are no work that could be shared out.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import normalize_counterparty, normalize_mask, trailing_digits
from tallyspark.operators.matching import FIELDS, RECEIVED_WINDOW_S, TWELVE_HOUR_TYPES, WINDOW_S, seconds

_HALF_DAY, _DAY = 43_200, 86_400


@dataclass
class Merged:
    """``decisions``: seq, round (how many messages of its chain went before), path, action, id (the row that it made or met) and
    reason; ``table``: the stored rows after the batch, with the seq of the message that made a row."""

    decisions: DataFrame
    table: DataFrame

    @property
    def rounds(self) -> int:
        """The messages of the longest chain."""
        last = self.decisions.agg(F.max("round")).first()[0]
        return 0 if last is None else last + 1


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own under ``spark.checkpoint.dir`` and read back.  A local session that names none gets a
    folder under /tmp, one on a cluster is refused."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/tallyspark-checkpoints"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _event() -> Column:
    """Bank, direction, amount and currency as one text; null where one of the first three is."""
    return F.when(F.col("bank").isNotNull() & F.col("direction").isNotNull(), F.concat(F.concat_ws("\1", "bank", "direction", F.coalesce("currency", F.lit("INR"))), F.lit("\1"), F.col("amount").cast("decimal(38,10)").cast("string")))


def _reference() -> Column:
    """The number of a reference with its bank and direction; null where there is none."""
    ref = F.trim("reference_number")
    return F.when((ref != "") & F.col("bank").isNotNull() & F.col("direction").isNotNull(), F.xxhash64(F.lit("r"), "bank", "direction", ref))


def _day() -> Column:
    return F.unix_date("transaction_date").cast("bigint")


def day_chains(messages: DataFrame) -> DataFrame:
    """(event, day, chain) of the days that messages (_event, transaction_date, transaction_time_s) reach: one chain where reaches overlap."""
    at, own = seconds(F.col("transaction_date"), F.col("transaction_time_s")), _day()
    edge = lambda pick, by: pick(own, F.coalesce(F.floor((at + by) / _DAY), own))
    spans = messages.where("_event is not null and transaction_date is not null").select("_event", edge(F.least, -_HALF_DAY - WINDOW_S).alias("_first"), edge(F.greatest, _HALF_DAY + WINDOW_S).alias("_last")).distinct()
    w = Window.partitionBy("_event").orderBy("_first", "_last")
    before = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_start", F.when(before.isNull() | (F.col("_first") > before), F.col("_first")))
    spans = spans.withColumn("_start", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = spans.select("_event", "_start", F.explode(F.sequence("_first", "_last")).alias("_d")).groupBy("_event", "_d").agg(F.min("_start").alias("_start"))
    return days.select(F.col("_event").alias("_e"), "_d", F.xxhash64(F.lit("e"), "_event", "_start").alias("_days"))


def joined_chains(links: DataFrame) -> DataFrame | None:
    """(node, label) of chains that references (ref, node) join, labelled by the smallest node; None where none does."""
    ends = shared_table(links.groupBy("ref").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).where("a < _hi").select(F.col("ref").alias("_r"), "a"))
    if ends.isEmpty():
        return None
    edges = shared_table(links.join(ends, F.col("ref") == F.col("_r")).where("a < node").select("a", F.col("node").alias("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = shared_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = shared_table(spread.join(hop, F.col("label") == F.col("via")).select("node", F.least("label", "further").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def chains(messages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their ``_chain``; rows that no message can reach are left out."""
    messages, rows = (df.withColumns({"_event": _event(), "_ref": _reference()}) for df in (messages, rows))
    days = day_chains(messages)
    dated = lambda df, how: df.join(days, (F.col("_event") == F.col("_e")) & (_day() == F.col("_d")), how).drop("_e", "_d")
    named = messages.where("_ref is not null").select(F.col("_ref").alias("_named")).distinct()
    m = dated(messages, "left")
    # rows without a reference are dealt by their id, else all of them would meet in one task
    r = dated(rows, "left").join(named, F.coalesce("_ref", F.xxhash64(F.lit("i"), "_id")) == F.col("_named"), "left").where("_days is not null or _named is not null")
    m, r = m.withColumn("_node", F.coalesce("_days", "_ref", F.xxhash64(F.lit("m"), "seq"))), r.withColumn("_node", F.coalesce("_days", "_named"))
    links = m.where("_ref is not null").select(F.col("_ref").alias("ref"), F.col("_node").alias("node")).unionByName(r.where("_named is not null").select(F.col("_named").alias("ref"), F.col("_node").alias("node")))
    labels = joined_chains(links)
    if labels is None:
        return m.withColumnRenamed("_node", "_chain"), r.withColumnRenamed("_node", "_chain")
    label = lambda df: df.join(labels, F.col("_node") == F.col("node"), "left").withColumn("_chain", F.coalesce("label", "_node"))
    return label(m), label(r)


def _alike(a: dict, b: dict) -> bool:
    x, y = a["_name"], b["_name"]
    return bool(x and y) and (x in y or y in x)


def _fits(a: str, b: str) -> bool:
    """``mask_matches`` of two masks that aren't empty."""
    return all(x == y or "X" in (x, y) for x, y in zip(a[::-1], b[::-1]))


def _digits(mask: str) -> str:
    return "".join(c for c in mask if c in "0123456789")


def _part(new: str, old: str) -> bool:
    return new != "" and new in old and new != old


class _Rows:
    """The rows of one chain, by reference and by where they lie in time."""

    def __init__(self):
        self.by_ref, self.by_slot, self.by_day, self.untimed = (defaultdict(dict) for _ in range(4))

    def _places(self, r: dict) -> Iterator[dict]:
        if r["reference_number"] is not None:
            yield self.by_ref[r["bank"], r["direction"], r["reference_number"].strip(" ")]
        if r["_event"] is not None and r["_day"] is not None:
            yield self.by_day[r["_event"], r["_day"]]
            yield self.untimed[r["_event"], r["_day"]] if r["transaction_time_s"] is None else self.by_slot[r["_event"], _at(r) // WINDOW_S]

    def add(self, r: dict) -> None:
        for place in self._places(r):
            place[r["_id"]] = r

    def change(self, r: dict, values: dict) -> None:
        for place in self._places(r):
            del place[r["_id"]]
        r.update(values)
        self.add(r)

    def timed(self, event: str, at: int, window: int) -> Iterator[dict]:
        """Timed rows within ``window`` of a time, by their dates too."""
        days = range((at - window) // _DAY, (at + window) // _DAY + 1)
        for slot in range((at - window) // WINDOW_S, (at + window) // WINDOW_S + 1):
            yield from (r for r in self.by_slot.get((event, slot), {}).values() if r["_day"] in days and abs(at - _at(r)) <= window)


def _at(r: dict) -> int:
    return r["_day"] * _DAY + r["transaction_time_s"]


def _by_reference(m: dict, rows: _Rows) -> tuple | None:
    ref = (m["reference_number"] or "").strip(" ")
    hits = list(rows.by_ref.get((m["bank"], m["direction"], ref), {}).values()) if ref and None not in (m["bank"], m["direction"]) else []
    if not hits:
        return None
    off = lambda c: None not in (m[c], hits[0][c]) and m[c] != hits[0][c]
    reason = "multiple_candidates" if len(hits) > 1 else "reference_amount_mismatch" if off("amount") else "reference_balance_mismatch" if off("balance") else None
    return ("reference", "defer", None, reason) if reason else ("reference", "match", hits[0], None)


def _tier(m: dict, r: dict, told: bool) -> int:
    if _alike(m, r):
        return 3
    if told and m["identifies_by"] == r["identifies_by"] == "card_mask" and m["_card"] and r["_card"] and m["_card"][-1] == r["_card"][-1] and _fits(m["_card"], r["_card"]):
        return 2
    return int(told and m["identifies_by"] == r["identifies_by"] == "none")


def _candidates(m: dict, rows: _Rows, told: bool) -> list[dict]:
    """As ``matching.fuzzy_candidates``."""
    event, day = m["_event"], m["_day"]
    if m["transaction_time_s"] is None:
        near = list(rows.by_day.get((event, day), {}).values())
    else:
        at, own = _at(m), RECEIVED_WINDOW_S if m["received_time"] else WINDOW_S
        near = [r for r in rows.timed(event, at, own) if not r["received_time"] or abs(at - _at(r)) <= RECEIVED_WINDOW_S]
        near += [r for d in range((at - own) // _DAY, (at + own) // _DAY + 1) for r in rows.untimed.get((event, d), {}).values()]
    near = [r for r in near if not m["_mask"] or not r["_mask"] or _fits(m["_mask"], r["_mask"])]
    if m["transaction_time_s"] is None or any(r["transaction_time_s"] is None for r in near):
        tiers = [_tier(m, r, told) for r in near]
        best = max(tiers, default=0)
        return [r for r, tier in zip(near, tiers) if tier == best > 0]
    return [r for r in near if _alike(m, r)] or near if len(near) > 1 else near


def _decided(m: dict, near: list[dict]) -> tuple:
    """As ``matching.decide`` where a message without a balance needs a row that no message of its channel has."""
    left = [r for r in near if None in (m["_rounded"], r["_rounded"]) or m["_rounded"] == r["_rounded"]]
    if not left:
        return "fuzzy", "insert", None, None
    if m["balance"] is not None:
        equal = [r for r in left if r["balance"] is not None]
        return ("fuzzy", "match", equal[0], None) if len(equal) == 1 else ("fuzzy", "defer", None, "balance_ambiguous")
    if len(left) > 1:
        return "fuzzy", "defer", None, "multiple_candidates"
    is_open = left[0]["source"] not in ("sms+email", _channel(m))
    return ("fuzzy", "match", left[0], None) if left[0]["balance"] is None and is_open else ("fuzzy", "defer", None, "source_slot_filled")


def _other_half(m: dict, rows: _Rows, types: list[str]) -> tuple | None:
    """As ``matching.other_half``."""
    late = m["transaction_time_s"] >= _HALF_DAY
    hours = range(1, 12) if late else (12,)
    found = [r for r in rows.timed(m["_event"], _at(m) + (-_HALF_DAY if late else _HALF_DAY), WINDOW_S) if r["email_type"] in types and r["transaction_time_s"] // 3600 in hours and _alike(m, r)]
    if len(found) != 1:
        return None
    if None not in (m["balance"], found[0]["balance"]) and m["balance"] != found[0]["balance"]:
        return "other_half", "insert", None, "alias_balance_mismatch"
    return "other_half", "match", found[0], None


def _match(m: dict, rows: _Rows, types: list[str], told: bool) -> tuple:
    """(path, action, row, reason) of a message, as ``matching.find_matches``."""
    found = _by_reference(m, rows)
    if found is None and m["_event"] is not None and m["_day"] is not None:
        near = _candidates(m, rows, told)
        found = _decided(m, near) if near else _other_half(m, rows, types) if m["transaction_time_s"] is not None else None
    return found or ("none", "insert", None, None)


def _channel(m: dict) -> str:
    return "email" if m["by_email"] else "sms"


def _taken(m: dict, r: dict, fields: list[str]) -> list[str]:
    """The fields that a row takes from a message, as ``matching.changes``."""
    out = []
    for f in fields:
        old, new = (x["_day" if f == "transaction_date" else f] for x in (r, m))
        if new is None or (old is not None and (not m["by_email"] or old == new)):
            continue
        keep = False
        if old is None:
            pass
        elif f in ("card_mask", "account_mask"):
            a, b = _digits(old), _digits(new)
            keep = a == b or (len(b) < len(a) and a.endswith(b))
        elif f == "counterparty":
            keep = _part(m["_name"], r["_name"])
        elif f == "raw_description":
            keep = _part(new.strip(" "), old.strip(" "))
        elif f == "transaction_date":
            keep = new > old
        elif f == "transaction_time_s":
            day, was = (x["_day"] if x["_day"] is not None else y["_day"] for x, y in ((m, r), (r, m)))
            keep = day is None or day * _DAY + new >= was * _DAY + old
        if not keep:
            out.append(f)
    return out


#: What is made of a field and goes with it.
_MADE = {"counterparty": "_name", "account_mask": "_mask", "card_mask": "_card", "balance": "_rounded", "transaction_date": "_day"}


def _apply(m: dict, found: tuple, rows: _Rows, fields: list[str]) -> list[str]:
    """Changes or adds the row of a decision."""
    _, action, r, _ = found
    if action == "insert":
        rows.add(m | {"source": _channel(m)})
    if action != "match":
        return []
    taken = _taken(m, r, fields)
    values = {f: m[f] for f in taken if f in m} | {_MADE[f]: m[_MADE[f]] for f in taken if f in _MADE}
    if "transaction_time_s" in taken:
        values["received_time"] = bool(m["received_time"])
    if r["source"] not in (None, _channel(m)):
        values["source"] = "sms+email"
    rows.change(r, values)
    return taken


_FOUND = pa.schema([("seq", pa.int64()), ("round", pa.int32()), ("path", pa.string()), ("action", pa.string()), ("id", pa.int64()), ("reason", pa.string()), ("taken", pa.list_(pa.string()))])


def _folded(sorted_rows: DataFrame, types: list[str], fields: list[str], told: bool) -> DataFrame:
    """Decisions with what was ``taken``; of each chain come its rows (seq is null), then its messages in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, rows, n = None, _Rows(), 0
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["_chain"] != chain:
                    chain, rows, n = x["_chain"], _Rows(), 0
                if x["seq"] is None:
                    rows.add(x)
                    continue
                found = _match(x, rows, types, told)
                path, action, r, reason = found
                own = x["_id"] if action == "insert" else r["_id"] if r else None
                out.append((x["seq"], n, path, action, own, reason, _apply(x, found, rows, fields)))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], _FOUND.field(k).type) for k in range(len(_FOUND))], schema=_FOUND)

    return sorted_rows.mapInArrow(run, "seq bigint, round int, path string, action string, id bigint, reason string, taken array<string>")


def _after(incoming: DataFrame, stored: DataFrame, found: DataFrame, fields: list[str], new_id: Column) -> DataFrame:
    """The rows after the batch: what each took last, and one for each insert."""
    kinds = dict(stored.dtypes)
    channel = F.when(F.col("by_email"), "email").otherwise("sms")
    made = incoming.join(found.where("action = 'insert'").select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left_semi").withColumns({"id": new_id, "source": channel})
    cast = lambda df: [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns]
    base = stored.withColumn("seq", F.lit(None).cast("bigint")).unionByName(made.select(*cast(made), "seq"))
    met = found.where("action = 'match'").select(F.col("id").alias("_m"), F.col("seq").alias("_s"), "taken").join(incoming, F.col("_s") == F.col("seq"))
    when = lambda f: F.when(F.array_contains("taken", f), F.col("seq"))
    last = met.groupBy("_m").agg(
        *[F.max_by(F.col(f), when(f)).alias(f"_new_{f}") for f in fields], F.max_by(F.coalesce("received_time", F.lit(False)), when("transaction_time_s")).alias("_received"), F.bool_or(channel == "email").alias("_by_email"), F.bool_or(channel == "sms").alias("_by_sms"))
    other = (F.col("_by_email") & (F.col("source") != "email")) | (F.col("_by_sms") & (F.col("source") != "sms"))
    value = {f: F.coalesce(F.col(f"_new_{f}").cast(kinds[f]), F.col(f)) for f in fields} | {"source": F.when(other, "sms+email").otherwise(F.col("source")), "received_time": F.coalesce(F.col("_received"), F.col("received_time"))}
    return base.join(last, F.col("id") == F.col("_m"), "left").select(*[value.get(c, F.col(c)).alias(c) for c in stored.columns], "seq")


def merge_batch(incoming: DataFrame, stored: DataFrame, types: list[str] | None = None) -> Merged:
    """Merges the messages (distinct ``seq``) one after the other; ``stored`` has a source (sms, email or sms+email).

    A message without a balance meets a row without one only if no message of its channel has that row."""
    spark = incoming.sparkSession
    top = stored.agg(F.max("id")).first()[0] or 0
    low = incoming.agg(F.min("seq")).first()[0] or 0
    new_id = (F.lit(top + 1) + F.col("seq") - F.lit(low)).cast("bigint")
    fields = [f for f in FIELDS if f in incoming.columns and f in stored.columns]
    told = "identifies_by" in incoming.columns and "identifies_by" in stored.columns
    keep = ["bank", "direction", "amount", "currency", "transaction_date", "transaction_time_s", "received_time", "counterparty", "account_mask", "reference_number", "balance", "email_type", "source", "by_email", *fields, *(["identifies_by", "card_mask"] if told else [])]
    has = lambda df: [(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in dict.fromkeys(keep)]
    m, r = chains(incoming.select("seq", new_id.alias("_id"), *has(incoming)), stored.select(F.lit(None).cast("bigint").alias("seq"), F.col("id").alias("_id"), *has(stored)))
    named = ["_chain", "seq", "_id", "_event", *dict.fromkeys(keep)]
    card = normalize_mask(F.col("card_mask")) if told else F.lit(None).cast("string")
    both = r.select(named).unionByName(m.select(named)).withColumns(
        {"_day": _day(), "_name": normalize_counterparty(F.col("counterparty")), "_mask": normalize_mask(F.col("account_mask")), "_card": F.when(trailing_digits(card) > 0, card), "_rounded": F.bround("balance", 2)})
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = _folded(both.drop("transaction_date").repartition(n, "_chain").sortWithinPartitions("_chain", "seq"), TWELVE_HOUR_TYPES if types is None else types, fields, told)
    return Merged(found.drop("taken"), _after(incoming, stored, found, fields, new_id))
