"""Message sources and sinks: folders of mail files, JSON documents, CSV review files and keyed tables."""

from __future__ import annotations

import email
import email.message
import email.policy
import email.utils
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.expressions import is_small, local_time
from tallyspark.operators.substrings import containing

MAIL = "message_id string, sender string, subject string, received_at timestamp, body string, attachments array<string>"


def mail_folder(spark: SparkSession, path: str) -> DataFrame:
    """``*.eml`` files below a folder: bank (the folder's name) and what ``parsed_mail`` gives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parsed_mail(files).withColumn("bank", F.element_at(F.split("path", "/"), -2))


def parsed_mail(files: DataFrame) -> DataFrame:
    """Mail files (path, content) with header fields, the HTML body or else the text, and attachment names.

    No file ends the job: one that is no mail gives a row of nulls with its path, a header that can't be read is null, and text
    under an unknown character set is read as UTF-8 with marks for what isn't."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, raw in zip(f["path"], f["content"]):
                m = _message(raw)
                body = None if m is None else _body(m)
                names = None if m is None else [name for name, _, _ in _attachments(m)]
                out.append((path, _header(m, "Message-ID"), _header(m, "From"), _header(m, "Subject"), _sent_at(m), body, names))
            yield pd.DataFrame(out, columns=["path", "message_id", "sender", "subject", "received_at", "body", "attachments"]).astype({"received_at": "datetime64[ns]"})

    return _dealt(files).mapInPandas(parse, "path string, " + MAIL)


def mail_attachments(files: DataFrame) -> DataFrame:
    """(path, part, name, content_type, size, content) of every attachment of mail files, also of those of messages inside
    messages, numbered in their order; a file that is no mail and a mail without attachments give none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, held = [], 0
            for path, raw in zip(f["path"], f["content"]):
                m = _message(raw)
                for i, (name, kind, data) in enumerate([] if m is None else _attachments(m)):
                    out.append((path, i, name, kind, len(data), data))
                    held += len(data)
                if held > FRAME_BYTES:  # attachments can be large
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    columns = ["path", "part", "name", "content_type", "size", "content"]
    return _dealt(files).mapInPandas(parse, "path string, part int, name string, content_type string, size long, content binary")


#: Attachments that a task holds before it passes them on.
FRAME_BYTES = 4 << 20


def _dealt(files: DataFrame) -> DataFrame:
    """(path, content) of mail files dealt evenly over tasks: reading a mail costs far more than its bytes, and few splits of a table
    can hold very many mails."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select("path", "content").repartition(n, "path")


class _Policy(email.policy.EmailPolicy):
    """The default policy that keeps the last headers it has read: a part's are asked for several times, and mails of one sender
    have many alike."""

    def header_fetch_parse(self, name, value):
        return value if hasattr(value, "name") else (_read_header if len(value) <= 500 else _read_header.__wrapped__)(name, value)


@functools.lru_cache(maxsize=4096)
def _read_header(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


_POLICY = _Policy()


def _message(raw: bytes | None) -> email.message.EmailMessage | None:
    """A mail, or None where the bytes have no header of one."""
    if not raw:
        return None
    m = email.message_from_bytes(raw, policy=_POLICY)
    return m if m.keys() else None


_ATOMS = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*"
#: Header values that stand for themselves, for which the parser of headers isn't needed.
_PLAIN = {"From": re.compile(_ATOMS), "Message-ID": re.compile(f"<{_ATOMS}>"), "Subject": re.compile(r"(?!.*=\?)[!-~]+(?: [!-~]+)*")}


def _header(m: email.message.EmailMessage | None, name: str) -> str | None:
    try:
        plain = _PLAIN.get(name)
        raw = None if m is None or plain is None else next((v for k, v in m.raw_items() if k.lower() == name.lower()), None)
        if isinstance(raw, str) and plain.fullmatch(raw):
            return raw
        value = None if m is None else m[name]
        return None if value is None else str(value).encode("utf-8", "replace").decode()
    except Exception:  # noqa: BLE001  (the parser of a header that is none fails in many ways)
        return None


def _sent_at(m: email.message.EmailMessage | None) -> pd.Timestamp | None:
    try:
        at = pd.Timestamp(email.utils.parsedate_to_datetime(_header(m, "Date") or ""))
        return at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at
    except (TypeError, ValueError, OverflowError):
        return None


def _payload(part: email.message.EmailMessage) -> bytes:
    try:
        return part.get_payload(decode=True) or b""
    except Exception:  # noqa: BLE001  (a broken transfer encoding)
        return str(part.get_payload()).encode("utf-8", "replace")


def _body(m: email.message.EmailMessage) -> str | None:
    """The first HTML part that is no attachment, else the first plain one."""
    texts = {}
    for part in m.walk():
        if not part.is_multipart() and part.get_content_type() in ("text/html", "text/plain") and not _named(part):
            texts.setdefault(part.get_content_type(), part)
    part = texts.get("text/html", texts.get("text/plain"))
    if part is None:
        return None
    raw = _payload(part)
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except (LookupError, ValueError):
        return raw.decode("utf-8", "replace")


def _named(part: email.message.EmailMessage) -> bool:
    return part.get_content_disposition() == "attachment" or part.get_filename() is not None


def _attachments(m: email.message.EmailMessage) -> list[tuple[str, str, bytes]]:
    return [((p.get_filename() or "").encode("utf-8", "replace").decode(), p.get_content_type(), _payload(p)) for p in m.walk() if not p.is_multipart() and _named(p)]


def statement_attachment(names: Column, skip: list[str]) -> Column:
    """The first PDF among attachment names with none of the ``skip`` words in it; null where there is none."""
    fits = F.filter(names, lambda n: F.lower(n).endswith(".pdf") & ~F.lower(n).rlike("|".join(skip) if skip else "$^"))
    return F.get(fits, 0)


def typed_settings(settings: DataFrame) -> DataFrame:
    """Settings with their value as text, number, flag and list of JSON, each null where it isn't one."""
    v = F.trim("value")
    flag = F.when(F.lower(v).isin("1", "true", "yes", "on"), True).when(v.isNotNull(), False)
    return settings.select("key", v.alias("text"), v.try_cast("bigint").alias("number"), flag.alias("flag"), F.when(v.startswith("["), F.from_json(v, "array<string>")).alias("items"))


def json_objects(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """``df`` with ``column`` decoded; text that is no JSON object is null, never an error."""
    text = F.col(column)
    return df.withColumn(column, F.when(F.trim(text).startswith("{"), F.from_json(text, schema, {"mode": "PERMISSIVE"})))


def amounts_of_map(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, name, amount) of a JSON object of amounts; a value that is no number counts as 0."""
    entries = F.explode(F.map_entries(F.from_json(column, "map<string,string>")))
    return df.select(key, entries.alias("e")).select(key, F.col("e.key").alias("name"), F.coalesce(F.col("e.value").try_cast("decimal(16,2)"), F.lit(0).cast("decimal(16,2)")).alias("amount"))


def dated_by_arrival(told: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Parsed messages with date and time (seconds of the day) taken from their arrival, in local time, where the text has none;
    ``received_time`` says whether the time is of that kind."""
    local = local_time(F.col("received_at"), zone)
    seconds = (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("bigint")
    return told.withColumn("received_time", F.col("time_s").isNull()).withColumn("date", F.coalesce("date", local.cast("date"))).withColumn("time_s", F.coalesce("time_s", seconds))


def since(last_synced: Column, first_days: int = 90, again_days: int = 2, today: Column | None = None) -> Column:
    """Where a source reads from: a little before the cursor, or far enough back for the first time."""
    return F.coalesce(F.date_sub(last_synced, again_days), F.date_sub(F.current_date() if today is None else today, first_days))


def unseen(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """New messages: not stored, and once each."""
    return incoming.dropDuplicates([key]).join(stored.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def rules_for(messages: DataFrame, rules: DataFrame, few: int = 1_000) -> DataFrame:
    """(message id, rule id) where the rule's sender and subject stand in the message's; an empty field fits all.  Up to ``few``
    rules are sent to all tasks; more are found by an index of the q-grams of their sender, or of their subject where that is empty.
    A rule with neither fits every message."""
    if is_small(rules, few):
        m, r = messages.alias("m"), F.broadcast(rules).alias("r")
        fits = lambda rule, text: (F.coalesce(F.trim(rule), F.lit("")) == "") | F.lower(text).contains(F.lower(F.trim(rule)))
        return m.join(r, fits(F.col("r.sender"), F.col("m.sender")) & fits(F.col("r.subject"), F.col("m.subject"))).select(F.col("m.id").alias("message_id"), F.col("r.id").alias("rule_id"))
    bare = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    m = messages.select(F.col("id").alias("message_id"), F.lower("sender").alias("from"), F.lower("subject").alias("about"))
    r = rules.select(F.col("id").alias("rule_id"), bare("sender").alias("by"), bare("subject").alias("on"))
    found = containing(m, "from", r.where("by <> ''"), "by").where((F.col("on") == "") | F.col("about").contains(F.col("on")))
    named = containing(m, "about", r.where("by = '' and on <> ''"), "on")
    every = m.join(r.where("by = '' and on = ''"), F.lit(True))
    return found.select("message_id", "rule_id").unionByName(named.select("message_id", "rule_id")).unionByName(every.select("message_id", "rule_id"))


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows with the newest change of each key in their place."""
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc())
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Groups of ``keys`` that arrive take the stored group's place unless the stored one has a higher ``rank``."""
    best = stored.select(*keys, rank).unionByName(incoming.select(*keys, rank)).groupBy(*keys).agg(F.max(rank).alias("_best"))
    keep = stored.join(best, keys).where(F.col(rank) == F.col("_best")).drop("_best")
    new = incoming.join(best, keys).where(F.col(rank) == F.col("_best")).drop("_best")
    return keep.join(new.select(*keys).distinct(), keys, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def review_rows(txns: DataFrame) -> DataFrame:
    """Rows for review as text, '' for null, as a CSV file holds them."""
    return txns.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "transaction_date", "direction", "amount", "counterparty", "category")])


def reviewed(rows: DataFrame, txns: DataFrame, slugs: list[str]) -> DataFrame:
    """Status of reviewed rows: blank (left alone), missing, mismatch (another amount, date or direction), unknown category or applied."""
    t = txns.select(F.col("id").cast("string").alias("_id"), F.col("amount").cast("string").alias("_a"), F.coalesce(F.col("transaction_date").cast("string"), F.lit("")).alias("_d"), F.col("direction").alias("_r"))
    hit = rows.join(t, F.col("id") == F.col("_id"), "left")
    status = F.when(F.trim("category") == "", "blank").when(F.col("_id").isNull(), "missing").when((F.col("amount") != F.col("_a")) | (F.col("transaction_date") != F.col("_d")) | (F.col("direction") != F.col("_r")), "mismatch").when(~F.col("category").isin(slugs), "unknown_category").otherwise("applied")
    return hit.select("id", "category", status.alias("status"))
