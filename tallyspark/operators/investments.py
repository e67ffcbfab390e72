"""Investment lots: classification of raw transactions, canonical lots over overlapping uploads, disposals, positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import paise
from tallyspark.functions.vocabulary import ACQUISITIONS, DISPOSALS


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))  # the text, which is an expression, is made once and not once a word


def classify(raw: DataFrame) -> DataFrame:
    """Raw rows with instrument, kind and the reason that keeps one from being a lot (null: a complete lot)."""
    kind = F.lower(F.trim(F.coalesce("transaction_type", F.lit(""))))
    isin = F.nullif(F.upper(F.trim(F.coalesce("isin", F.lit("")))), F.lit(""))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    missing = ~positive("units") | ~positive("nav") | ~positive("amount") | F.col("acquired_on").isNull() | isin.isNull()
    off = F.abs(F.col("units").cast("decimal(18,4)") * F.col("nav").cast("decimal(18,4)") - F.col("amount")) >= F.lit(0.01).cast("decimal(4,2)")
    reason = F.when(F.lower(F.coalesce("scope", F.lit(""))) != "mf", "not_mutual_fund").when(_any(kind, DISPOSALS), "disposal_transaction").when(
        ~_any(kind, ACQUISITIONS), "ambiguous_transaction_type").when(missing, "missing_lot_facts").when(off, "cost_basis_inconsistent")
    return raw.withColumn("instrument", isin).withColumn("kind", kind).withColumn("reason", reason)


BASE = ["instrument", "source_ref", "acquired_on", "units", "nav", "kind", "reference"]


def numbered_lots(classified: DataFrame) -> DataFrame:
    """Complete lots with their number among equal ones of their upload."""
    # by hash first: most comparisons of the sort end there, not at texts and wide decimals
    w = Window.partitionBy(F.xxhash64(*BASE, "upload_id"), *BASE, "upload_id").orderBy("raw_id")
    return classified.where("reason is null").withColumn("occurrence", F.row_number().over(w) - 1)


def canonical_lots(classified: DataFrame) -> DataFrame:
    """Lots over overlapping uploads: of equal lots, as many as the upload with the most has; the uploads that show each.

    Equal lots of an upload are counted first; the lots of rank k are those of the uploads that have more than k."""
    counts = classified.where("reason is null").groupBy(*BASE, "upload_id").agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.select(*BASE, "upload_id", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("occurrence"))
    return ranks.groupBy(*BASE, "occurrence").agg(F.min("upload_id").alias("first_upload"), F.count(F.lit(1)).cast("bigint").alias("uploads"))


def canonical_lots_with_sources(classified: DataFrame) -> DataFrame:
    """``canonical_lots`` with the ids of all uploads that show each lot, ascending."""
    counts = classified.where("reason is null").groupBy(*BASE, "upload_id").agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.select(*BASE, "upload_id", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("occurrence"))
    return ranks.groupBy(*BASE, "occurrence").agg(F.array_sort(F.collect_list("upload_id")).alias("sources"))


def in_order(lots: DataFrame) -> DataFrame:
    """Canonical lots under one total order."""
    return lots.orderBy(*[F.asc_nulls_last(c) for c in [*BASE, "occurrence"]])


def canonical_raw(raw: DataFrame) -> DataFrame:
    """Raw transactions over overlapping uploads by fingerprint (SHA-256 of what identifies them): as many as the upload with
    the most has, and the first upload that shows one."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    parts = [F.coalesce(F.upper(F.trim("isin")), F.lit("")), F.coalesce("source_ref", F.lit("")), F.col("acquired_on").cast("string"), whole("units"), whole("nav"), F.lower(F.trim(F.coalesce("transaction_type", F.lit("")))), F.coalesce("reference", F.lit(""))]
    each = raw.groupBy(F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"), "upload_id").agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    return each.groupBy("fingerprint").agg(F.max("_n").alias("copies"), F.min("upload_id").alias("first_upload"))


def extracted_lots(documents: DataFrame, key: str) -> DataFrame:
    """Lots of nested documents (folios, schemes, transactions) with a number among those of one source, instrument and day in
    the order of the document; schemes without an instrument are left out."""
    f = documents.select(key, F.posexplode("folios").alias("_p", "f")).select(key, "_p", F.col("f.source_ref").alias("source_ref"), F.posexplode("f.schemes").alias("_q", "s"))
    rows = f.where("trim(coalesce(s.isin, '')) <> ''").select(key, "_p", "_q", "source_ref", F.upper(F.trim("s.isin")).alias("instrument"), F.posexplode("s.transactions").alias("_r", "t"))
    own = rows.select(key, "_p", "_q", "_r", "source_ref", "instrument", F.try_to_date("t.date", "yyyy-MM-dd").alias("acquired_on"), F.col("t.units").try_cast("decimal(20,6)").alias("units"))
    n = F.row_number().over(Window.partitionBy(key, "source_ref", "instrument", "acquired_on").orderBy("_p", "_q", "_r"))
    return own.withColumn("occurrence", (n - 1).cast("bigint")).select(key, "source_ref", "instrument", "acquired_on", "occurrence", "units")


def latest_portfolios(uploads: DataFrame) -> DataFrame:
    """The newest upload of each portfolio (keys compare trimmed and in capitals) by date and id."""
    rest = [c for c in uploads.columns]
    g = uploads.groupBy(F.upper(F.trim("portfolio_key")).alias("_k")).agg(F.max_by(F.struct(*rest), F.struct("statement_date", "id")).alias("u"))
    return g.select("u.*")


def current_valuations(uploads: DataFrame, schema: str) -> DataFrame:
    """The newest upload of each portfolio with its payload decoded; one that doesn't parse stays null, older ones don't step in."""
    return latest_portfolios(uploads).select("portfolio_key", F.col("id").alias("upload_id"), F.when(F.trim("payload").rlike(r"^\{.*\}$"), F.from_json("payload", schema)).alias("payload"))


def latest_values(valuations: DataFrame) -> DataFrame:
    """The value of each instrument, summed over the newest upload of every portfolio; those without a value are absent."""
    newest = latest_portfolios(valuations.select("id", "portfolio_key", "statement_date")).select(F.col("id").alias("_i"))
    return valuations.join(newest, F.col("id") == F.col("_i"), "left_semi").where("value is not null").groupBy("instrument").agg(F.sum("value").alias("value"))


def classes(holdings: DataFrame) -> DataFrame:
    """The asset class of each instrument: its only one, else other."""
    return holdings.groupBy("instrument").agg(F.when(F.countDistinct("asset_class") == 1, F.max("asset_class")).otherwise("other").alias("asset_class"), F.count(F.lit(1)).cast("bigint").alias("n"))


def with_uploads(lots: DataFrame, uploads: DataFrame) -> DataFrame:
    """Lots with the portfolio of their upload; those of unknown uploads are left out."""
    return lots.join(uploads.select(F.col("id").alias("_u"), "portfolio_key"), F.col("upload_id") == F.col("_u")).drop("_u")


def lot_totals(lots: DataFrame) -> DataFrame:
    cost = F.col("units").cast("decimal(18,4)") * F.col("nav").cast("decimal(18,4)")
    return lots.groupBy("instrument").agg(F.count(F.lit(1)).cast("bigint").alias("lots"), F.sum("units").cast("bigint").alias("units"), paise(F.sum(cost)).alias("cost_paise"))


_LOT = "struct<lot:bigint,units:decimal(20,6),reference:string>"
_OPEN = f"struct<lots:array<{_LOT}>,resolved:boolean,taken:bigint>"


def _step(state: Column, e: Column) -> Column:
    """A lot joins the open ones; a disposal takes from the one with its reference, or from the only one with enough left."""
    able = F.filter(state["lots"], lambda x: F.coalesce((x["units"] >= e["units"]) & (e["units"] > 0), F.lit(False)))
    named = F.filter(able, lambda x: F.coalesce(x["reference"] == e["reference"], F.lit(False)))
    pick = F.when(F.size(named) == 1, F.get(named, 0)["lot"]).when(F.size(able) == 1, F.get(able, 0)["lot"])
    opened = F.struct(F.concat(state["lots"], F.array(F.struct(e["n"], e["units"], e["reference"]).cast(_LOT))), F.lit(True), state["taken"]).cast(_OPEN)
    less = F.transform(state["lots"], lambda x: F.struct(x["lot"], F.when(x["lot"] == pick, x["units"] - e["units"]).otherwise(x["units"]), x["reference"]))
    took = F.struct(less, F.lit(True), state["taken"] + 1).cast(_OPEN)
    took = F.struct(F.filter(took["lots"], lambda x: x["units"] > 0), took["resolved"], took["taken"]).cast(_OPEN)
    lost = F.struct(state["lots"], F.lit(False), state["taken"]).cast(_OPEN)
    return F.when(~state["resolved"], state).when(~e["out"], opened).when(pick.isNotNull(), took).otherwise(lost)


def disposals(classified: DataFrame) -> DataFrame:
    """Units left of each lot after its disposals, by source and instrument: a disposal takes from the lot with its reference or
    from the only one that is old enough and has enough left; otherwise the instrument is unresolved (no guess of an order).

    The events of an instrument are folded in their order, with the open lots as state.  They are cut where nothing is open
    (the running sum of units is back at nothing), so one array holds the events of one such stretch only."""
    events = classified.where("reason is null or reason = 'disposal_transaction'").where("instrument is not null").select("source_ref", "instrument", "acquired_on", "raw_id", F.col("units").cast("decimal(20,6)").alias("units"), "reference", F.coalesce(F.col("reason") == "disposal_transaction", F.lit(False)).alias("out"))
    w = Window.partitionBy("source_ref", "instrument").orderBy(F.col("acquired_on").asc_nulls_last(), "out", "raw_id", "units", "reference")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    signed = F.coalesce(F.when(F.col("out"), -F.col("units")).otherwise(F.col("units")), F.lit(0).cast("decimal(20,6)"))
    cut = events.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("_before", F.coalesce(F.sum(signed).over(so_far), F.lit(0)))
    cut = cut.withColumn("stretch", F.sum((F.col("_before") == 0).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = cut.groupBy("source_ref", "instrument", "stretch").agg(F.array_sort(F.collect_list(F.struct("n", "out", "units", "reference"))).alias("events"))
    none = F.struct(F.array(), F.lit(True), F.lit(0)).cast(_OPEN)
    folded = each.select("source_ref", "instrument", "stretch", F.aggregate("events", none, _step).alias("s"))
    left = F.aggregate(F.col("s.lots"), F.lit(0).cast("decimal(38,6)"), lambda total, x: (total + x["units"]).cast("decimal(38,6)"))
    first_lost = F.min(F.when(~F.col("s.resolved"), F.col("stretch"))).over(Window.partitionBy("source_ref", "instrument"))
    told = folded.select("source_ref", "instrument", "stretch", F.col("s.resolved").alias("resolved"), F.col("s.taken").alias("taken"), left.alias("left"), first_lost.alias("_lost"))
    g = told.groupBy("source_ref", "instrument").agg(F.bool_and("resolved").alias("resolved"), F.sum(F.when(F.col("_lost").isNull() | (F.col("stretch") <= F.col("_lost")), F.col("taken")).otherwise(0)).alias("disposals"), F.sum("left").alias("_left"))
    return g.select("source_ref", "instrument", "resolved", "disposals", F.when(F.col("resolved"), F.col("_left").cast("decimal(20,6)")).alias("units_left"))


def disposals_by_portfolio(classified: DataFrame, uploads: DataFrame) -> DataFrame:
    """``disposals`` within each portfolio: raw rows of its uploads, equal ones of several uploads once."""
    own = classified.join(uploads.select(F.col("id").alias("_u"), "portfolio_key"), F.col("upload_id") == F.col("_u"))
    n = F.row_number().over(Window.partitionBy("portfolio_key", "upload_id", *BASE, "reason").orderBy("raw_id"))
    once = own.withColumn("_n", n).groupBy("portfolio_key", *BASE, "reason", "_n").agg(F.min("raw_id").alias("raw_id"))
    keyed = once.withColumn("source_ref", F.to_json(F.struct("portfolio_key", "source_ref")))
    out = disposals(keyed)
    return out.select(F.get_json_object("source_ref", "$.portfolio_key").alias("portfolio_key"), F.get_json_object("source_ref", "$.source_ref").alias("source_ref"), "instrument", "resolved", "disposals", "units_left")


def positions(valuations: DataFrame, lots: DataFrame) -> DataFrame:
    """Instruments that either side knows: quantity and price (only where it is one), lots and cost."""
    v = valuations.groupBy(F.col("instrument").alias("_v")).agg(F.sum("units").cast("bigint").alias("quantity"), F.when(F.countDistinct("nav") == 1, F.max("nav")).cast("bigint").alias("unit_price"))
    return v.join(lot_totals(lots), F.col("_v") == F.col("instrument"), "full_outer").select(F.coalesce("_v", "instrument").alias("instrument"), "quantity", "unit_price", "lots", "cost_paise")
