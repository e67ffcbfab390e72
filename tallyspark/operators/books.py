"""The ledger beyond single rows: rates, paired transfers, card payments, valuations, names, checks, metadata and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import paise
from tallyspark.functions.formatting import sanitized_meta
from tallyspark.operators.ledger import account_name, normalized_commodity

# Roots of account names, and the keys of an entry's metadata in their order.
ROOTS = ["Assets", "Equity", "Expenses", "Income", "Liabilities"]
META_KEYS = ["dashboard_txn_ids", "dashboard_kind", "dashboard_category", "dashboard_source", "dashboard_channel", "dashboard_email_type", "dashboard_account_ids", "dashboard_card_ids", "dashboard_reference"]


def parsed_rates(config: DataFrame, column: str = "value") -> DataFrame:
    """(currency, date, rate) of a JSON object of lists of {date, rate}: upper-case currencies, positive rates at four places;
    entries that don't parse, or round to nothing, are left out."""
    lists = config.select(F.explode(F.map_entries(F.from_json(column, "map<string,array<struct<date:string,rate:string>>>"))).alias("e"))
    rows = lists.select(F.upper(F.trim("e.key")).alias("currency"), F.explode("e.value").alias("r"))
    rate = F.bround(F.col("r.rate").try_cast("decimal(28,10)"), 4).cast("decimal(18,4)")
    out = rows.select("currency", F.try_to_date("r.date", "yyyy-MM-dd").alias("date"), rate.alias("rate"))
    return out.where("currency <> '' and date is not null and rate > 0")


# ---- transfers and card payments


def transfer_entries(rows: DataFrame) -> DataFrame:
    """One entry for each pair of self-transfer rows that can be posted: the same reference, one debit and one credit of equal
    amount and currency on known accounts; dated at the earlier row."""
    own = rows.where((F.col("category") == "self_transfer") & F.col("reason").isNull() & (F.trim(F.coalesce("reference_number", F.lit(""))) != ""))
    side = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    g = own.groupBy(F.trim("reference_number").alias("reference")).agg(
        F.count_if(F.col("direction") == "debit").alias("_d"), F.count(F.lit(1)).alias("_n"), F.min("amount").alias("_lo"), F.max("amount").alias("amount"), F.min("commodity").alias("_c"), F.max("commodity").alias("commodity"),
        F.min("transaction_date").alias("date"), side("debit", "id").alias("debit_id"), side("credit", "id").alias("credit_id"), side("debit", "own_account").alias("from_account"), side("credit", "own_account").alias("to_account"))
    pair = g.where((F.col("_n") == 2) & (F.col("_d") == 1) & F.col("credit_id").isNotNull() & (F.col("_lo") == F.col("amount")) & (F.col("_c") == F.col("commodity")))
    return pair.select("reference", "date", "debit_id", "credit_id", "from_account", "to_account", paise(F.col("amount")).alias("amount_paise"), "commodity")


def skip_reasons(rows: DataFrame) -> DataFrame:
    """(id, reason) of rows that make no entry of their own: what keeps them from being posted, or an unmatched self-transfer."""
    pairs = transfer_entries(rows)
    paired = pairs.select(F.col("debit_id").alias("_paired")).unionByName(pairs.select(F.col("credit_id").alias("_paired")))
    single = rows.where((F.col("category") == "self_transfer") & F.col("reason").isNull()).join(paired, F.col("id") == F.col("_paired"), "left_anti").select("id", F.lit("unmatched_self_transfer").alias("reason"))
    return rows.where("reason is not null").select("id", "reason").unionByName(single)


def payment_liabilities(payments: DataFrame, cards: DataFrame) -> DataFrame:
    """The card account that a bank-side card payment names: that of its card, else of the only card with exactly its mask; a mask
    that several cards have resolves nothing."""
    by_id = cards.select(F.col("id").alias("_c"), F.col("account_id").alias("_by_id"))
    by_mask = cards.where("trim(coalesce(card_mask, '')) <> ''").groupBy(F.trim("card_mask").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), F.max("account_id").alias("_by_mask"))
    j = payments.join(by_id, F.col("card_id") == F.col("_c"), "left").join(by_mask, F.trim("card_mask") == F.col("_m"), "left")
    account = F.coalesce("_by_id", F.when(F.col("_n") == 1, F.col("_by_mask")))
    status = F.when(F.col("_by_id").isNotNull(), "resolved").when(F.col("_n") > 1, "ambiguous_mask").when(F.col("_n") == 1, "resolved").otherwise("unresolved")
    return j.select(*payments.columns, account.alias("liability_id"), status.alias("resolution"))


def payment_postings(rows: DataFrame, cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """Postings of bank-side card payments: the bank's account against the resolved card's, else the clearing account; a credit
    is a payment that comes back."""
    own = rows.where((F.col("category") == "credit_card_payment") & F.col("reason").isNull())
    a = accounts.select(F.col("id").alias("_liable"), account_name(F.col("type"), F.col("bank"), F.col("label")).alias("_name"))
    j = payment_liabilities(own, cards).join(a, F.col("liability_id") == F.col("_liable"), "left")
    sign = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    legs = F.array(F.struct(F.lit(0).alias("leg"), F.coalesce("_name", F.lit("Liabilities:Credit Card")).alias("account"), (-sign).alias("amount")), F.struct(F.lit(1).alias("leg"), F.col("own_account").alias("account"), sign.alias("amount")))
    return j.select("id", "resolution", F.explode(legs).alias("p")).select("id", "resolution", "p.leg", "p.account", paise(F.col("p.amount")).alias("amount_paise"))


def investment_contra(category: Column, direction: Column, contra: Column, mapped: Column) -> Column:
    """The other side of an investment row that nothing maps: purchases stay unallocated, redemptions come out of transfers."""
    own = category.isin("investment", "investment_redemption") & ~mapped
    return F.when(own & (direction == "debit"), "Assets:Investments:Unallocated").when(own, "Equity:Transfers In").otherwise(contra)


# ---- valuations


def valuation_entries(snapshots: DataFrame, cutover: str) -> DataFrame:
    """Entries of each portfolio's value: the newest one up to the cutover as opening (dated there, with the date it was seen),
    then every change after it; nothing for no change.  The newest row of a date counts, a foreign one as nothing."""
    day = F.lit(cutover).cast("date")
    v = snapshots.where("portfolio_key is not null").groupBy("portfolio_key", "as_of_date").agg(F.max_by(F.struct("value", "currency"), "id").alias("s"))
    v = v.select("portfolio_key", "as_of_date", F.when(F.col("s.currency") == "INR", F.col("s.value")).otherwise(F.lit(0)).cast("decimal(16,2)").alias("value"))
    old = v.where(F.col("as_of_date") <= day).groupBy("portfolio_key").agg(F.max_by("value", "as_of_date").alias("value"), F.max("as_of_date").alias("as_of_date"))
    points = old.select("portfolio_key", "as_of_date", "value", F.lit("opening").alias("kind")).unionByName(v.where(F.col("as_of_date") > day).select("portfolio_key", "as_of_date", "value", F.lit("revaluation").alias("kind")))
    delta = F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("portfolio_key").orderBy("as_of_date")), F.lit(0).cast("decimal(16,2)"))
    out = points.withColumn("delta", delta).where("delta <> 0")
    return out.select("portfolio_key", "kind", F.when(F.col("kind") == "opening", day).otherwise(F.col("as_of_date")).alias("date"), "as_of_date", paise(F.col("delta")).alias("delta_paise"))


def uncovered_uploads(uploads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Uploads without a balance under the name shown for them; names that several share get a number each."""
    bare = uploads.join(snapshots.where("cas_upload_id is not null").select(F.col("cas_upload_id").alias("_u")), F.col("id") == F.col("_u"), "left_anti")
    w = Window.partitionBy("portfolio_key")
    n = F.row_number().over(w.orderBy("id"))
    return bare.select(F.col("id").alias("upload_id"), F.when(F.count(F.lit(1)).over(w) == 1, F.col("portfolio_key")).otherwise(F.concat_ws(" #", "portfolio_key", n.cast("string"))).alias("shown"))


def unknown_ids(selected: DataFrame, accounts: DataFrame) -> DataFrame:
    """Selected account ids that no account has."""
    return selected.distinct().join(accounts.select(F.col("id").alias("_a")), F.col("account_id") == F.col("_a"), "left_anti")


# ---- names, checks and texts


def beancount_name(name: Column) -> Column:
    """A default account name made legal: the root as it is, every other part its words joined, each with a capital; null where
    a part has no letters or digits, starts with a digit, or the root is unknown."""
    parts = F.split(name, ":")
    words = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), words)
    fine = F.get(parts, 0).isin(ROOTS) & (F.size(parts) >= 2) & F.forall(rest, lambda p: p.rlike("^[A-Z][A-Za-z0-9]*$"))
    return F.when(fine, F.concat_ws(":", F.array(F.get(parts, 0)), rest))


def legal_beancount_name(name: Column) -> Column:
    """Whether a name can be used as it is: a known root and parts of letters and digits that start with a capital."""
    return F.coalesce(name.rlike("^(" + "|".join(ROOTS) + ")(:[A-Z][A-Za-z0-9]*)+$"), F.lit(False))


def legal_ledger_name(name: Column) -> Column:
    """Whether a name can stand in a ledger file: two parts at least, none empty, no syntax characters, no two spaces in a row."""
    return F.coalesce(name.rlike(r"^[^:]+(:[^:]+)+$") & ~name.rlike(r"[;\n\r\t{}]|  "), F.lit(False))


def unbalanced(posted: DataFrame) -> DataFrame:
    """(id, commodity, off_paise) of entries that don't add up to nothing."""
    return posted.groupBy("id", "commodity").agg(F.sum("amount_paise").cast("bigint").alias("off_paise")).where("off_paise <> 0")


def metadata(kind: str) -> Column:
    """The entry's metadata as ``key: value`` lines in their order; the reference only where there is one."""
    clean = lambda c: F.coalesce(F.nullif(sanitized_meta(F.col(c)), F.lit("")), F.lit("unknown"))
    slug = F.coalesce(F.nullif(F.lower(F.trim(F.coalesce("category", F.lit("")))), F.lit("")), F.lit("unknown"))
    ref = sanitized_meta(F.col("reference_number"))
    values = [F.concat(F.lit("txn-"), F.col("id").cast("string")), F.lit(kind), slug, clean("source"), clean("channel"), clean("email_type"), F.coalesce(F.col("account_id").cast("string"), F.lit("none")), F.lit("none"), F.nullif(ref, F.lit(""))]
    return F.concat_ws("\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in zip(META_KEYS, values, strict=True)])


def commodity_token(c: Column) -> Column:
    """A commodity as ledger files write it: letters alone bare, others in quotes; null where nothing valid is left."""
    symbol = F.when(F.coalesce(F.trim(c), F.lit("")) != "", normalized_commodity(c))
    return F.when(symbol.rlike("^[A-Z]+$"), symbol).otherwise(F.concat(F.lit('"'), symbol, F.lit('"')))


def posting_line(account: Column, amount: Column, commodity: Column, column: int = 52) -> Column:
    """A posting with the amount at a fixed column, at least two spaces behind the account."""
    gap = F.greatest(F.lit(column - 4) - F.length(account), F.lit(2))
    return F.concat(F.lit("    "), account, F.repeat(F.lit(" "), gap), amount.cast("decimal(20,2)").cast("string"), F.lit(" "), commodity)


def price_line(date: Column, commodity: Column, rate: Column) -> Column:
    """A price directive at four places."""
    return F.concat(F.lit("P "), F.date_format(date, "yyyy/MM/dd"), F.lit(" "), commodity, F.lit(" "), F.bround(rate, 4).cast("decimal(18,4)").cast("string"), F.lit(" INR"))


def day_digests(posted: DataFrame) -> DataFrame:
    """SHA-256 of each day's posting lines in the order of the file (entry, leg): a changed day is found without its text."""
    line = posting_line(F.col("account"), F.col("amount_paise").cast("decimal(20,2)") / 100, F.col("commodity"))
    g = posted.select("date", "id", "leg", line.alias("line")).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("id", "leg", "line"))).alias("l"))
    return g.select("date", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("digest"))


def in_file_order(posted: DataFrame) -> DataFrame:
    """Postings as the file has them: by date, entry and leg, written in ranges of dates."""
    return posted.orderBy("date", "id", "leg")


def compared(names: DataFrame, native: DataFrame, projected: DataFrame, external: DataFrame, tolerance_paise: int = 1) -> DataFrame:
    """Each account's balance as stored, in the projection and in an outside report (liabilities turned to what is owed), their
    differences, and what is missing."""
    flip = lambda c: F.when(F.col("kind") == "liability", -F.col(c)).otherwise(F.col(c))
    n = native.select(F.col("account_id").alias("_n"), F.col("paise").alias("native_paise"))
    p = projected.select(F.col("account").alias("_p"), F.col("balance_paise").alias("_pp"))
    e = external.select(F.col("account").alias("_e"), F.col("paise").alias("_ep"))
    j = names.join(n, F.col("account_id") == F.col("_n"), "left").join(p, F.col("account") == F.col("_p"), "left").join(e, F.col("account") == F.col("_e"), "left")
    j = j.select("account_id", "account", "native_paise", flip("_pp").cast("bigint").alias("projected_paise"), flip("_ep").cast("bigint").alias("external_paise"))
    note = F.when(F.col("projected_paise").isNull(), "not_projected").when(F.col("external_paise").isNull(), "not_loaded").when(F.col("native_paise").isNull(), "no_balance").when(
        F.abs(F.col("projected_paise") - F.col("external_paise")) >= tolerance_paise, "stale_external").when(F.abs(F.col("native_paise") - F.col("projected_paise")) >= tolerance_paise, "drift").otherwise("agrees")
    return j.withColumn("note", note)
