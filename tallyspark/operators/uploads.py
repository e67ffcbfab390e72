"""Statement uploads: reads, the account and card they belong to, balances they emit, and their stored reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import mask_digits, mask_matches, normalize_mask, paise, parse_amount, parse_day_first, trailing_digits
from tallyspark.operators.linking import by_shape
from tallyspark.operators.substrings import containing


def last_four(c: Column) -> Column:
    """The last four characters; shorter text as it is."""
    return F.right(c, F.lit(4))


def last_four_digits(c: Column) -> Column:
    """The last four digits of a card or account number; null where fewer are visible at its end."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s-]", ""), r"([0-9]{4})$", 1)
    return F.nullif(found, F.lit(""))


def bounded_payload(c: Column, most: int) -> list[Column]:
    """(payload, state): the text only up to ``most`` characters; absent, too_large or present."""
    state = F.when(c.isNull(), "absent").when(F.length(c) > most, "too_large").otherwise("present")
    return [F.when(F.length(c) <= most, c).alias("payload"), state.alias("state")]


def upload_status(portfolio_ok: Column) -> Column:
    return F.when(portfolio_ok, "parsed").otherwise("invalid")


def with_account(uploads: DataFrame, accounts: DataFrame) -> DataFrame:
    """Uploads with their account's label and bank; dangling ones stay."""
    a = accounts.select(F.col("id").alias("_a"), F.col("label").alias("account_label"), F.col("bank").alias("account_bank"))
    return uploads.join(a, F.col("account_id") == F.col("_a"), "left").drop("_a")


def latest_uploads(uploads: DataFrame) -> DataFrame:
    """The newest upload of each account: by due date, by creation where that doesn't parse, then by creation and id."""
    by = F.struct(F.coalesce(parse_day_first(F.col("due_date")), F.col("created_on")), F.col("created_on"), F.col("id"))
    return uploads.groupBy("account_id").agg(F.max_by("id", by).alias("id"))


def statement_ranges(rows: DataFrame, key: str, date: str = "date", period: tuple[str, str] | None = None) -> DataFrame:
    """First and last date of each statement: its printed period where both ends parse, else its rows' dates; a statement
    without any is left out."""
    day = F.col(date)
    aggs = [F.min(day).alias("_lo"), F.max(day).alias("_hi")]
    if period:
        aggs += [F.max(parse_day_first(F.col(period[0]))).alias("_p"), F.max(parse_day_first(F.col(period[1]))).alias("_q")]
    g = rows.groupBy(key).agg(*aggs)
    both = F.col("_p").isNotNull() & F.col("_q").isNotNull() if period else F.lit(False)
    out = g.select(key, (F.when(both, F.col("_p")).otherwise(F.col("_lo")) if period else F.col("_lo")).alias("first_date"), (F.when(both, F.col("_q")).otherwise(F.col("_hi")) if period else F.col("_hi")).alias("last_date"))
    return out.where("first_date is not null")


def bank_snapshots(uploads: DataFrame) -> DataFrame:
    """Balances that bank statements emit: the closing balance at the end of the period; none where either doesn't parse.
    The newest upload of an account and date stands."""
    value, day = parse_amount(F.col("closing_balance")), parse_day_first(F.col("period_end"))
    own = uploads.where(value.isNotNull() & day.isNotNull()).select("account_id", day.alias("as_of_date"), value.alias("value"), "id")
    g = own.groupBy("account_id", "as_of_date").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("upload_id"))
    return g.select("account_id", F.lit("asset").alias("kind"), F.lit("bank_balance").alias("category"), "as_of_date", paise(F.col("value")).alias("value_paise"), "upload_id")


# ---- whose statement it is


def stored_masks(accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(account_id, mask) of readable masks of accounts and their cards."""
    a = accounts.select(F.col("id").alias("account_id"), normalize_mask(F.col("account_number")).alias("mask"))
    return a.unionByName(cards.select("account_id", normalize_mask(F.col("card_mask")).alias("mask"))).where("mask <> ''").distinct()


def account_of_mask(statements: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, account_id, matches) of card statements: the account of the statement's bank with a stored mask that ends in a
    digit and agrees with the statement's by position, if it is the only one."""
    own = accounts.where((F.col("type") == "credit_card") & F.coalesce("active", F.lit(True)))
    known = stored_masks(own, cards.join(own.select(F.col("id").alias("_o")), F.col("account_id") == F.col("_o"), "left_semi"))
    known = known.where(trailing_digits(F.col("mask")) > 0).join(own.select(F.col("id").alias("_i"), F.col("bank").alias("_bank")), F.col("account_id") == F.col("_i"))
    # what statements ask is their bank and mask: each pair of them is looked up once, by the digits that both shapes show
    shown = normalize_mask(F.col("mask"))
    s = statements.select("id", "bank", shown.alias("_sm"), (trailing_digits(shown) > 0).alias("_can"))
    ask = s.where("_can").select(F.col("bank").alias("bank_key"), F.col("_sm").alias("mask")).distinct()
    stored = known.select(F.col("_bank").alias("sb"), "account_id", F.col("mask").alias("stored"))
    hit = by_shape(ask, stored).where(mask_matches(F.col("mask"), F.col("stored")))
    g = hit.groupBy(_asked(F.col("bank_key"), F.col("mask")).alias("_g")).agg(F.countDistinct("account_id").cast("bigint").alias("matches"), F.min("account_id").alias("_only"))
    out = s.withColumn("_k", F.when(F.col("_can"), _asked(F.col("bank"), F.col("_sm"))).otherwise(_nothing())).join(g, F.col("_k") == F.col("_g"), "left")
    return out.select("id", F.when(F.col("matches") == 1, F.col("_only")).alias("account_id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def _asked(bank: Column, shown: Column) -> Column:
    """A bank and what a statement shows of a number as one text; null where either is."""
    return F.concat(bank, F.lit("\1"), shown)


def _nothing() -> Column:
    """A key that nothing has, another one for every id, so that rows that ask nothing spread over all tasks."""
    return F.concat(F.lit("\2"), F.col("id").cast("string"))


def refuted(statements: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, refuted) of statements with an account: whether a visible digit of the mask contradicts every stored mask."""
    known = stored_masks(accounts, cards).withColumnRenamed("account_id", "_a")
    j = statements.select("id", "account_id", normalize_mask(F.col("mask")).alias("_sm")).join(known, F.col("account_id") == F.col("_a"), "left")
    g = j.groupBy("id", "_sm").agg(F.bool_or(mask_matches(F.col("_sm"), F.col("mask"))).alias("_fits"), F.count("mask").alias("_n"))
    return g.select("id", (F.col("_sm").rlike("[0-9]") & (F.col("_n") > 0) & ~F.coalesce("_fits", F.lit(False))).alias("refuted"))


def card_of_statement(statements: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, last4, step) of statements' card texts: their own last four digits, else those of the account's card (first id)
    that end with the digits shown, else the account's own."""
    c = cards.select(F.col("id").alias("_c"), F.col("account_id").alias("_ca"), last_four_digits(F.col("card_mask")).alias("_l4")).where("_l4 is not null")
    a = accounts.select(F.col("id").alias("_a"), last_four_digits(F.col("account_number")).alias("_al4"))
    s = statements.select("id", "account_id", last_four_digits(F.col("mask")).alias("_own"), mask_digits(F.col("mask")).alias("_part"))
    hit = s.where("_own is null and _part <> ''").join(c, (F.col("account_id") == F.col("_ca")) & F.col("_l4").endswith(F.col("_part")))
    near = hit.groupBy(F.col("id").alias("_s")).agg(F.min_by("_l4", "_c").alias("_near"))
    j = s.join(near, F.col("id") == F.col("_s"), "left").join(a, F.col("account_id") == F.col("_a"), "left")
    step = F.when(F.col("_own").isNotNull(), "printed").when(F.col("_near").isNotNull(), "card").when(F.col("_al4").isNotNull(), "account")
    return j.select("id", F.coalesce("_own", "_near", "_al4").alias("last4"), step.alias("step"))


def bank_account_of(statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, account_id) of bank statements: the first active account of the bank with their last four digits, or that holds the
    shorter number shown; else the bank's only account."""
    own = accounts.where((F.col("type") == "bank_account") & F.col("active")).select(F.col("id").alias("_a"), F.col("bank").alias("_b"), last_four_digits(F.col("account_number")).alias("_l4"), F.col("account_number").alias("_n"))
    # each bank and number shown is looked up once: four digits by equality, a shorter number by the q-grams of accounts' numbers
    four, short = last_four_digits(F.col("mask")), F.nullif(F.col("mask"), F.lit(""))
    s = statements.select("id", "bank", four.alias("_s4"), F.when(four.isNull(), short).alias("_m"))
    s = s.withColumn("_k", F.coalesce(_asked(F.col("bank"), F.concat(F.lit("="), F.col("_s4"))), _asked(F.col("bank"), F.concat(F.lit("~"), F.col("_m"))), _nothing()))
    full = own.where("_l4 is not null").select(_asked(F.col("_b"), F.concat(F.lit("="), F.col("_l4"))).alias("_g"), "_a")
    ask = s.where("_m is not null").select(F.col("bank").alias("_mb"), "_m").distinct()
    part = containing(own.where("_n is not null").select("_a", "_b", "_n"), "_n", ask, "_m", by=("_b", "_mb")).select(_asked(F.col("_b"), F.concat(F.lit("~"), F.col("_m"))).alias("_g"), "_a")
    first = full.unionByName(part).groupBy("_g").agg(F.min("_a").alias("_first"))
    sole = own.groupBy(F.col("_b").alias("_sb")).agg(F.count(F.lit(1)).alias("_k1"), F.min("_a").alias("_sole")).where("_k1 = 1")
    return s.join(first, F.col("_k") == F.col("_g"), "left").join(sole, F.col("bank") == F.col("_sb"), "left").select("id", F.coalesce("_first", "_sole").alias("account_id"))


# ---- stored reconciliations

# The words of the note about rows that an import left out.
SKIPPED = ["Skipped ", " duplicate", " unexpected error", " row(s) during auto-import; see reconciliation details."]
RECON = "matched array<struct<stmt_idx:bigint,id:bigint>>, missing array<struct<stmt_idx:bigint,duplicate:boolean,import_failed:boolean,candidates:array<bigint>>>"


def reconciliations(uploads: DataFrame, column: str, most: int) -> DataFrame:
    """Uploads with ``recon`` (decoded) and ``recon_state``: absent, too_large, malformed or parsed."""
    text = F.col(column)
    doc = F.when(F.trim(text).startswith("{") & (F.length(text) <= most), F.from_json(text, RECON))
    fit = doc.isNotNull() & (doc["matched"].isNotNull() | doc["missing"].isNotNull())
    state = F.when(text.isNull(), "absent").when(F.length(text) > most, "too_large").when(fit, "parsed").otherwise("malformed")
    return uploads.withColumn("recon", F.when(fit, doc)).withColumn("recon_state", state)


def reconciliation_summary(decoded: DataFrame) -> DataFrame:
    """Counts of each upload's reconciliation, its distinct transaction ids in their order, and the blurb about rows that the
    import left out."""
    missing = F.coalesce(F.col("recon.missing"), F.array().cast("array<struct<stmt_idx:bigint,duplicate:boolean,import_failed:boolean,candidates:array<bigint>>>"))
    count = lambda f: F.size(F.filter(missing, f)).cast("bigint")
    d, e = count(lambda m: F.coalesce(m["duplicate"], F.lit(False))), count(lambda m: F.coalesce(m["import_failed"], F.lit(False)))
    told = F.concat_ws(", ", F.when(d > 0, F.concat(d.cast("string"), F.lit(SKIPPED[1]))), F.when(e > 0, F.concat(e.cast("string"), F.lit(SKIPPED[2]))))
    ids = F.array_distinct(F.transform(F.coalesce(F.col("recon.matched"), F.array().cast("array<struct<stmt_idx:bigint,id:bigint>>")), lambda m: m["id"]))
    return decoded.select("id", "recon_state", F.size(missing).cast("bigint").alias("missing"), d.alias("duplicates"), e.alias("failures"), ids.alias("ids"),
                          F.when((d > 0) | (e > 0), F.concat(F.lit(SKIPPED[0]), told, F.lit(SKIPPED[3]))).alias("note"))


def hydrated(decoded: DataFrame, txns: DataFrame) -> DataFrame:
    """Matched entries of reconciliations with what their transactions hold now; those that are gone stay, empty."""
    m = decoded.select(F.col("id").alias("upload_id"), F.explode("recon.matched").alias("m")).select("upload_id", F.col("m.stmt_idx").alias("stmt_idx"), F.col("m.id").alias("id"))
    t = txns.select(F.col("id").alias("_t"), "category", "counterparty")
    return m.join(t, F.col("id") == F.col("_t"), "left").drop("_t")


def adjustment_totals(pairs: DataFrame) -> DataFrame:
    """Sums of the high-confidence pairs' debits and credits; amounts that don't parse count as nothing."""
    high = F.col("confidence") == "high"
    total = lambda c: paise(F.sum(F.when(high, parse_amount(F.col(c)))))
    return pairs.groupBy("upload_id").agg(total("debit").alias("debit_paise"), total("credit").alias("credit_paise"))


def closes(statements: DataFrame) -> DataFrame:
    """Whether opening + credits - debits is the closing balance, to less than one rupee; null where either balance is."""
    gap = F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")
    return statements.select("id", paise(F.abs(gap)).alias("gap_paise"), (F.abs(gap) < 1).alias("closes"))


def csv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Statement rows as text for ``write.csv``: dates as ISO, '' for null, and text that a spreadsheet would run as a formula
    behind an apostrophe."""
    def text(c: str) -> Column:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when((F.typeof(F.col(c)) == "string") & s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s).alias(c)

    return rows.select(*[text(c) for c in columns])


def candidate_evidence(pairs: DataFrame, most: int = 20) -> DataFrame:
    """For each statement row the ids it could be (ascending, ``most`` at most, which is the feature), how many there are, and
    whether more than shown."""
    g = pairs.groupBy("stmt_idx").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    return g.select("stmt_idx", F.slice("_ids", 1, most).alias("ids"), F.size("_ids").cast("bigint").alias("candidates"), (F.size("_ids") > most).alias("truncated"))


def importable(rows: DataFrame, status: DataFrame, txns: DataFrame) -> DataFrame:
    """What becomes of each row that no stored one matches: import; or ambiguous, unparseable, or duplicate of a stored row
    with its bank, direction and reference (also of an earlier row of the import)."""
    keys = txns.where("trim(coalesce(reference_number, '')) <> ''").select(F.col("account_id").alias("_a"), F.col("direction").alias("_d"), F.trim("reference_number").alias("_r")).distinct().withColumn("_stored", F.lit(True))
    open_ = rows.join(status.where("status in ('missing', 'ambiguous')").select(F.col("stmt_idx").alias("_s"), "status"), F.col("stmt_idx") == F.col("_s"))
    ref = F.nullif(F.trim(F.coalesce("reference_number", F.lit(""))), F.lit(""))
    j = open_.withColumn("_ref", ref).join(keys, (F.col("account_id") == F.col("_a")) & (F.col("direction") == F.col("_d")) & (F.col("_ref") == F.col("_r")), "left")
    bad = F.col("date").isNull() | F.col("amount").isNull()
    can = ~bad & (F.col("status") == "missing") & F.col("_stored").isNull()
    nth = F.row_number().over(Window.partitionBy("account_id", "direction", "_ref", can).orderBy("stmt_idx"))
    action = F.when(F.col("status") == "ambiguous", "ambiguous").when(bad, "unparseable").when(F.col("_stored") | (F.col("_ref").isNotNull() & (nth > 1)), "duplicate").otherwise("import")
    return j.select("stmt_idx", action.alias("action"))


# Counterparties that say nothing.
GENERIC = ["payment done", "payment received", "payment successful"]


def enriched_counterparty(stored: Column, told: Column, bank: Column) -> Column:
    """The counterparty of a matched row after its statement: the statement's where the stored one is blank, generic or 'self'
    beside a fixed deposit of the bank."""
    low = F.lower(F.trim(F.coalesce(stored, F.lit(""))))
    fd = F.lower(F.trim(told)) == F.concat(F.lower(F.trim(bank)), F.lit(" fd"))
    return F.when((F.trim(F.coalesce(told, F.lit(""))) != "") & ((low == "") | low.isin(GENERIC) | ((low == "self") & fd)), told).otherwise(stored)
