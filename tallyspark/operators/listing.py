"""Filtered, sorted and paged listings, counts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import is_blank, mask_digits, non_inr, normalized_currency, paise
from tallyspark.operators.cashflow import in_scope, is_uncategorized, rows

SORTABLE = ["transaction_date", "amount", "bank", "counterparty", "category"]
PAGE = 50


def filtered(txns: DataFrame, accounts: DataFrame | None = None, *, bank: str | None = None, account_id: int | None = None, direction: str | None = None, start: str | None = None, end: str | None = None, category: str | None = None,
             counterparty: str | None = None, uncategorized: bool = False, category_null: bool = False, non_inr_only: bool | None = None, undated: bool = False, scope: str | None = None) -> DataFrame:
    """Conjunction of the listing's filters; a blank ``counterparty`` filter selects rows without one."""
    where: list[Column] = []
    for name, value in (("bank", bank), ("account_id", account_id), ("direction", direction), ("category", category)):
        if value is not None:
            where.append(F.col(name) == value)
    if start is not None:
        where.append(F.col("transaction_date") >= F.lit(start).cast("date"))
    if end is not None:
        where.append(F.col("transaction_date") <= F.lit(end).cast("date"))
    if counterparty is not None:
        where.append(is_blank(F.col("counterparty")) if not counterparty.strip() else F.col("counterparty") == counterparty)
    if uncategorized:
        where.append(is_uncategorized())
    if category_null:
        where.append(is_blank(F.col("category")))
    if non_inr_only is not None:
        where.append(non_inr(F.col("currency")) if non_inr_only else ~non_inr(F.col("currency")) | F.col("currency").isNull())
    if undated:
        where.append(F.col("transaction_date").isNull())
    for w in where:
        txns = txns.where(w)
    return in_scope(txns, accounts, scope) if scope else txns


def page(txns: DataFrame, sort: str = "transaction_date", descending: bool = True, number: int = 1, size: int = PAGE) -> DataFrame:
    """One page under a total order: nulls last either way, ids break ties in the same direction; bad arguments fall back."""
    sort = sort if sort in SORTABLE else "transaction_date"
    by = [F.col(sort).desc_nulls_last(), F.col("id").desc()] if descending else [F.col(sort).asc_nulls_last(), F.col("id").asc()]
    return txns.orderBy(*by).offset(max(0, number - 1) * size).limit(size)


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total"))


def page_by_id(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest ids first, with the number of all rows."""
    one = counted(df).withColumn("_one", F.lit(1))
    return df.orderBy(F.col("id").desc()).offset(offset).limit(limit).withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def totals_by_currency(txns: DataFrame) -> DataFrame:
    """Credits, debits and net of each currency (other directions left out); an INR row is always there."""
    currency = normalized_currency(F.col("currency")).alias("currency")
    sums = txns.where(F.col("direction").isin("credit", "debit")).groupBy(currency).agg(
        F.sum(F.when(F.col("direction") == "credit", F.col("amount"))).alias("c"), F.sum(F.when(F.col("direction") == "debit", F.col("amount"))).alias("d"))
    inr = txns.sparkSession.range(1).select(F.lit("INR").alias("_inr"))
    both = sums.join(inr, F.col("currency") == F.col("_inr"), "full_outer")
    out = both.select(F.coalesce("currency", "_inr").alias("currency"), paise(F.col("c")).alias("credits"), paise(F.col("d")).alias("debits"))
    return out.withColumn("net", F.col("credits") - F.col("debits"))


def account_counts(accounts: DataFrame, txns: DataFrame, statements: DataFrame) -> DataFrame:
    """Transactions and statements of every account, 0 where there are none."""
    t = txns.groupBy("account_id").agg(rows().alias("txns"))
    s = statements.groupBy("account_id").agg(rows().alias("statements"))
    out = accounts.select("id").join(t, F.col("id") == t.account_id, "left").drop("account_id").join(s, F.col("id") == s.account_id, "left").drop("account_id")
    return out.select("id", F.coalesce("txns", F.lit(0)).alias("txns"), F.coalesce("statements", F.lit(0)).alias("statements"))


def link_counts(accounts: DataFrame, linked: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each linked table name each account; 0 where none does."""
    out = accounts.select("id")
    for name, df in linked.items():
        g = df.groupBy(F.col("account_id").alias("_a")).agg(rows().alias("_n"))
        out = out.join(g, F.col("id") == F.col("_a"), "left").select(*out.columns, F.coalesce("_n", F.lit(0)).alias(name))
    return out


def first_cards(cards: DataFrame, most: int = 50) -> DataFrame:
    """Up to ``most`` cards of each account, primary first, with a flag where there are more."""
    w = Window.partitionBy("account_id")
    n = F.row_number().over(w.orderBy(F.col("is_primary").desc_nulls_last(), "id"))
    return cards.withColumn("position", n).where(F.col("position") <= most + 1).withColumn("truncated", F.max("position").over(w) > most).where(F.col("position") <= most)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each account and category by (as_of_date, id)."""
    newest = snapshots.where(F.col("account_id").isNotNull()).groupBy("account_id", "category").agg(F.max_by(F.struct("id", "as_of_date", "value"), F.struct("as_of_date", "id")).alias("s"))
    return newest.select("account_id", "category", "s.id", "s.as_of_date", "s.value")


def all_statements(card: DataFrame, bank: DataFrame) -> DataFrame:
    """Card and bank statements as one list with a kind."""
    return card.withColumn("kind", F.lit("card")).unionByName(bank.withColumn("kind", F.lit("bank")), allowMissingColumns=True)


def without_match(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows of ``child`` whose foreign key has no parent row."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti").select(F.lit(name).alias("relation"), F.col(key).alias("missing"))


def in_request_order(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items for a list of ids (position, id) in that order; an id without an item keeps a row with found = false."""
    hit = items.withColumn("found", F.lit(True))
    return ids.join(hit, F.col("wanted") == F.col(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def bounded_text(c: Column, n: int) -> list[Column]:
    """(text cut to n characters, whether it was longer)."""
    return [F.substring(c, 1, n).alias("text"), F.coalesce(F.length(c) > n, F.lit(False)).alias("truncated")]


def display_mask(c: Column) -> Column:
    digits = mask_digits(c)
    return F.when(digits != "", F.concat(F.lit("XXXX"), F.right(digits, F.lit(4))))


def exact_filters(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value: text is stripped, banks compare in lower case, ``date_from`` and ``date_to`` bound
    the transaction date; a None filters nothing."""
    for name, value in wanted.items():
        if value is None:
            continue
        value = value.strip() if isinstance(value, str) else value
        if name in ("date_from", "date_to"):
            day = F.lit(value).cast("date")
            df = df.where(F.col("transaction_date") >= day if name == "date_from" else F.col("transaction_date") <= day)
        elif name == "bank":
            df = df.where(F.lower("bank") == value.lower())
        else:
            df = df.where(F.col(name) == value)
    return df


def with_details(txns: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows with their account's label and type and its primary card; dangling and missing accounts stay."""
    a = accounts.select(F.col("id").alias("_a"), F.col("label").alias("account_label"), F.col("type").alias("account_type"))
    c = cards.where("is_primary").groupBy(F.col("account_id").alias("_c")).agg(F.min("card_mask").alias("primary_mask"))
    return txns.join(a, F.col("account_id") == F.col("_a"), "left").join(c, F.col("account_id") == F.col("_c"), "left").drop("_a", "_c")


def near_statement(txns: DataFrame, rows_: DataFrame, days: int = 7) -> DataFrame:
    """Rows of each statement's account from ``days`` before its first date to as many after its last."""
    span = rows_.groupBy(F.col("account_id").alias("_a")).agg(F.date_sub(F.min("date"), days).alias("_lo"), F.date_add(F.max("date"), days).alias("_hi"))
    return txns.join(span, (F.col("account_id") == F.col("_a")) & F.col("transaction_date").between(F.col("_lo"), F.col("_hi"))).drop("_a", "_lo", "_hi")


def by_person(rows_: DataFrame, group: str, person: str) -> DataFrame:
    """Counts a person, only for groups that have more than one."""
    g = rows_.where(F.col(person).isNotNull()).groupBy(group, person).agg(rows().alias("n"))
    return g.withColumn("_p", F.count(F.lit(1)).over(Window.partitionBy(group))).where("_p > 1").drop("_p")


def with_sources(txns: DataFrame, emails: DataFrame, accounts: DataFrame, messages: DataFrame) -> DataFrame:
    """Transactions (with email_id) beside the state of their e-mail, their account's label and the state of the text message
    that names them (the first one in order where several do); what is missing or dangling is null."""
    e = emails.select(F.col("id").alias("_e"), F.col("status").alias("email_status"))
    a = accounts.select(F.col("id").alias("_a"), F.col("label").alias("account_label"))
    m = messages.where("transaction_id is not null").groupBy(F.col("transaction_id").alias("_m")).agg(F.min("status").alias("sms_status"))
    return txns.join(e, F.col("email_id") == F.col("_e"), "left").join(a, F.col("account_id") == F.col("_a"), "left").join(m, F.col("id") == F.col("_m"), "left").drop("_e", "_a", "_m")


def dangling(relations: list[tuple[DataFrame, str, DataFrame, str]], limit: int) -> DataFrame:
    """(relation, violations, beyond_limit) of each (child, key, parent, name): rows whose key has no parent row."""
    out = None
    for child, key, parent, name in relations:
        bad = without_match(child, key, parent, "id", name).agg(F.count(F.lit(1)).cast("bigint").alias("violations"))
        one = bad.select(F.lit(name).alias("relation"), "violations", (F.col("violations") > limit).alias("beyond_limit"))
        out = one if out is None else out.unionByName(one)
    return out


def whole(text: str | None) -> int | None:
    """The whole number of a filter's text; a bad one filters nothing."""
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None
