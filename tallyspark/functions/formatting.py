"""Text forms of money, labels and ledger fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped_amount(c: Column) -> Column:
    """Two places with thousands separators: 1,234.56."""
    return F.format_number(c, 2)


def indian_amount(c: Column) -> Column:
    """Exact rupees with Indian grouping: the last three digits, then twos; half a hundredth rounds up."""
    amount = F.round(F.coalesce(c.cast("decimal(20,4)"), F.lit(0)), 2).cast("decimal(20,2)")
    digits = F.split_part(F.abs(amount).cast("string"), F.lit("."), F.lit(1))
    head = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d{3}$)", "$1,")
    whole = F.regexp_replace(head, r"(\d)(?=\d{3}$)", "$1,")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), F.regexp_replace(whole, ",,", ","), F.lit("."), F.split_part(F.abs(amount).cast("string"), F.lit("."), F.lit(2)))


def compact_amount(c: Column) -> Column:
    """Rupees in crores, lakhs or thousands with at most three or so digits."""
    value = F.coalesce(c.cast("double"), F.lit(0.0))
    size = F.abs(value)

    def scaled(by: float, suffix: str) -> Column:
        x = value / F.lit(by)
        text = F.when(F.abs(x) >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
        return F.concat(F.lit("₹"), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit(suffix))

    return F.when(size >= 1e7, scaled(1e7, "Cr")).when(size >= 1e5, scaled(1e5, "L")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.concat(F.lit("₹"), F.format_number(value, 2)))


def sanitized_text(c: Column, unsafe: str = ";\n\r\t{}") -> Column:
    """Characters that a ledger would read as syntax become spaces, and spaces collapse; '' for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), unsafe, " " * len(unsafe)), " +", " "))


def sanitized_meta(c: Column) -> Column:
    """A metadata value that is safe in every backend, at most 200 characters."""
    return F.left(sanitized_text(c, ';\n\r\t{},"\\'), F.lit(200))


def ledger_amount(c: Column, commodity: Column) -> Column:
    return F.concat(c.cast("decimal(20,2)").cast("string"), F.lit(" "), commodity)


def canonical_slug(c: Column) -> Column:
    """Lower case with underscores; null where it isn't a valid slug."""
    slug = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(slug.rlike("^[a-z][a-z0-9_]{1,40}$"), slug)


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or the month's last day where it has fewer; null for a bad month or a day below 1."""
    first = F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))
    return F.when(month.between(1, 12) & (day >= 1), F.least(F.date_add(first, day - 1), F.last_day(first)))
