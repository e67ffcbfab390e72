"""Periods of the calendar and of date ranges: quarters, trailing months, presets, lenient and checked bounds, currency signs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_start(date: Column) -> Column:
    return F.trunc(date, "quarter")


def trailing_month_starts(date: Column, months: int) -> Column:
    """Firsts of the ``months`` months that end with the date's own, oldest first."""
    return F.transform(F.sequence(F.lit(months - 1), F.lit(0), F.lit(-1)), lambda back: F.add_months(F.trunc(date, "MM"), -back))


def presets(today: Column) -> Column:
    """Array of (label, date_from, date_to): running periods end today, completed ones on their last day."""
    month, quarter = F.trunc(today, "MM"), quarter_start(today)
    year = F.make_date(F.year(today) - (F.month(today) < 4).cast("int"), F.lit(4), F.lit(1))
    ranges = [("This month", month, today), ("Last month", F.add_months(month, -1), F.date_sub(month, 1)), ("This quarter", quarter, today), ("Last quarter", F.add_months(quarter, -3), F.date_sub(quarter, 1)),
              ("Financial year", year, today), ("Calendar year", F.trunc(today, "YEAR"), today)]
    return F.array(*[F.struct(F.lit(n).alias("label"), a.alias("date_from"), b.alias("date_to")) for n, a, b in ranges])


def resolved_bounds(date_from: Column, date_to: Column, today: Column) -> list[Column]:
    """Inclusive bounds of two ISO texts, each by itself: what doesn't parse is the month's first, or today."""
    iso = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return [F.coalesce(iso(date_from), F.trunc(today, "MM")).alias("date_from"), F.coalesce(iso(date_to), today).alias("date_to")]


def within_days(at: Column, date_from: str | None, date_to: str | None) -> Column:
    """Whether a timestamp falls on a day of the inclusive range; a range that runs backwards is refused."""
    if date_from and date_to and datetime.date.fromisoformat(date_from) > datetime.date.fromisoformat(date_to):
        raise ValueError("date_from must not exceed date_to")
    out = F.lit(True)
    if date_from:
        out = out & (at >= F.lit(date_from).cast("date"))
    if date_to:
        out = out & (at < F.date_add(F.lit(date_to).cast("date"), 1))
    return out


def currency_sign(code: Column) -> Column:
    """Prefix of an amount: the sign of rupees (also for a blank code) and dollars, else the code and a space."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(c.isin("", "INR"), "₹").when(c == "USD", "$").otherwise(F.concat(c, F.lit(" ")))
