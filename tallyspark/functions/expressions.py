"""Column expressions shared by the operators: money, blanks, text, masks and dates, without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that make a string blank (space, tab, newline, return, vertical tab, form feed).
BLANK = " \t\n\r\x0b\x0c"


def signed(direction: Column, amount: Column) -> Column:
    """Cash flow: plus for a credit, minus for any other direction."""
    return F.when(direction == "credit", amount).otherwise(-amount)


def paise(amount: Column) -> Column:
    """Money as whole hundredths; null (an empty sum) is 0."""
    return F.coalesce((amount * 100).cast("bigint"), F.lit(0).cast("bigint"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.btrim(c, F.lit(BLANK)) == "")


def unblank(c: Column) -> Column:
    """Null for a blank string, else the string as it is."""
    return F.when(~is_blank(c), c)


def inr_or_null(currency: Column) -> Column:
    return currency.isNull() | (currency == "INR")


def non_inr(currency: Column) -> Column:
    return currency.isNotNull() & (currency != "INR")


def normalized_currency(currency: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(currency)), F.lit("")), F.lit("INR"))


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one space between tokens; '' for null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9 ]+", " "), " +", " "))


def normalize_counterparty(c: Column) -> Column:
    """Lower-case letters and digits of any script, nothing else; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


# Patterns of personal numbers and the marks that take their place, phones first.
PERSONAL_NUMBERS = [
    (r"(?<!\d)(?:\+?\d[\s-]?){10,13}(?!\d)", "[redacted-phone]"),
    (r"\d{7,}", "[redacted-num]"),
]


def redact_pii(c: Column) -> Column:
    """Phone-like sequences, then runs of seven or more digits, replaced by fixed marks."""
    out = F.coalesce(c, F.lit(""))
    for pattern, mark in PERSONAL_NUMBERS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def has_marker(text: Column, markers: list[str]) -> Column:
    """Whether any marker stands in a normalized text as whole tokens."""
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike("( " + " | ".join(markers) + " )")


def normalize_mask(c: Column) -> Column:
    """Digits and ``X`` for any wildcard, separators dropped; '' for null and for a mask with any other character."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s-]", "")
    return F.when(bare.rlike(r"^[0-9Xx*#]+$"), F.regexp_replace(bare, r"[x*#]", "X")).otherwise("")


def trailing_digits(mask: Column) -> Column:
    return F.length(F.regexp_extract(mask, r"([0-9]*)$", 1))


def mask_matches(a: Column, b: Column) -> Column:
    """Whether two normalized masks agree from the right over their overlap; a wildcard on either side fits anything."""
    n = F.least(F.length(a), F.length(b))

    def fits(i: Column) -> Column:
        x, y = F.substring(a, -i, F.lit(1)), F.substring(b, -i, F.lit(1))
        return (x == y) | (x == "X") | (y == "X")

    return (n > 0) & F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), fits)


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def parse_amount(c: Column) -> Column:
    """'25,000.00' as decimal(16,2); null where it doesn't parse."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(16,2)")


#: Shapes of printed dates, day first, and the pattern that each must have.
DAY_FIRST = [("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"), ("dd/MM/yy", r"^\d{2}/\d{2}/\d{2}$")]


def parse_day_first(c: Column) -> Column:
    """The date of a printed text in one of the shapes; null for any other."""
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(pattern), F.try_to_date(t, shape)) for shape, pattern in DAY_FIRST])


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_date_leniently(c: Column, this_year: int | None = None) -> Column:
    """The date of a printed text, day first, however it is written: any separators, one or two digits, month names in short or
    full, days as ordinals, weekdays in front, a time behind, years of two digits (the nearest within fifty years of
    ``this_year``, by default the current one).  Of two numbers that can't be day and month in that order the other order holds;
    a year in front is followed by month and day.  Null for anything else and for days that don't exist."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[,. ]+", "")
    t = F.regexp_replace(t, r"[t, ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([ap]\.?m\.?)?\s*(z|utc|gmt|ist|[+-]\d{2}:?\d{2})?$", "")
    t = F.regexp_replace(t, r"\b(\d{1,2})(st|nd|rd|th)\b( of\b)?", "$1")
    t = F.trim(F.regexp_replace(t, r"[\s/.,_-]+", " "))
    t = F.regexp_replace(t, r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    named = r"^(\d{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (\d{4}|\d{2})$"
    leading = r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (\d{1,2}) (\d{4}|\d{2})$"
    plain, first = r"^(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})$", r"^(\d{4}) ?(\d{2}|\d(?= )) ?(\d{1,2})$"
    year_named = r"^(\d{4}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (\d{1,2})$"
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)

    def year(text: Column) -> Column:
        short = now - F.pmod(now, F.lit(100)) + text.cast("int")
        near = F.when(short >= now + 50, short - 100).when(short < now - 50, short + 100).otherwise(short)
        return F.when(F.length(text) == 4, text.cast("int")).otherwise(near)

    month = lambda text: F.array_position(F.array(*map(F.lit, _MONTHS)), text)
    day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    a, b = part(plain, 1), part(plain, 2)
    turned = F.when((b.try_cast("int") > 12) & (a.try_cast("int") <= 12), True).otherwise(False)
    return (
        F.when(t.rlike(plain), day_of(year(part(plain, 3)), F.when(turned, a).otherwise(b), F.when(turned, b).otherwise(a)))
        .when(t.rlike(named), day_of(year(part(named, 3)), month(part(named, 2)), part(named, 1)))
        .when(t.rlike(leading), day_of(year(part(leading, 3)), month(part(leading, 1)), part(leading, 2)))
        .when(t.rlike(year_named), day_of(part(year_named, 1), month(part(year_named, 2)), part(year_named, 3)))
        .when(t.rlike(first), day_of(part(first, 1), part(first, 2), part(first, 3)))
    )


def local_time(at: Column, zone: str = "Asia/Kolkata") -> Column:
    """A stored time (UTC, without zone) as the local one."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def financial_year_start(date: Column) -> Column:
    return F.make_date(F.year(date) - (F.month(date) < 4).cast("int"), F.lit(4), F.lit(1))


def is_small(df: DataFrame, most: int = 50_000) -> bool:
    """Whether a table that people keep (rules, masks) has few enough rows to be sent to all tasks; counts no further."""
    return df.limit(most + 1).count() <= most
