"""Date labels of forecast weeks, months and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_LETTERS = "JFMAMJJASOND"


def parse_init(c: Column) -> Column:
    """Date of ``2026-07-11`` or ``20260711``; null otherwise."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
    compact = F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
    return F.coalesce(iso, compact)


def week_start(init: Column, week: Column) -> Column:
    return F.date_add(init, ((week - 1) * 7 + 1).cast("int"))


def valid_week_label(init: Column, week: Column) -> Column:
    """``Jan 02 - Jan 08``."""
    start = week_start(init, week)
    return F.concat(F.date_format(start, "MMM dd"), F.lit(" - "), F.date_format(F.date_add(start, 6), "MMM dd"))


def week_label(init: Column, week: Column) -> Column:
    """``Week 1 · Jul 12–18``, spelled out across months, or ``Week 1`` without a date."""
    start = week_start(parse_init(init), week)
    end = F.date_add(start, 6)
    name = F.concat(F.lit("Week "), week.cast("string"))
    first = F.date_format(start, "MMM d")
    span = F.when(F.month(start) == F.month(end), F.concat(first, F.lit("–"), F.day(end).cast("string"))).otherwise(
        F.concat(first, F.lit(" – "), F.date_format(end, "MMM d"))
    )
    return F.when(start.isNull(), name).otherwise(F.concat(name, F.lit(" · "), span))


def valid_month_label(init_month: Column, lead: Column) -> Column:
    """``Jun 2026`` for lead 0 of a June init."""
    return F.date_format(F.add_months(init_month, lead.cast("int")), "MMM yyyy")


def season_label(init_month: Column, n_months: int = 3, skip_init: bool = True) -> Column:
    """Month initials of the upcoming season and the year of its middle month."""
    first = 1 if skip_init else 0
    letters = [
        F.substring(F.lit(MONTH_LETTERS), F.month(F.add_months(init_month, first + i)), F.lit(1))
        for i in range(n_months)
    ]
    middle = F.add_months(init_month, first + n_months // 2)
    return F.concat(*letters, F.lit(" "), F.year(middle).cast("string"))


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def compact_to_iso(c: Column) -> Column:
    """``yyyyMMdd`` text to ``yyyy-MM-dd``; null when it does not parse."""
    parsed = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    return F.date_format(parsed, "yyyy-MM-dd")


def season_range(source: Column) -> Column:
    """``Jun 1 – Jul 8, 2026`` from a source text that ends in ``asof yyyy-MM-dd``."""
    tail = F.regexp_extract(source, r"asof\s+(\d{4}-\d{1,2}-\d{1,2})", 1)
    day = F.when(tail != "", F.try_to_date(tail, "yyyy-M-d"))
    return F.concat(F.lit("Jun 1 – "), F.date_format(day, "MMM d"), F.lit(", "), F.date_format(day, "yyyy"))


def init_from_first_valid(first_valid: Column) -> Column:
    return F.date_sub(first_valid, 1)
