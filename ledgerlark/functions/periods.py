"""Fiscal periods and dates; every parse is a ``try`` and yields null on nonsense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: Column) -> Column:
    """Date of the leading ``yyyy-mm-dd`` of a text, else null."""
    return F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")


def anchor(start: Column, end: Column, instant: Column) -> Column:
    """The date that names the period: instant, else end, else start."""
    return F.coalesce(day(instant), day(end), day(start))


def fiscal_year(start: Column, end: Column, instant: Column, fallback: Column | None = None) -> Column:
    got = F.year(anchor(start, end, instant))
    return got if fallback is None else F.coalesce(got, fallback.try_cast("int"))


def calendar_quarter(start: Column, end: Column, instant: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(anchor(start, end, instant)).cast("string"))


def fiscal_quarter(start: Column, end: Column, instant: Column, year_end: Column) -> Column:
    """Quarter counted from the day after the fiscal year's end (``--MM-DD``).

    The day after the year's end still belongs to the fourth quarter.  A year
    end that the year lacks (29 February) gives null; without one the
    calendar quarter holds.
    """
    at = anchor(start, end, instant)
    month = F.nullif(F.regexp_extract(F.coalesce(year_end, F.lit("")), "([0-9]{2})-?([0-9]{2})$", 1), F.lit(""))
    dom = F.nullif(F.regexp_extract(F.coalesce(year_end, F.lit("")), "([0-9]{2})-?([0-9]{2})$", 2), F.lit(""))
    close = F.try_to_date(F.concat_ws("-", F.year(at).cast("string"), month, dom), "yyyy-MM-dd")
    shifted = F.pmod(F.month(at) - month.cast("int") - 1, F.lit(12))
    number = F.when(at == F.date_add(close, 1), 4).otherwise(F.floor(shifted / 3) + 1)
    fiscal = F.when(close.isNotNull(), F.concat(F.lit("Q"), number.cast("int").cast("string")))
    return F.when(month.isNull(), calendar_quarter(start, end, instant)).otherwise(fiscal)


def period_label(start: Column, end: Column, instant: Column, fy: Column | None = None) -> Column:
    """``FY2023 instant d`` or ``FY2023 a→b``; the year is left out if unknown and
    a missing bound is ``?``.  Null without any date."""
    year = F.coalesce(F.concat(F.lit("FY"), fy.cast("string"), F.lit(" ")), F.lit("")) if fy is not None else F.lit("")
    at = F.nullif(instant, F.lit(""))
    a, b = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    span = F.concat(year, F.coalesce(a, F.lit("?")), F.lit("→"), F.coalesce(b, F.lit("?")))
    return F.when(at.isNotNull(), F.concat(year, F.lit("instant "), at)).when(a.isNotNull() | b.isNotNull(), span)


def parsed_period_label(start: Column, end: Column, instant: Column, fy: Column) -> Column:
    """The parse stage's spelling: ``FY?`` for an unknown year, a dash between bounds."""
    year = F.concat(F.lit("FY"), F.coalesce(fy.cast("string"), F.lit("?")))
    span = F.concat(year, F.lit(" "), F.coalesce(start, F.lit("?")), F.lit(" — "), F.coalesce(end, F.lit("?")))
    return F.when(instant.isNotNull(), F.concat(year, F.lit(" instant "), instant)).when(start.isNotNull() | end.isNotNull(), span)


def compact_day(value: Column) -> Column:
    """``yyyymmdd`` of a date text."""
    return F.date_format(day(value), "yyyyMMdd")


def in_year(value: Column, year: int) -> Column:
    """Half-open year bounds, a form that reaches the scan as a filter."""
    return (value >= F.lit(f"{year}-01-01").cast("date")) & (value < F.lit(f"{year + 1}-01-01").cast("date"))


def header_weight(header: Column) -> Column:
    """Order of table period columns: year * 10 + quarter, plus 3000 for
    ``current`` without a year or 1000 for ``prior`` wording."""
    up = F.upper(F.coalesce(header, F.lit("")))
    year = F.coalesce(F.nullif(F.regexp_extract(up, "((?:20|19)[0-9]{2})", 1), F.lit("")).cast("int"), F.lit(0))
    quarter = F.coalesce(F.nullif(F.regexp_extract(up, "Q([1-4])", 1), F.lit("")).cast("int"), F.lit(0))
    return year * 10 + quarter + F.when(up.contains("CURRENT") & (year == 0), 3000).when(up.rlike("PRIOR|PREVIOUS"), 1000).otherwise(0)
