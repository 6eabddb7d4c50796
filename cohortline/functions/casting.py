"""Repair of wrongly typed text: numbers, integers and dates that become null when unreadable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import as_column

# two-digit years from here on belong to the 20th century
CENTURY_PIVOT = 69


def to_double(c: Column | str) -> Column:
    """Text to number, null when it is none (type suffixes and NaN count as none)."""
    text = F.trim(as_column(c).cast("string"))
    number = text.try_cast("double")
    return F.when(~text.rlike("[dDfF]$") & ~F.isnan(number), number)


def to_long(c: Column | str) -> Column:
    """Text to whole number, truncating a fraction, null when it is none."""
    text = F.trim(as_column(c).cast("string"))
    return F.coalesce(text.try_cast("bigint"), to_double(text).try_cast("bigint"))


def _shift_century(date: Column) -> Column:
    late = F.pmod(F.year(date), F.lit(100)) >= CENTURY_PIVOT
    return F.when(late, F.add_months(date, -1200)).otherwise(date)


def parse_date(c: Column | str, style: str) -> Column:
    """Text to date, null when unreadable.

    Styles: ``mdy2`` 3/31/19, ``ymd2`` 190331, ``mdy4`` 3/31/2019 (a short year is kept as
    written), ``mdy`` either year length and any of ``/ - .`` or blank between, ``iso`` 2019-03-31.
    """
    text = F.trim(as_column(c).cast("string"))
    if style == "mdy2":
        readable = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), text)
        return _shift_century(F.try_to_date(readable, "M/d/yy"))
    if style == "ymd2":
        readable = F.when(text.rlike(r"^\d{6}$"), text)
        return _shift_century(F.try_to_date(readable, "yyMMdd"))
    if style == "mdy4":
        return F.try_to_date(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{1,4}$"), text), "M/d/y")
    if style == "mdy":
        slashed = F.regexp_replace(text, r"[-. ]+", "/")
        return F.coalesce(parse_date(slashed, "mdy2"), parse_date(slashed, "mdy4"))
    if style == "iso":
        return F.try_to_date(text, "yyyy-MM-dd")
    raise ValueError(f"unknown date style {style!r}")


def pivot_year(date: Column | str, reference_year: int = 2018) -> Column:
    """Complete a year written with two digits: above the reference's own two digits it is 19xx.

    A date whose year was written out is left alone.
    """
    date = as_column(date)
    short = F.year(date)
    century = F.when(short > reference_year % 100, F.lit(1900)).otherwise(F.lit(2000))
    # the parsed short year and the full one are leap years alike, so the day always exists
    full = F.make_date(century + short, F.month(date), F.dayofmonth(date))
    return F.when(short < 100, full).otherwise(date)
