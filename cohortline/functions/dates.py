"""Calendar arithmetic on dates (no time of day anywhere)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import as_column

DAYS_PER_MONTH = 30


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(as_column(end), as_column(start))


def completed_months(start: Column | str, end: Column | str) -> Column:
    """Largest n with ``start`` + n months on or before ``end`` (month ends clamp)."""
    start, end = as_column(start), as_column(end)
    calendar = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return calendar - F.when(F.add_months(start, calendar) > end, 1).otherwise(0)


def followed_months(start: Column | str, end: Column | str, censor_date: str) -> Column:
    """Completed months up to ``end``, or up to the fixed censor date while ``end`` is open."""
    censor = F.lit(censor_date).cast("date")
    return completed_months(start, F.coalesce(as_column(end), censor))


def plotted_months(days: Column | str) -> Column:
    return as_column(days) / F.lit(float(DAYS_PER_MONTH))
