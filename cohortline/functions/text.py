"""Text repair and name building, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NA"
KEY_SEPARATOR = "   "


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shown(c: Column | str) -> Column:
    """The value as text, with a missing value spelled out so that names never turn null."""
    return F.coalesce(as_column(c).cast("string"), F.lit(MISSING))


def unescape_gt(c: Column | str) -> Column:
    return F.replace(as_column(c), F.lit("&gt;"), F.lit(">"))


def split_pair(c: Column | str, separator: str = ":") -> tuple[Column, Column]:
    """First and second part; later parts are dropped and an absent part is null."""
    parts = F.split(as_column(c), f"\\Q{separator}\\E")
    return F.get(parts, 0), F.get(parts, 1)


def variant_name(
    reference: Column | str, gene: Column | str, change: Column | str, protein: Column | str
) -> Column:
    """``reference(gene):change (protein)``."""
    return F.concat(
        shown(reference), F.lit("("), shown(gene), F.lit("):"),
        shown(change), F.lit(" ("), shown(protein), F.lit(")"),
    )


def variant_key(*parts: Column | str) -> Column:
    """One text key out of several columns; both sides of a join must build it here."""
    return F.concat_ws(KEY_SEPARATOR, *[shown(p) for p in parts])


def strip_from(c: Column | str, marker: str) -> Column:
    """Drop everything from the first match of ``marker`` (a regular expression) on."""
    return F.regexp_replace(as_column(c), f"(?s){marker}.*", "")


def compact(*parts: Column | str) -> Column:
    """Join the parts and remove every blank."""
    return F.replace(F.concat(*[shown(p) for p in parts]), F.lit(" "), F.lit(""))


def empty_to(c: Column | str, default: str) -> Column:
    c = as_column(c)
    return F.when(c == "", F.lit(default)).otherwise(c)


def null_to(c: Column | str, default) -> Column:
    return F.coalesce(as_column(c), F.lit(default))


def blank_to(c: Column | str, default: str) -> Column:
    """Replace both the empty and the missing value."""
    return null_to(empty_to(c, default), default)


def between_parentheses(c: Column | str) -> Column:
    """Text from the first ``(`` to the last ``)``; null without such a pair or if it is empty."""
    return F.nullif(F.regexp_extract(as_column(c), r"\((.*)\)", 1), F.lit(""))


def contains_any(c: Column | str, patterns: Sequence[str], regex: bool = False) -> Column:
    """True where any of the patterns occurs in the text; null where the text is null."""
    c = as_column(c)
    tests = [c.rlike(p) if regex else c.contains(p) for p in patterns]
    return reduce(or_, tests)
