"""Clinical-significance wording reduced to a small vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import as_column

# Rewrite order, patterns and wording have to be exactly these for equal results.
REWRITES = (
    (".*Benign*", "Benign"),
    (".*benign*", "Likely benign"),
    (".*Other*", "Benign"),
    (".*Pathogenic*", "Pathogenic"),
    ("Pathogenic*.", "Pathogenic"),
    (".*pathogenic*", "Likely pathogenic"),
    (".*pathogenicity", "VUS"),
    (".*VUS", "VUS"),
    (".*Not*", "Not "),
    (".*Risk*", "Risk"),
)
ABSENT = "Not in ClinVar"
ABSENT_PATTERN = ".*provided*"
WHOLE_VALUE = (
    ("pathogenic", "Likely pathogenic"),
    ("Pathogenic", "Pathogenic"),
    ("Drug response", "Drug response"),
    ("Risk factor", "Risk factor"),
    ("VUS", "VUS"),
    ("Not in ClinVar", "Not in ClinVar"),
)


def _anchored(pattern: str) -> str:
    """A pattern that starts with ``.*`` can only match from the start; saying so spares the search
    from every later position where it does not match at all."""
    return f"(?s)^{pattern}" if pattern.startswith(".*") else pattern


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rewrite(value: Column, holds: str, pattern: str, wording: str) -> Column:
    """The replacement where the text that every match has in it occurs; elsewhere the value, which costs far less.

    The lambda names the value of the step before: a plain branch would evaluate the whole chain again for each mention.
    """
    return _let(value, lambda v: F.when(v.contains(holds), F.regexp_replace(v, pattern, wording)).otherwise(v))


def _needed(pattern: str) -> str:
    """The text that each match of a pattern of ``REWRITES`` or ``ABSENT_PATTERN`` has in it: a starred letter may be missing."""
    body = pattern.removeprefix(".*")
    return body[:body.index("*") - 1] if "*" in body else body


def normalize_significance(c: Column | str, squeeze_blanks: bool = True) -> Column:
    """Reduce free significance wording to one label; null stays null.

    The rewrite of ``Not`` leaves a doubled blank in a value that already read
    "Not in ClinVar"; ``squeeze_blanks=False`` keeps that quirk.
    """
    value = as_column(c)
    for pattern, wording in REWRITES:
        value = _rewrite(value, _needed(pattern), _anchored(pattern), wording)
    if squeeze_blanks:
        value = _rewrite(value, "  ", " {2,}", " ")
    value = F.regexp_replace(value, "^$", ABSENT)
    value = _rewrite(value, _needed(ABSENT_PATTERN), _anchored(ABSENT_PATTERN), ABSENT)
    # no wording has a later marker in it, so the first marker that occurs decides
    return _let(value, lambda v: F.coalesce(*[F.when(v.contains(marker), F.lit(wording)) for marker, wording in WHOLE_VALUE], v))
