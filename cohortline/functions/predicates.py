"""Row predicates that carry a null policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.text import as_column

# Population-frequency ceiling and allele-fraction floor of a candidate.
MAX_POPULATION_FREQUENCY = 1e-4
MIN_ALLELE_FRACTION = 0.3


def rare_or_unknown(c: Column | str, max_freq: float = MAX_POPULATION_FREQUENCY) -> Column:
    c = as_column(c)
    return (c < max_freq) | c.isNull()


def on_or_before(c: Column | str, date: str) -> Column:
    """True up to the end of the day, for dates and timestamps alike; reaches the file scan."""
    return as_column(c) < F.date_add(F.lit(date).cast("date"), 1)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the rows in which every named column has a value."""
    return df.dropna(subset=list(cols))
