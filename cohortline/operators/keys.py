"""Key lists, and group facts joined back onto rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def attach(
    df: DataFrame, facts: DataFrame, keys: str | Sequence[str], how: str = "left"
) -> DataFrame:
    """Join one row of ``facts`` per key back onto the rows; a null key meets a null key.

    Used with facts that were aggregated first, instead of a window over the rows: a subject that
    owns a large share of the rows then never has to be sorted by one task. A fact replaces a column
    of the same name.
    """
    keys = as_list(keys)
    df = df.drop(*[c for c in facts.columns if c not in keys])
    right = facts.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in facts.columns if c not in keys],
    )
    same = reduce(and_, [df[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return df.join(right, same, how).drop(*[f"__{k}" for k in keys])
