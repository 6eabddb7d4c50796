"""Facts about a row's group: first row, earliest date, maximum, distinct count, group number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.keys import attach
from cohortline.operators.ordered import running_totals


def _list(names) -> list:
    return [names] if isinstance(names, (str, Column)) else list(names)


def first_per_key(
    df: DataFrame, keys: str | Sequence[str], order_by: Column | str | Sequence[Column | str]
) -> DataFrame:
    """The first row of every key in a total order.

    Ranking with a constant bound lets Spark limit each key before the shuffle, so a hot key
    sends one row per input task. The keys' hash leads the sort: rows of different keys are then told
    apart by one number, while texts that begin alike would be compared byte by byte, column by column.
    """
    keys = _list(keys)
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*_list(order_by))
    return (
        df.withColumn("__position", F.row_number().over(window))
        .filter(F.col("__position") == 1)
        .drop("__position")
    )


def keep_earliest(df: DataFrame, key: str | Sequence[str], date: str) -> DataFrame:
    """All rows at their group's smallest date (ties stay)."""
    first = df.groupBy(*_list(key)).agg(F.min(date).alias("__first"))
    return attach(df, first, key, "inner").filter(F.col(date) == F.col("__first")).drop("__first")


def with_time_offset(
    df: DataFrame, key: str | Sequence[str], date: str, name: str = "time_point"
) -> DataFrame:
    """Days since the group's first date; null dates neither count nor get an offset."""
    first = df.groupBy(*_list(key)).agg(F.min(date).alias("__first"))
    return (
        attach(df, first, key)
        .withColumn(name, F.datediff(date, "__first"))
        .drop("__first")
    )


def with_distinct_count(
    df: DataFrame, key: str | Sequence[str], col: str, name: str, count_null: bool = True
) -> DataFrame:
    """Number of distinct values of ``col`` in the row's group, a missing value being one."""
    counted = F.struct(col) if count_null else F.col(col)
    facts = df.groupBy(*_list(key)).agg(F.count_distinct(counted).alias(name))
    return attach(df, facts, key)


def with_group_max(
    df: DataFrame, key: str | Sequence[str], measure: str, name: str
) -> DataFrame:
    return attach(df, df.groupBy(*_list(key)).agg(F.max(measure).alias(name)), key)


def with_group_id(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Number the groups 1, 2, 3, … by sorted key; every row gets its group's number.

    The distinct keys are ranked range by range (see ``running_totals``), so no task sorts them all.
    """
    keys = df.groupBy(key).agg(F.lit(1).alias("__one")).dropna(subset=[key])
    numbered = running_totals(keys, key, ["__one"]).select(
        key, F.col("cum___one").cast("bigint").alias(name)
    )
    # sorted group numbering puts the missing key last
    total = keys.agg(F.count("*") + 1).scalar()
    return attach(df, numbered, key).withColumn(
        name, F.when(F.col(key).isNull(), total).otherwise(F.col(name))
    )
