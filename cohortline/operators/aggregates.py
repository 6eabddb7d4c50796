"""Counts, shares, frequency tables and grouped description."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.keys import as_list, attach
from cohortline.operators.ordered import (
    exact_quantiles,
    quantile_columns,
    running_totals,
    value_counts,
)

MAD_SCALE = 1.4826  # fixed value: makes the median deviation comparable to a standard deviation


def count_by(df: DataFrame, keys: str | Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*as_list(keys)).agg(F.count("*").alias(name))


def having(df: DataFrame, at_least: int, name: str = "count") -> DataFrame:
    return df.filter(F.col(name) >= at_least)


def distinct_per_key(
    df: DataFrame, outer: str | Sequence[str], inner: str | Sequence[str], name: str = "count"
) -> DataFrame:
    """Number of distinct inner keys per outer key, a missing inner key being one of them."""
    return df.groupBy(*as_list(outer)).agg(
        F.count_distinct(F.struct(*as_list(inner))).alias(name)
    )


def unique_count(cols: str | Sequence[str], count_null: bool = True) -> Column:
    """Distinct count of a column or a composite; ``count_null`` counts missing as one value."""
    cols = as_list(cols)
    if count_null:
        return F.count_distinct(F.struct(*cols))
    return F.count_distinct(*cols)


def n_unique(
    df: DataFrame, cols: str | Sequence[str], name: str = "n_unique", count_null: bool = True
) -> DataFrame:
    return df.agg(unique_count(cols, count_null).alias(name))


def n_rows(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def ratio(part: Column, whole: Column) -> Column:
    """Ratio of two counts; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def sum_if(measure: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0))


def cv(measure: Column | str) -> Column:
    """Coefficient of variation as an aggregate; null for one value or a zero mean."""
    return F.try_divide(F.stddev_samp(measure), F.avg(measure))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Rows per value; missing values are not counted."""
    return count_by(df.filter(F.col(col).isNotNull()), col)


def null_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def median(df: DataFrame, measure: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, measure, {name: 0.5}, by)


def count_with_parent_total(
    df: DataFrame, parent: str | Sequence[str], child: str | Sequence[str]
) -> DataFrame:
    """Rows per (parent, child) as ``count`` beside the parent's total as ``freq``.

    Without parent columns the total is over everything.
    """
    parent, child = as_list(parent), as_list(child)
    counts = count_by(df, [*parent, *child])
    if parent:
        return attach(counts, counts.groupBy(*parent).agg(F.sum("count").alias("freq")), parent)
    return counts.withColumn("freq", counts.agg(F.sum("count")).scalar())


def describe_by(
    df: DataFrame, measures: Sequence[str], group: str | Sequence[str], trim: float = 0.1
) -> DataFrame:
    """One row per group and measure: n, mean, sd, median, trimmed mean, mad, min, max, range,
    skew, kurtosis, se.

    Skew is m3/m2^1.5 and kurtosis m4/m2^2 - 3, each with the sample variance in place of m2.
    """
    group = as_list(group)
    long = df.select(
        *group,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x"))
                    for m in measures
                ]
            )
        ).alias("e"),
    ).select(*group, "e.measure", "e.x")
    keys = [*group, "measure"]
    n = F.count("x")
    shrink = (n - 1) / n
    moments = long.groupBy(*keys).agg(
        n.alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        (F.max("x") - F.min("x")).alias("range"),
        (F.skewness("x") * F.pow(shrink, F.lit(1.5))).alias("skew"),
        ((F.kurtosis("x") + 3.0) * shrink * shrink - 3.0).alias("kurtosis"),
        (F.stddev_samp("x") / F.sqrt(n)).alias("se"),
    )
    counts = running_totals(value_counts(long, "x", keys), "value", ["n"], keys)
    # positions cum_n - n + 1 … cum_n hold this value; keep those inside the trimmed span
    cut = F.floor(F.col("total_n") * F.lit(trim))
    inside = F.greatest(
        F.lit(0),
        F.least(F.col("cum_n"), F.col("total_n") - cut)
        - F.greatest(F.col("cum_n") - F.col("n"), cut),
    )
    centre = counts.groupBy(*keys).agg(
        *quantile_columns({"median": 0.5}),
        F.try_divide(F.sum(F.col("value") * inside), F.sum(inside)).alias("trimmed"),
    )
    deviations = (
        attach(value_counts(long, "x", keys), centre.select(*keys, "median"), keys)
        .withColumn("value", F.abs(F.col("value") - F.col("median")))
        .groupBy(*keys, "value")
        .agg(F.sum("n").alias("n"))
    )
    spread = (
        running_totals(deviations, "value", ["n"], keys)
        .groupBy(*keys)
        .agg(*quantile_columns({"mad": 0.5}))
        .withColumn("mad", F.col("mad") * MAD_SCALE)
    )
    return attach(attach(moments, centre, keys), spread, keys)


def top_categories(
    df: DataFrame, category: str, measure: Column | None = None, floor: float | None = None,
    limit: int | None = None, name: str = "count",
) -> DataFrame:
    """Categories ranked by a measure (row count by default), ties in category order."""
    ranked = df.groupBy(category).agg((F.count("*") if measure is None else measure).alias(name))
    if floor is not None:
        ranked = ranked.filter(F.col(name) > floor)
    ranked = ranked.orderBy(F.desc(name), category)
    return ranked if limit is None else ranked.limit(limit)


def sort_history(
    df: DataFrame, keys: Sequence[str], date: str
) -> DataFrame:
    """Order by the keys, the latest date first within them."""
    return df.orderBy(*keys, F.col(date).desc())


def union_extracts(*extracts: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Stack extracts by column name, keeping duplicates."""
    first, *rest = extracts
    for extract in rest:
        first = first.unionByName(extract, allowMissingColumns=allow_missing)
    return first


def distinct_values(df: DataFrame, col: str | Sequence[str]) -> DataFrame:
    return df.select(*as_list(col)).distinct()
