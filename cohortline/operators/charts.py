"""The tidy tables charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.dates import plotted_months
from cohortline.functions.text import variant_key
from cohortline.operators.aggregates import count_with_parent_total
from cohortline.operators.keys import as_list, attach
from cohortline.operators.ordered import quantile_columns, running_totals, value_counts


def trajectory(
    df: DataFrame, days: str, measure: str, series: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Points of a patient's curves: months, value and series label, values outside [0, 1] dropped."""
    return df.filter(F.col(measure).between(0, 1)).select(
        *keep,
        variant_key(*series).alias("series"),
        plotted_months(days).alias("months"),
        F.col(measure),
    )


def stacked_counts(
    df: DataFrame, category: str, fill: str, unique: Sequence[str] | None = None
) -> DataFrame:
    """Bar segments by (category, fill), each with its category's total as ``freq``.

    ``unique`` names the columns that identify one counted item within a segment.
    """
    if unique is not None:
        df = df.select(category, fill, *[c for c in unique if c not in (category, fill)]).distinct()
    return count_with_parent_total(df, category, fill)


def shares(df: DataFrame, category: str, fill: str, unique: Sequence[str] | None = None) -> DataFrame:
    """As :func:`stacked_counts`, with each segment's share of its bar."""
    return stacked_counts(df, category, fill, unique).withColumn(
        "share", F.col("count") / F.col("freq")
    )


def date_histogram(
    df: DataFrame, date: str, origin: str, width_days: int = 15, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per bin of ``width_days`` counted from ``origin``; null dates are left out."""
    start = F.lit(origin).cast("date")
    number = F.floor(F.datediff(date, start) / width_days).cast("int")
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(*by, number.alias("bin"))
        .agg(F.count("*").alias("count"))
        .withColumn("bin_start", F.date_add(start, F.col("bin") * width_days))
    )


def box_summary(df: DataFrame, measure: str, group: str | Sequence[str], reach: float = 1.5) -> DataFrame:
    """Box per group: n, min, quartiles, max, whiskers (furthest values within ``reach`` box
    lengths) and the number of outliers beyond them."""
    group = as_list(group)
    counts = running_totals(value_counts(df, measure, group), "value", ["n"], group)
    boxes = counts.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.min("value").alias("min"),
        *quantile_columns({"q1": 0.25, "median": 0.5, "q3": 0.75}),
        F.max("value").alias("max"),
    )
    values = attach(value_counts(df, measure, group), boxes.select(*group, "q1", "q3"), group)
    length = (F.col("q3") - F.col("q1")) * reach
    within = F.col("value").between(F.col("q1") - length, F.col("q3") + length)
    whiskers = values.groupBy(*group).agg(
        F.min(F.when(within, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(within, F.col("value"))).alias("upper_whisker"),
        F.sum(F.when(within, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )
    return attach(boxes, whiskers, group)


def outliers(df: DataFrame, boxes: DataFrame, measure: str, group: str | Sequence[str]) -> DataFrame:
    """The rows beyond the whiskers of their group's box."""
    group = as_list(group)
    limits = boxes.select(*group, "lower_whisker", "upper_whisker")
    outside = ~F.col(measure).between(F.col("lower_whisker"), F.col("upper_whisker"))
    return attach(df, limits, group, "inner").filter(outside).drop("lower_whisker", "upper_whisker")


def ranked_bars(
    counts: DataFrame, category: str, fill: str, floor: int = 3, keep: Column | None = None
) -> DataFrame:
    """Bars of categories counted more than ``floor`` times, largest first."""
    chosen = counts if keep is None else counts.filter(keep)
    return (
        chosen.filter(F.col("count") > floor)
        .select(category, "count", fill)
        .orderBy(F.desc("count"), category)
    )
