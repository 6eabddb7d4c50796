"""Global order without a single sorted partition: prefix scans and exact quantiles.

A window without partition keys moves all rows to one task. Here the ordered column is cut into
ranges of similar size and rows are dealt to tasks by range once. Every range is summed, the few
range totals are accumulated, and the running sum inside a range starts at its range's offset.
Several scans, each reading the results of the ones before, go over the same deal. Cut points steer
the balance only; the result does not depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_RANGES = 16
#: Sampled rows per range, the parts that sort them, and of these the sorted rows per range that meet at last.
OVERSAMPLE, SORTED_IN, KEPT = 256, 8, 32


def _ranges(df: DataFrame) -> int:
    """As many ranges as the session shuffles partitions, rounded up to a power of two."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = MIN_RANGES
    while ranges < wanted:
        ranges *= 2
    return ranges


def _cut_points(df: DataFrame, order: str, measures: Sequence[str], by: Sequence[str], ranges: int) -> Column:
    """Sorted cut values as a scalar subquery (at most ``ranges`` - 1 of them).

    A sample of even hashes of group and value, OVERSAMPLE rows per range, is sorted in SORTED_IN parts;
    every few rows of each go on to the task that takes evenly spaced ones. No task reads more than
    64 rows per range, whatever the number of rows and tasks before.
    """
    # the measures are referenced so that these branches keep the same exchange as the main one,
    # which Spark then reuses instead of scanning the input again
    untouched = reduce(and_, [F.max(m).isNotNull() for m in measures])
    rows = df.agg(F.when(untouched, F.count(F.lit(1))).alias("rows")).scalar()
    draw = F.xxhash64(*by, order)
    share = F.shiftrightunsigned(draw, 11) / float(1 << 53)
    # not a filter, which Spark would move below the aggregate that made the rows
    drawn = F.when(share * F.coalesce(rows, F.lit(0)) < float(OVERSAMPLE * ranges), F.col(order))
    sample = df.select(*measures, F.pmod(draw, F.lit(SORTED_IN)).alias("__part"), drawn.alias("__drawn"))
    parts = sample.groupBy("__part").agg(F.sort_array(F.collect_list("__drawn")).alias("__sorted"), untouched.alias("__whole"))
    # evenly spaced rows of each part; few rows are all passed on
    step = F.greatest(F.lit(1), F.floor(F.size("__sorted") * SORTED_IN / (KEPT * ranges)).cast("int"))
    passed = F.filter("__sorted", lambda _, i: i % step == F.floor(step / 2))
    merged = parts.filter("__whole").agg(F.sort_array(F.flatten(F.collect_list(passed))).alias("m"))
    picked = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)),
        lambda i: F.get("m", F.floor(i * F.size("m") / float(ranges)).cast("int")),
    )
    return merged.select(F.array_distinct(picked)).scalar()


def _by_range(df: DataFrame, order: str, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The rows with ``__place``, their group and range, in place of the group's columns."""
    ranges = _ranges(df)
    ranged = df.withColumns({"__cuts": _cut_points(df, order, measures, by, ranges), "__range": F.lit(0)})
    step = ranges // 2
    while step:
        cut = F.get("__cuts", F.col("__range") + (step - 1))
        ranged = ranged.withColumn("__range", F.col("__range") + F.when(cut < F.col(order), step).otherwise(0))
        step //= 2
    # a struct is never null, so that missing groups meet by plain equality, which keeps the deal
    place = F.struct(*by, "__range").alias("__place")
    return ranged.select(*[c for c in df.columns if c not in by], place)


def placed_by_range(df: DataFrame, order: str, measures: Sequence[str]) -> DataFrame:
    """The rows with ``range``, the number of their range of ``order``; equal values are in one range."""
    return _by_range(df, order, measures, []).withColumn("range", F.col("__place.__range")).drop("__place")


def prefix_scans(
    df: DataFrame,
    order: str,
    by: Sequence[str],
    measures: Sequence[str],
    *levels: Mapping[str, Column],
) -> DataFrame:
    """Add ``cum_<name>`` (inclusive, ascending ``order``) and ``total_<name>`` for the values of each level.

    A level names values to sum; they may use the sums of the levels before, but no ``by`` column. ``df`` holds at most one row per ``by`` and
    ``order`` value; ``measures`` are its columns besides these. Rows are dealt by range once, for all levels: a level
    adds one sum per range and group, and a window inside the ranges.
    """
    by = list(by)
    placed = _by_range(df, order, measures, by)
    rows = placed.repartition("__place")
    inside = Window.partitionBy("__place").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = [F.col(f"__place.{b}") for b in by]
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("__place.__range").rowsBetween(Window.unboundedPreceding, -1)
    # all columns are referenced, so that sums keep the exchanges of the rows and Spark reuses them
    untouched = reduce(and_, [F.max(m).isNotNull() for m in (*measures, order)]).alias("__whole")
    for number, level in enumerate(levels):
        values = {f"__{m}": value for m, value in level.items()}
        # the first level is summed where the rows come from, later ones where they were dealt to
        summed, rows = (rows if number else placed).withColumns(values), rows.withColumns(values)
        sums = summed.groupBy("__place").agg(*[F.sum(m).alias(m) for m in values], untouched).filter("__whole")
        # at most as many rows per group as there are ranges from here on
        offsets = sums.select(
            F.col("__place").alias(f"__place{number}"),
            *[F.coalesce(F.sum(f"__{m}").over(earlier), F.lit(0)).alias(f"__before_{m}") for m in level],
            *[F.sum(f"__{m}").over(whole).alias(f"total_{m}") for m in level],
        )
        running = rows.withColumns({f"__in_{m}": F.sum(f"__{m}").over(inside) for m in level})
        rows = running.join(offsets, F.col("__place") == F.col(f"__place{number}"))
        rows = rows.withColumns({f"cum_{m}": F.col(f"__before_{m}") + F.col(f"__in_{m}") for m in level}).drop(
            f"__place{number}", *[f"{kind}{m}" for m in level for kind in ("__", "__in_", "__before_")]
        )
    return rows.select(*[group.alias(b) for b, group in zip(by, groups)], *[c for c in rows.columns if c != "__place"])


def running_totals(
    df: DataFrame,
    order: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive, ascending ``order``) and ``total_<m>`` for every measure.

    ``df`` holds at most one row per ``by`` and ``order`` value: aggregate to that first.
    """
    found = prefix_scans(df, order, by, measures, {m: F.col(m) for m in measures})
    return found.select(*df.columns, *[f"cum_{m}" for m in measures], *[f"total_{m}" for m in measures])


def value_counts(df: DataFrame, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group and distinct non-null value, as columns ``value`` and ``n``."""
    return (
        df.filter(F.col(measure).isNotNull())
        .groupBy(*by, F.col(measure).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def quantile_columns(probabilities: Mapping[str, float]) -> list[Column]:
    """Aggregates that read linearly interpolated quantiles off running counts of values."""
    columns = []
    for name, p in probabilities.items():
        position = (F.col("total_n") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("cum_n") > F.floor(position), F.col("value")))
        high = F.min(F.when(F.col("cum_n") > F.ceil(position), F.col("value")))
        weight = F.max(position - F.floor(position))
        columns.append((low + (high - low) * weight).alias(name))
    return columns


def exact_quantiles(
    df: DataFrame, measure: str, probabilities: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles per group, named by ``probabilities``.

    The built-in exact percentile keeps all values of a group in one task's memory; running counts
    over distinct values do not.
    """
    counts = running_totals(value_counts(df, measure, by), "value", ["n"], by)
    return counts.groupBy(*by).agg(*quantile_columns(probabilities))
