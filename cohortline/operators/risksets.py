"""Risk sets in long form: rows (time, pattern) for the patterns of covariates that occur, cut into ranges of time.

A range is one row that can be worked on by itself: besides its times it holds how many of each pattern are still followed
after it. Neither the number of possible patterns nor the number of times is spread over columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.ordered import placed_by_range
from cohortline.session import durable, ship

#: Times by patterns that are written out at once in a task.
CELLS = 1 << 21
#: Partial sums of so many numbers go to the driver as they are; more are added up in between.
SENT_NUMBERS = 1 << 21
ADDERS = 16

#: One partial sum from deaths and followed (times by patterns) and the patterns' numbers.
Partial = Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[np.ndarray]]


def pattern_number(levels: Mapping[str, Sequence]) -> Column:
    """The number of a row's pattern: its levels as digits, the last covariate's the fastest; null with a level not listed."""
    number = F.lit(0).cast("long")
    for column, values in levels.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
        number = number * len(values) + F.when(place > 0, place - 1)
    return number


def pattern_levels(number: int, levels: Mapping[str, Sequence]) -> dict[str, int]:
    """Which level, from 0, each covariate has in a pattern."""
    found = {}
    for column in reversed(levels):
        number, found[column] = divmod(number, len(levels[column]))
    return found


def long_risk_sets(df: DataFrame, time: str, event: str, number: Column) -> DataFrame:
    """A durable table with a row per range of time: arrays ``time``, ``pattern``, ``d``, ``n`` of what ends there, and ``later``
    and ``n_later``, patterns and counts of all with a later time. Runs when called. Null times are left out."""
    happened = F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    counts = (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(time).alias("time"), number.alias("pattern"))
        .agg(F.count_if(happened).alias("d"), F.count("*").alias("n"))
    )
    placed = durable(placed_by_range(counts, "time", ["d", "n"]))
    ranges = placed.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("time", "pattern", "d", "n"))).alias("rows"))
    held = placed.groupBy("range", "pattern").agg(F.sum("n").alias("n"))
    # every pattern in every range, as a pattern may rest in some
    every = held.select("pattern").distinct().withColumn("all", placed.agg(F.collect_set("range")).scalar())
    every = every.select(F.col("pattern").alias("later"), F.explode("all").alias("in_range"))
    after = Window.partitionBy("later").orderBy("in_range").rowsBetween(1, Window.unboundedFollowing)
    still = (
        every.join(held, (F.col("range") == F.col("in_range")) & (F.col("pattern") == F.col("later")), "left")
        .select("in_range", "later", F.sum("n").over(after).alias("n_later"))
        .filter("n_later > 0")
        .groupBy("in_range")
        .agg(F.collect_list(F.struct("later", "n_later")).alias("still"))
    )
    whole = ranges.join(still, F.col("range") == F.col("in_range"), "left")
    return durable(whole.select(
        "range", *[F.col(f"rows.{c}").alias(c) for c in ("time", "pattern", "d", "n")],
        *[F.coalesce(F.col(f"still.{c}"), F.array().cast("array<long>")).alias(c) for c in ("later", "n_later")],
    ))


def _blocks(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Deaths and followed of a range's times by its patterns, times with deaths only, a bounded number of cells at a time."""
    pattern, later = np.asarray(row.pattern, np.int64), np.asarray(row.later, np.int64)
    known = np.unique(np.concatenate([pattern, later]))
    followed = np.zeros(len(known))
    followed[np.searchsorted(known, later)] = np.asarray(row.n_later, float)
    at = np.unique(np.asarray(row.time), return_inverse=True)[1]
    column, d, n = np.searchsorted(known, pattern), np.asarray(row.d, float), np.asarray(row.n, float)
    times, size = int(at[-1]) + 1, max(1, CELLS // len(known))
    for low in range((times - 1) // size * size, -1, -size):  # the last times first
        here = slice(np.searchsorted(at, low), np.searchsorted(at, low + size))
        deaths, ended = np.zeros((2, min(size, times - low), len(known)))
        deaths[at[here] - low, column[here]] = d[here]
        ended[at[here] - low, column[here]] = n[here]
        ended[-1] += followed
        risk = ended[::-1].cumsum(axis=0)[::-1]
        followed = risk[0]
        eventful = deaths.sum(axis=1) > 0
        yield deaths[eventful], risk[eventful], known


def summed(sets: DataFrame, partial: Partial, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """The arrays of these shapes that ``partial`` gives for blocks of the risk sets, added up over all of them."""
    ship(sets.sparkSession)
    sizes = [int(np.prod(s)) for s in shapes]
    total = sum(sizes)

    def of_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = np.zeros(total)
            for row in frame.itertuples(index=False):
                for deaths, risk, known in _blocks(row):
                    if len(deaths):
                        sums += np.concatenate([np.ravel(x) for x in partial(deaths, risk, known)])
            yield pd.DataFrame({"part": [int(frame["range"].iloc[0]) % ADDERS], "sums": [sums]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"].iloc[:1], "sums": [np.sum(np.stack(frame["sums"]), axis=0)]})

    sums = sets.mapInPandas(of_ranges, "part int, sums array<double>")
    if total * sets.rdd.getNumPartitions() > SENT_NUMBERS:
        sums = sums.groupBy("part").applyInPandas(added, "part int, sums array<double>")
    flat = reduce(np.add, [np.array(r.sums) for r in sums.collect()], np.zeros(total))
    ends = np.cumsum(sizes)
    return [flat[e - s:e].reshape(shape) for s, e, shape in zip(sizes, ends, shapes)]


def observed_patterns(sets: DataFrame) -> list[int]:
    """Numbers of all patterns that occur, sorted; there are no more than there are different subjects."""
    return sorted(r[0] for r in sets.select(F.explode("pattern")).distinct().collect() if r[0] is not None)
