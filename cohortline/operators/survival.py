"""Kaplan-Meier curves, risk tables and the log-rank test.

One row per group and time remains after the first aggregation. Time may have any scale, fractional too, so there may be
as many time points as subjects: sums over them are prefix scans over ranges (``prefix_scans``), never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.tails import chi_square_tail
from cohortline.operators.keys import as_list
from cohortline.operators.ordered import prefix_scans, running_totals
from cohortline.operators.risksets import long_risk_sets, pattern_number, summed

#: Groups of a test, by default: it has a system of as many equations, solved on the driver.
MAX_GROUPS = 4096
#: A test of so many groups has two columns per group; more are summed in long form.
WIDE_GROUPS = 3


def _still(n: str) -> Column:
    """The sum from the row's time on: all but what is earlier."""
    return F.col(f"total_{n}") - F.col(f"cum_{n}") + F.col(n)


def _at_risk(counts: DataFrame, measures: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """The measures replaced by their sums from each time on."""
    totals = running_totals(counts, "time", list(measures), strata)
    return totals.withColumns({m: _still(m) for m in measures}).select(*counts.columns)


def _event_counts(df: DataFrame, time: str, event: str, strata: Sequence[str]) -> DataFrame:
    """``n_event``, ``n_censor`` and their sum ``n`` per group and time. Null times are left out."""
    happened = F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    counts = (
        df.filter(F.col(time).isNotNull())
        .groupBy(*strata, F.col(time).alias("time"))
        .agg(F.count_if(happened).alias("n_event"), F.count_if(~happened).alias("n_censor"))
    )
    return counts.withColumn("n", F.col("n_event") + F.col("n_censor"))


def _scanned(
    df: DataFrame, time: str, event: str, strata: Sequence[str], steps: Mapping[str, Callable[[Column, Column], Column]]
) -> DataFrame:
    """The life table with the running sums of ``steps``, functions of the deaths and those at risk.

    The first scan finds who is at risk, the second sums what depends on it, over one deal of the rows by range.
    """
    counts = _event_counts(df, time, event, strata)
    d, n = F.col("n_event").cast("double"), _still("n").cast("double")
    levels = [{"n": F.col("n")}, {m: step(d, n) for m, step in steps.items()}]
    found = prefix_scans(counts, "time", strata, ["n_event", "n_censor", "n"], *[x for x in levels if x])
    return found.withColumn("n_risk", _still("n"))


def life_table(
    df: DataFrame, time: str, event: str, strata: str | Sequence[str] = ()
) -> DataFrame:
    """One row per group and time: ``n_event``, ``n_censor``, ``n_risk``. Null times are left out."""
    strata = as_list(strata)
    return _scanned(df, time, event, strata, {}).select(*strata, "time", "n_event", "n_censor", "n_risk")


def km_curve(
    df: DataFrame, time: str, event: str, strata: str | Sequence[str] = (), conf: float = 0.95
) -> DataFrame:
    """Kaplan-Meier curve per group, with Greenwood's standard error and a confidence interval on
    the log scale. Error and limits are null once survival has reached 0."""
    strata = as_list(strata)
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    # survival is the exponential of summed logs, and 0 from the first time on at which all die
    summed = _scanned(df, time, event, strata, {
        "log": lambda d, n: F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
        "end": lambda d, n: F.when(d < n, 0).otherwise(1),
        "greenwood": lambda d, n: F.when(d < n, d / (n * (n - d))).otherwise(0.0),
    })
    alive = F.col("survival") > 0
    half_width = z * F.sqrt("cum_greenwood")
    return (
        summed.withColumn("survival", F.when(F.col("cum_end") > 0, 0.0).otherwise(F.exp("cum_log")))
        .withColumns(
            {
                "std_err": F.when(alive, F.col("survival") * F.sqrt("cum_greenwood")),
                "lower": F.when(alive, F.col("survival") * F.exp(-half_width)),
                "upper": F.when(alive, F.least(F.lit(1.0), F.col("survival") * F.exp(half_width))),
            }
        )
        .select(
            *strata, "time", "n_risk", "n_event", "n_censor", "survival", "std_err", "lower", "upper"
        )
    )


def _points_before(value: Column, points: Sequence, included: bool) -> Column:
    """How many of the sorted points are below the value, or not above it if ``included``, by bisection."""
    given = F.array(*[F.lit(p) for p in points])
    low, size = F.lit(0), 1
    while size <= len(points):
        size *= 2

    def further(at: Column, step: int) -> Column:
        point = F.get(given, at + (step - 1))
        return at + F.when(point <= value if included else point < value, step).otherwise(0)

    while size > 1:
        size //= 2
        # in an array of one, so that it is worked out once
        low = F.get(F.transform(F.array(low), lambda at: further(at, size)), F.lit(0))
    return low


def _by_horizon(found: DataFrame, points: Sequence, strata: Sequence[str]) -> DataFrame:
    """A row per group of ``found``, number ``i`` and its ``horizon``, with the columns of ``found`` whose ``__interval`` it is
    (null where there is none), and one without a horizon for the interval after the last point."""
    columns = [c for c in found.columns if c not in (*strata, "__interval")]
    groups = found.select(*strata).distinct() if strata else found.sparkSession.range(1).select()
    asked = groups.select(*strata, F.posexplode(F.array(*[F.lit(p) for p in points], F.lit(None))).alias("i", "horizon"))
    right = found.select(F.struct(*strata, F.col("__interval").alias("i")).alias("__key"), *columns)
    return asked.join(right, F.struct(*strata, "i") == F.col("__key"), "left").drop("__key")


def km_at(
    curve: DataFrame,
    times: Sequence[int],
    strata: str | Sequence[str] = (),
    extend: bool = False,
) -> DataFrame:
    """Survival at requested times: the last step at or before each; certain (1, error 0) before the
    first step.

    ``n_risk`` counts those followed at least that long. A time beyond a group's follow-up gives no
    row unless ``extend``. Every step goes to the interval between two requested times it is in, so that one row
    per group and interval is left, whatever the number of either.
    """
    strata = as_list(strata)
    points = sorted(set(times))
    values = {"survival": 1.0, "std_err": 0.0, "lower": 1.0, "upper": 1.0}
    at = F.get(F.array(*[F.lit(p) for p in points]), "__interval")
    found = curve.withColumn("__interval", _points_before(F.col("time"), points, included=False)).groupBy(*strata, "__interval").agg(
        *[F.max_by(c, "time").alias(f"__{c}") for c in values],
        F.max("time").alias("__time"),
        F.max(F.when(F.col("time") == at, F.col("n_risk"))).alias("__here"),
        F.min_by("n_risk", "time").alias("__next"),
    )
    rows = _by_horizon(found, points, strata)
    order = Window.partitionBy(*strata).orderBy("i")  # as many rows per group as times are asked for
    later = order.rowsBetween(1, Window.unboundedFollowing)
    last_step = F.when(F.col("__time").isNotNull(), F.struct(*[F.col(f"__{c}").alias(c) for c in values]))
    rows = rows.withColumns({
        "__step": F.last(last_step, ignorenulls=True).over(order),
        "n_risk": F.coalesce("__here", F.first("__next", ignorenulls=True).over(later), F.lit(0)),
        "__followed": F.max("__time").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).filter(F.col("horizon").isNotNull())
    if not extend:
        rows = rows.filter(F.col("horizon") <= F.col("__followed"))
    reached = F.col("__step").isNotNull()
    return rows.select(
        *strata, "horizon", *[F.when(reached, F.col(f"__step.{c}")).otherwise(F.lit(before)).alias(c) for c, before in values.items()], "n_risk"
    )


def km_cumhaz(curve: DataFrame, strata: str | Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard, -log of survival (null at 0)."""
    hazard = F.when(F.col("survival") > 0, -F.log("survival"))
    return curve.select(*as_list(strata), "time", hazard.alias("cumhaz"))


def nelson_aalen(df: DataFrame, time: str, event: str, strata: str | Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard per group, the running sum of deaths by those at risk."""
    strata = as_list(strata)
    return _scanned(df, time, event, strata, {"hazard": lambda d, n: d / n}).select(*strata, "time", F.col("cum_hazard").alias("cumhaz"))


def risk_table(
    df: DataFrame, time: str, grid: Sequence[int], strata: str | Sequence[str] = ()
) -> DataFrame:
    """Number still followed at each grid time, per group (0 where nobody is)."""
    strata = as_list(strata)
    points = sorted(set(grid))
    # the last point that a time reaches: it counts there and at those before
    reached = (_points_before(F.col(time), points, included=True) - 1).alias("__interval")
    found = df.filter(F.col(time).isNotNull()).groupBy(*strata, reached).agg(F.count("*").alias("n"))
    onward = Window.partitionBy(*strata).orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at_risk = F.coalesce(F.sum("n").over(onward), F.lit(0)).alias("n_risk")
    return _by_horizon(found, points, strata).select(*strata, "horizon", at_risk).filter(F.col("horizon").isNotNull())


def level_values(df: DataFrame, strata: str | Sequence[str], most: int = MAX_GROUPS) -> list:
    """Sorted values of a column, or tuples of several; more than ``most`` raise."""
    columns = as_list(strata)
    found = df.dropna(subset=columns).select(*columns).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{', '.join(columns)} has more than {most} levels")
    values = [tuple(row) for row in found]
    return sorted(values if len(columns) > 1 else [v for v, in values])


def group_conditions(strata: str | Sequence[str], levels: Sequence) -> list[Column]:
    """One condition per level: a value of the column, or a tuple of the columns' values."""
    columns = as_list(strata)
    return [
        reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(columns, level if len(columns) > 1 else (level,))])
        for level in levels
    ]


def risk_sets(df: DataFrame, time: str, event: str, groups: Sequence[Column], known: Column | None = None) -> DataFrame:
    """One row per time: deaths ``d0``, ``d1``, … and at-risk counts ``n0``, ``n1``, … per group, and
    ``strays``, rows with a ``known`` level that is in no group.

    ``groups`` are conditions that exclude one another, one per group. A single pass over the rows.
    """
    happened = F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    listed = reduce(or_, [F.coalesce(g, F.lit(False)) for g in groups])
    stray = (known if known is not None else F.lit(False)) & ~listed
    per_time = (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(time).alias("time"))
        .agg(
            *[F.count_if(g & happened).alias(f"d{i}") for i, g in enumerate(groups)],
            *[F.count_if(g).alias(f"n{i}") for i, g in enumerate(groups)],
            F.count_if(stray).alias("strays"),
        )
    )
    return _at_risk(per_time, [f"n{i}" for i in range(len(groups))])


def logrank(
    df: DataFrame, time: str, event: str, strata: str | Sequence[str], levels: Sequence | None = None,
    max_groups: int = MAX_GROUPS,
) -> DataFrame:
    """Log-rank test across groups: one row with ``n``, ``events``, ``chi2``, ``df``, ``p``.

    Groups are the levels of one column, or the combinations of several (``levels`` are then tuples). A row with a missing level is
    left out; one with a level that is not listed fails the test when it runs. With ``levels`` given and at
    most three of them the result is one lazy plan. More groups are summed when called, and need a matrix inverse, done
    on the driver with the (k-1)² sums Spark computed; ``max_groups`` bounds it.
    """
    levels = list(levels) if levels is not None else level_values(df, strata, max_groups)
    if len(levels) < 2:
        raise ValueError("at least two groups are needed")
    if len(levels) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    k = len(levels)
    if k > WIDE_GROUPS:
        return _logrank_long(df, time, event, as_list(strata), levels)
    known = reduce(and_, [F.col(c).isNotNull() for c in as_list(strata)])
    sets = risk_sets(df, time, event, group_conditions(strata, levels), known)
    d = sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0")).cast("double")
    n = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0")).cast("double")
    sets = sets.withColumns({"d": d, "n": n}).withColumn(
        "c", F.coalesce(F.try_divide(F.col("d") * (F.col("n") - F.col("d")), F.col("n") - 1), F.lit(0.0))
    )
    free = range(k - 1)

    def part(i: int) -> Column:
        return F.try_divide(F.col(f"n{i}").cast("double"), F.col("n"))

    sums = [
        F.sum(F.col(f"d{i}") - F.col("d") * part(i)).alias(f"u{i}") for i in free
    ] + [
        F.sum(F.col("c") * part(i) * ((1.0 if i == j else 0.0) - part(j))).alias(f"v{i}{j}")
        for i in free
        for j in free
        if i <= j
    ]
    stats = sets.agg(
        F.when(F.sum("strays") > 0, F.raise_error(F.concat(F.sum("strays").cast("string"), F.lit(" rows have a level that is not listed"))))
        .otherwise(F.max("n")).cast("bigint").alias("n"),
        F.sum("d").cast("bigint").alias("events"), *sums
    )
    if k == 2:
        chi2 = F.try_divide(F.col("u0") * F.col("u0"), F.col("v00"))
    else:
        u0, u1 = F.col("u0"), F.col("u1")
        v00, v01, v11 = F.col("v00"), F.col("v01"), F.col("v11")
        chi2 = F.try_divide(
            u0 * u0 * v11 - 2.0 * u0 * u1 * v01 + u1 * u1 * v00, v00 * v11 - v01 * v01
        )
    return stats.select("n", "events", chi2.alias("chi2")).select(
        "n",
        "events",
        "chi2",
        F.lit(k - 1).alias("df"),
        chi_square_tail("chi2", k - 1).alias("p"),
    )


def _logrank_long(df: DataFrame, time: str, event: str, columns: Sequence[str], levels: Sequence) -> DataFrame:
    """The test of many groups: scores and their covariance are added up over ranges of the long risk sets."""
    tuples = [level if len(columns) > 1 else (level,) for level in levels]
    values = {c: sorted({t[i] for t in tuples}) for i, c in enumerate(columns)}
    sets = long_risk_sets(df.dropna(subset=list(columns)), time, event, pattern_number(values))
    number = {}
    for group, level in enumerate(tuples):
        code = 0
        for c, v in zip(columns, level):
            code = code * len(values[c]) + values[c].index(v)
        number[code] = group
    each = sets.select(F.inline(F.arrays_zip("pattern", "d", "n"))).groupBy("pattern").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()
    strays = sum(r.n for r in each if r.pattern not in number)
    if strays:
        raise ValueError(f"{strays} rows have a level that is not listed")
    k = len(levels)
    codes = np.array(sorted(number), np.int64)
    place = np.array([number[c] for c in codes.tolist()])

    def partial(deaths: np.ndarray, risk: np.ndarray, known: np.ndarray):
        at = place[np.searchsorted(codes, known)]
        d, n = deaths.sum(axis=1), risk.sum(axis=1)
        c = np.divide(d * (n - d), n - 1, out=np.zeros_like(d), where=n > 1)
        score, spread, product = np.zeros(k), np.zeros(k), np.zeros((k, k))
        score[at] = deaths.sum(axis=0) - (d / n) @ risk
        spread[at] = (c / n) @ risk
        product[np.ix_(at, at)] = risk.T @ (risk * (c / n**2)[:, None])
        return score, spread, product

    u, spread, product = summed(sets, partial, [(k,), (k,), (k, k)])
    u, v = u[:-1], (np.diag(spread) - product)[:-1, :-1]
    chi2 = float(u @ np.linalg.pinv(v) @ u)
    row = df.sparkSession.createDataFrame([(int(sum(r.n for r in each)), int(sum(r.d for r in each)), chi2)], "n long, events long, chi2 double")
    return row.select("n", "events", "chi2", F.lit(k - 1).alias("df"), chi_square_tail("chi2", k - 1).alias("p"))
