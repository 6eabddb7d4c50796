"""Stability of a repeated measurement and the 1 to 5 grade made of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.text import as_column
from cohortline.operators.aggregates import cv
from cohortline.operators.keys import as_list, attach

SINGLETON_CV = 1.0  # fixed value: a measurement seen once (or all zero) counts as unstable


@dataclass(frozen=True)
class GradeThresholds:
    """Upper CV limits of the steps, and the limits the subject's largest CV is compared with."""

    tight: float
    close: float
    loose: float
    widest: float


# The two threshold sets; B is the one in force.
PRESETS = {
    "A": GradeThresholds(tight=0.03, close=0.05, loose=0.12, widest=0.12),
    "B": GradeThresholds(tight=0.03, close=0.05, loose=0.1, widest=0.2),
}


def grade(v: Column | str, largest: Column | str, preset: str = "B") -> Column:
    """Grade of a CV given the subject's largest CV; the first rule that holds decides."""
    v, largest = as_column(v), as_column(largest)
    t = PRESETS[preset]
    spread, calm = largest > t.loose, largest < t.loose
    close = (v > t.tight) & (v <= t.close)
    return (
        F.when((v <= t.tight) & spread, 1)
        .when((v < t.tight) & calm, 2)
        .when(close & spread, 2)
        .when(close & calm, 3)
        .when((v > t.close) & (v <= t.loose) & spread, 3)
        .when((v > t.close) & (v <= t.widest) & (largest < t.widest), 4)
        .otherwise(5)
    )


def repaired_measure(measure: Column | str, missing: str) -> Column:
    """Missing-value policy: ``zero`` measures a missing value as 0, ``drop`` leaves it out."""
    if missing == "zero":
        return F.coalesce(as_column(measure), F.lit(0.0))
    if missing == "drop":
        return as_column(measure)
    raise ValueError("missing must be 'zero' or 'drop'")


def stability_profile(
    df: DataFrame,
    subject: str,
    variant: str | Sequence[str],
    measure: str,
    preset: str = "B",
    missing: str = "drop",
    singleton: float = SINGLETON_CV,
    date: str | None = None,
) -> DataFrame:
    """One row per subject and variant: ``n_obs``, ``variance`` (the CV), ``max_cv``, ``grade``.

    With ``date`` also ``first_date``, the subject's first test, for which rows without a measure
    count too. All of it comes from one scan: the rows are aggregated before the shuffle, and the
    subject's facts from the variants' facts.
    """
    keys = [subject, *as_list(variant)]
    m = repaired_measure(measure, missing)
    dated = [F.min(date).alias("first_date")] if date else []
    variants = df.groupBy(*keys).agg(
        F.count(m).alias("n_obs"), F.coalesce(cv(m), F.lit(singleton)).alias("variance"), *dated
    )
    measured = F.col("n_obs") > 0
    subjects = variants.groupBy(subject).agg(
        F.max(F.when(measured, F.col("variance"))).alias("max_cv"),
        *([F.min("first_date").alias("first_date")] if date else []),
    )
    return (
        attach(variants.filter(measured).drop("first_date"), subjects, subject)
        .withColumn("grade", grade("variance", "max_cv", preset))
    )


def with_cv(
    df: DataFrame, keys: str | Sequence[str], measure: str, singleton: float = SINGLETON_CV
) -> DataFrame:
    """Add the group's CV as ``variance`` and its size as ``n_obs``."""
    facts = df.groupBy(*as_list(keys)).agg(
        F.count(measure).alias("n_obs"),
        F.coalesce(cv(measure), F.lit(singleton)).alias("variance"),
    )
    return attach(df, facts, keys)


def with_grade(
    df: DataFrame,
    subject: str,
    variant: str | Sequence[str],
    measure: str,
    preset: str = "B",
    missing: str = "drop",
    date: str | None = None,
) -> DataFrame:
    """Rows with ``variance``, ``max_cv``, ``grade`` and ``n_obs`` attached.

    Under the ``drop`` policy rows without a measure are left out, under ``zero`` they count as 0.
    """
    profile = stability_profile(df, subject, variant, measure, preset, missing, date=date)
    kept = df.withColumn(measure, repaired_measure(measure, missing))
    if missing == "drop":
        kept = kept.filter(F.col(measure).isNotNull())
    return attach(kept, profile, [subject, *as_list(variant)], "inner")


def grade_histogram(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observations and variants per grade, read off the profile without touching the rows again."""
    return profile.groupBy(*by, "grade").agg(
        F.sum("n_obs").alias("n_rows"), F.count("*").alias("n_variants")
    )
