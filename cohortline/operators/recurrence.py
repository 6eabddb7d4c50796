"""Variants that come back in a subject's later tests, and the candidates among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.predicates import (
    MAX_POPULATION_FREQUENCY,
    MIN_ALLELE_FRACTION,
    drop_incomplete,
    rare_or_unknown,
)
from cohortline.operators.aggregates import distinct_per_key, having
from cohortline.operators.joins import semi_join
from cohortline.operators.keys import attach
from cohortline.session import durable


def recurrent_panel(
    df: DataFrame,
    subject: str = "mrn",
    patient: str = "patient",
    gene: str = "gene",
    protein: str = "p_nom",
    name: str = "name",
    at_least: int = 2,
    strict_pairs: bool = False,
) -> DataFrame:
    """Rows of recurrent variants with their ``count`` per patient and name.

    A subject qualifies by two calls in one gene; then by default a row stays if its protein change
    recurs in *some* qualifying subject and its subject has *some* recurring change.
    ``strict_pairs`` asks for the subject's own change. The recurring changes, a small part of the calls, are written once;
    rows meet them by membership, and what is left its own counts.
    """

    def recurring(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        return having(frame.groupBy(*keys).agg(F.count("*").alias("count")), at_least)

    def among(frame: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
        return semi_join(frame, keys, on, null_safe=True)  # a missing key recurs like any other

    in_gene = recurring(df, [patient, subject, gene])
    changed = recurring(df, [patient, subject, protein]).select(subject, protein)
    changes = durable(among(changed, in_gene, [subject]).distinct())
    if strict_pairs:
        kept = among(df, changes, [subject, protein])
    else:
        kept = among(among(df, changes, [protein]), changes, [subject])
    kept = drop_incomplete(kept, [patient])
    return attach(kept, recurring(kept, [patient, name]), [patient, name], "inner")


def candidates_panel(
    df: DataFrame,
    af: str = "af",
    frequency: str = "allele_frequency",
    min_af: float = MIN_ALLELE_FRACTION,
    max_freq: float = MAX_POPULATION_FREQUENCY,
) -> DataFrame:
    """Large enough allele fraction, and rare in the population or unknown there."""
    return df.filter((F.col(af) >= min_af) & rare_or_unknown(frequency, max_freq))


def recurrent_broad(
    df: DataFrame,
    subject: str = "cgl",
    variant: str = "g_nomen",
    in_scope: str = "in_blood",
    at_least: int = 2,
    sample: str | None = None,
) -> DataFrame:
    """In-scope rows whose variant is seen ``at_least`` times in a subject with several variants.

    The subject test counts distinct variants; with ``sample`` it counts distinct samples instead.
    """
    scope = F.coalesce(F.col(in_scope), F.lit(False))
    groups = df.groupBy(subject, variant).agg(F.count_if(scope).alias("count"))
    tested = having(distinct_per_key(df if sample else groups, subject, sample or variant, "__n"), at_least, "__n")
    recurring = attach(having(groups, at_least), tested.select(subject), subject, "inner")
    return attach(df.filter(scope), recurring, [subject, variant], "inner")


def candidates_broad(
    df: DataFrame,
    grade: str = "grade",
    frequency: str = "gnomad_alt_freq_all",
    grades: Sequence[int] = (1, 2),
    max_freq: float = MAX_POPULATION_FREQUENCY,
) -> DataFrame:
    return df.filter(F.col(grade).isin(*grades) & rare_or_unknown(frequency, max_freq))
