"""Subjects: follow-up table, exposure groups, review status, inheritance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.casting import parse_date, to_long
from cohortline.functions.dates import followed_months
from cohortline.functions.text import between_parentheses
from cohortline.operators.joins import accumulate_tags, annotate, semi_join
from cohortline.operators.keyed import first_per_key

# The dates survival status was last known, for age and for follow-up.
CENSOR_AGE = "2021-06-25"
CENSOR_FOLLOWUP = "2021-12-31"

INHERITANCE_TAGS = {"AR": ["AR"], "AD": ["AD", "AD/AR"], "X-linked": ["X-linked"]}
REVIEW_PRIORITY = ("P", "VUS", "B")
CLINICAL_COLUMNS = (
    "sex",
    "onco_tree_specimen_site",
    "onco_tree_primary_tumor_site",
    "onco_tree_diagnosis",
    "percent_tumor",
)


def parse_subjects(os: DataFrame) -> DataFrame:
    """Patient number out of ``name (number)`` and the three dates; bad text becomes null."""
    return os.withColumns(
        {
            "mrn": to_long(between_parentheses("patient_name_mrn")),
            "order_date": parse_date("order_date", "mdy4"),
            "birth_date": parse_date("date_of_birth", "mdy4"),
            "death_date": parse_date("death_date", "mdy4"),
        }
    )


def build_subjects(
    os: DataFrame,
    sequenced: DataFrame,
    clinical: DataFrame | None = None,
    clinical_order: Sequence[str] = ("order_date",),
    censor_age: str = CENSOR_AGE,
    censor_followup: str = CENSOR_FOLLOWUP,
    key: str = "mrn",
    clinical_columns: Sequence[str] = CLINICAL_COLUMNS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per sequenced subject at its earliest order: ``event`` (died), ``age_months``,
    ``landmark`` (completed months followed), and its clinical columns.

    ``os`` has key, ``order_date``, ``birth_date`` and ``death_date`` (see ``parse_subjects``).
    """
    known = semi_join(os, sequenced.filter(F.col(key).isNotNull()), key)
    dated = known.filter(F.col("order_date").isNotNull())
    earliest = first_per_key(dated, key, ["order_date", *tie_break])
    followed = earliest.withColumns(
        {
            "event": F.col("death_date").isNotNull(),
            "age_months": followed_months("birth_date", "death_date", censor_age),
            "landmark": followed_months("order_date", "death_date", censor_followup),
        }
    )
    if clinical is None:
        return followed
    return annotate(followed, clinical, key, list(clinical_columns), dedupe_by=list(clinical_order))


def exposure_groups(
    subjects: DataFrame,
    candidates: DataFrame,
    key: str = "mrn",
    grade: str = "grade",
    inheritance: str = "inheritance_blood",
    significance: str | None = "significance",
    in_scope: DataFrame | None = None,
    calls: DataFrame | None = None,
) -> DataFrame:
    """Exposure of each subject, from one aggregation of its candidate variants.

    ``in_germline`` any candidate; ``exposed`` a grade 1 or 2; ``dominant`` an AD variant (AD/AR
    counts); ``exposure`` Grade_12 or Grade_345; ``exposure_ad`` splits off Grade_12_AD;
    ``in_pathogenic`` a (likely) pathogenic one; ``in_blood`` membership in ``in_scope``; ``carries_pathogenic`` a variant
    among all ``calls``, candidate or not, whose significance says Pathogenic.
    """
    flags = {
        "in_germline": F.lit(True),
        "exposed": F.col(grade).isin(1, 2),
        "dominant": F.col(inheritance).isin("AD", "AD/AR"),
    }
    if significance is not None:
        flags["in_pathogenic"] = F.col(significance).isin("Pathogenic", "Likely pathogenic")
    facts = candidates.groupBy(key).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in flags.items()]
    )
    fill = {name: False for name in flags}
    grouped = annotate(subjects, facts, key, list(flags), fill=fill)
    if in_scope is not None:
        scope = in_scope.select(key).distinct().withColumn("in_blood", F.lit(True))
        grouped = annotate(grouped, scope, key, ["in_blood"], fill={"in_blood": False})
    if calls is not None and significance is not None:
        carried = calls.filter(F.col(significance).contains("Pathogenic")).select(key).distinct()
        grouped = annotate(grouped, carried.withColumn("carries_pathogenic", F.lit(True)), key, ["carries_pathogenic"], fill={"carries_pathogenic": False})
    exposure = F.when(F.col("exposed"), "Grade_12").otherwise("Grade_345")
    split = F.when(F.col("exposed") & F.col("dominant"), "Grade_12_AD").otherwise(exposure)
    return grouped.withColumns({"exposure": exposure, "exposure_ad": split})


def grade_tags(subjects: DataFrame, graded: DataFrame, key: str = "mrn") -> DataFrame:
    """Text listing every grade among the subject's variants."""
    tags = [(str(g), F.col("grade") == g) for g in range(1, 6)]
    return accumulate_tags(subjects, graded, key, tags, "in_grade")


def gene_tags(
    subjects: DataFrame, candidates: DataFrame, genes: Sequence[str], key: str = "mrn"
) -> DataFrame:
    """Text listing which of the genes of interest the subject has a candidate in."""
    return accumulate_tags(
        subjects, candidates, key, [(g, F.col("gene") == g) for g in genes], "in_gene"
    )


def subject_inheritance(
    subjects: DataFrame, candidates: DataFrame, key: str = "mrn", inheritance: str = "inheritance_blood"
) -> DataFrame:
    """Text listing the inheritance patterns of the subject's candidates (AD/AR reads AD); null
    without any."""
    tags = [(tag, F.col(inheritance).isin(patterns)) for tag, patterns in INHERITANCE_TAGS.items()]
    tagged = accumulate_tags(subjects, candidates, key, tags, "inheritance")
    return tagged.withColumn("inheritance", F.nullif(F.col("inheritance"), F.lit("")))


def collapse_tags(
    subjects: DataFrame,
    reviewed: DataFrame,
    key: str = "mrn",
    level: str = "path_level",
    priority: Sequence[str] = REVIEW_PRIORITY,
    name: str = "path_review",
) -> DataFrame:
    """The most serious review level among the subject's variants, empty without one."""
    flags = reviewed.groupBy(key).agg(
        *[F.bool_or(F.col(level) == v).alias(f"__level{i}") for i, v in enumerate(priority)]
    )
    verdict: Column = F.lit("")
    for i in reversed(range(len(priority))):
        verdict = F.when(F.col(f"__level{i}"), F.lit(priority[i])).otherwise(verdict)
    return annotate(
        subjects, flags.select(key, verdict.alias(name)), key, [name], fill={name: ""}
    )
