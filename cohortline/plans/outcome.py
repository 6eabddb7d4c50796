"""Outcome and validation studies: exposed subjects against survival, grades against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.aggregates import count_with_parent_total
from cohortline.operators.charts import box_summary, shares
from cohortline.operators.cox import cox_ph
from cohortline.operators.joins import annotate, difference, semi_join
from cohortline.operators.keyed import first_per_key
from cohortline.operators.ranktests import kruskal_wallis
from cohortline.operators.report import confusion_rows, gene_substudy, unique_by_grade, validation_frame, variant_report
from cohortline.operators.roc import auc_ci, auc_delong, class_moments, cutoff_metrics, ks_stat, roc_binormal, roc_ci, roc_smooth
from cohortline.operators.subjects import (
    build_subjects,
    collapse_tags,
    exposure_groups,
    gene_tags,
    grade_tags,
    parse_subjects,
    subject_inheritance,
)
from cohortline.operators.survival import km_at, km_cumhaz, km_curve, level_values, logrank, risk_table
from cohortline.session import durable

EXPOSURES = ("Grade_345", "Grade_12_AD", "Grade_12")
GENES_OF_INTEREST = ("DDX41", "CHEK2", "RUNX1")
MONTHS_PER_YEAR = 12
REPORT_COLUMNS = ("gene", "c_nomen", "p_nomen", "grade", "inheritance_blood")


def outcome_study(
    survival: DataFrame,
    enriched: DataFrame,
    candidates: DataFrame,
    clinical: DataFrame,
    months: Sequence[int] = (24,),
    years_of_age: Sequence[int] = (75,),
    grid: Sequence[int] = tuple(range(0, 61, 12)),
    genes: Sequence[str] = GENES_OF_INTEREST,
    gene_months: Sequence[int] = (18,),
    decades: Sequence[int] = tuple(range(0, 101, 10)),
) -> dict[str, DataFrame]:
    """Subjects with exposure groups and tags; for those in scope the curves, risk tables, log-rank tests and survival at
    given times from the first test, by age, and by gene of interest; distinct variants by grade of the subjects followed.

    Of orders on one day the one of the smallest birth and death date counts, of clinical rows of one day the smallest by value.
    """
    order = ["order_date", *sorted(c for c in clinical.columns if c != "order_date")]
    subjects = build_subjects(
        parse_subjects(survival), enriched, clinical, clinical_order=order, tie_break=["birth_date", "death_date"]
    )
    grouped = exposure_groups(subjects, candidates, in_scope=enriched.filter(F.col("in_blood")), calls=enriched)
    tagged = gene_tags(grade_tags(grouped, enriched), candidates, genes)
    tagged = durable(subject_inheritance(tagged, candidates))
    cohort = tagged.filter(F.col("in_blood"))
    curve = km_curve(cohort, "landmark", "event", "exposure_ad")
    by_age = km_curve(cohort, "age_months", "event", "exposure_ad")
    gene_groups = ["in_gene", "exposure"]
    by_gene = km_curve(cohort, "landmark", "event", gene_groups)
    ages = [y * MONTHS_PER_YEAR for y in years_of_age]
    return {
        "subjects": tagged,
        "curve": curve,
        "survival_at": km_at(curve, months, "exposure_ad"),
        "risk_table": risk_table(cohort, "landmark", grid, "exposure_ad"),
        "logrank": logrank(cohort, "landmark", "event", "exposure_ad", EXPOSURES),
        "hazard_by_age": km_cumhaz(by_age, "exposure_ad"),
        "risk_table_by_age": risk_table(cohort, "age_months", [y * MONTHS_PER_YEAR for y in decades], "exposure_ad"),
        "logrank_by_age": logrank(cohort, "age_months", "event", "exposure_ad", EXPOSURES),
        "survival_at_age": km_at(by_age, ages, "exposure_ad"),
        "curve_by_gene": by_gene,
        "survival_at_by_gene": km_at(by_gene, gene_months, gene_groups),
        "risk_table_by_gene": risk_table(cohort, "landmark", grid, gene_groups),
        "logrank_by_gene": compared(cohort, "landmark", "event", gene_groups),
        "variants_by_grade": unique_by_grade(semi_join(enriched.filter(F.col("in_blood")), tagged, "mrn")),
    }


def compared(df: DataFrame, time: str, event: str, strata: Sequence[str]) -> DataFrame:
    """The log-rank test among the groups that occur; no row where there are fewer than two."""
    levels = level_values(df, strata)
    if len(levels) > 1:
        return logrank(df, time, event, strata, levels)
    return df.sparkSession.createDataFrame([], "n long, events long, chi2 double, df int, p double")


def hazard_ratios(
    subjects: DataFrame, time: str = "landmark", covariates: Sequence[str] = ("exposure_ad",)
) -> DataFrame:
    """Hazard ratios of the in-scope subjects, unexposed ones being the reference."""
    return cox_ph(
        subjects.filter(F.col("in_blood")), time, "event", list(covariates),
        reference={"exposure_ad": EXPOSURES[0], "path_review": ""},
    )


def _inheritance_predicates() -> tuple[Column, Column]:
    pattern = F.col("inheritance_blood")
    return pattern.isNotNull() & (pattern != "AR"), (pattern == "AR") | pattern.isNull()


def inheritance_reports(
    candidates: DataFrame, subjects: DataFrame, columns: Sequence[str] = REPORT_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """Variant tables of followed subjects: inheritance other than recessive, and the rest."""
    followed = semi_join(candidates, subjects, "mrn")
    dominant, rest = _inheritance_predicates()
    return (
        variant_report(followed, dominant, columns=columns, order_by=["c_nomen", "p_nomen"]),
        variant_report(followed, rest, columns=columns, order_by=["c_nomen", "p_nomen"]),
    )


def review_study(
    candidates: DataFrame, subjects: DataFrame, reviewed: DataFrame, grid: Sequence[int] = tuple(range(0, 61, 12))
) -> dict[str, DataFrame]:
    """Manually reviewed variants: their levels counted, each subject's most serious level, and the
    curves, risk table and log-rank test by level among the dominant exposure group."""
    table, _ = inheritance_reports(candidates, subjects, ("mrn", *REPORT_COLUMNS))
    variants = annotate(
        table, reviewed, ["id", "gene", "p_nomen"], ["clin_var", "varsome", "path_level"]
    )
    rated = durable(collapse_tags(subjects, variants))
    dominant = rated.filter(F.col("in_blood") & (F.col("exposure_ad") == "Grade_12_AD"))
    return {
        "variants": variants,
        "levels": count_with_parent_total(variants, [], "path_level"),
        "subjects": rated,
        "curve": km_curve(dominant, "landmark", "event", ["path_review", "exposure_ad"]),
        "risk_table": risk_table(dominant, "landmark", grid, "path_review"),
        "logrank": compared(dominant, "landmark", "event", ["path_review"]),
    }


def unshared_subjects(
    subjects: DataFrame, variants: DataFrame, exposure: str = "Grade_12_AD"
) -> DataFrame:
    """Subjects of an exposure group that no variant accounts for; should be none."""
    return difference(
        subjects.filter(F.col("exposure_ad") == exposure).select("mrn"), variants.select("mrn")
    )


#: Columns of the validated variants' table, in their order.
MANUSCRIPT_COLUMNS = ("id", "gene", "s_nom", "p_nom", "count", "variance", "grade_new", "etiology", "clin_var", "varsome", "path_level")


def manuscript_table(frame: DataFrame, columns: Sequence[str] = MANUSCRIPT_COLUMNS) -> DataFrame:
    """The validated variants as they are published, by subject number, ties by the other columns."""
    return frame.select(*columns).orderBy(*columns)


def validation_study(
    labels: DataFrame, grades: DataFrame, order_by: Sequence[str] = ("p_nom",)
) -> dict[str, DataFrame]:
    """Labelled variants, shares per grade, the misjudged ones, and how well low grades predict
    germline origin."""
    frame = durable(validation_frame(labels, grades, order_by=order_by))
    score, label = "grade_new", "cohort_status"
    return {
        "frame": frame,
        "shares": shares(frame, "grade_new", "etiology"),
        "levels_by_gene": count_with_parent_total(frame, "gene", "path_level"),
        "confusion": confusion_rows(frame),
        "auc": auc_ci(class_moments(frame, score, label, higher_is_positive=False)),
        "auc_empirical": auc_delong(frame, score, label, higher_is_positive=False),
        "smooth_curve": roc_smooth(frame, score, label, higher_is_positive=False),
        "curve": roc_binormal(frame, score, label, higher_is_positive=False),
        "band": roc_ci(frame, score, label, higher_is_positive=False),
        "ks": ks_stat(frame, score, label, higher_is_positive=False, method="binormal"),
        "metrics": cutoff_metrics(frame, score, label, higher_is_positive=False),
    }


def single_gene_study(
    graded: DataFrame, gene: str, status: DataFrame, germline: str = "Germline"
) -> dict[str, DataFrame]:
    """One gene's recurrent variants: stability by confirmed origin, with box, counts, rank test and
    separation by the CV. ``status`` has ``s_nom``, ``p_nom_r`` and ``cohort_status``."""
    groups, rows = gene_substudy(graded, gene, status, status)
    confirmed = durable(
        first_per_key(
            rows.filter(F.col("reocc") & F.col("cohort_status").isNotNull()),
            ["mrn", "gene_snv"],
            ["request_date", "variance", "cohort_status"],
        ).select("mrn", "gene_snv", "max_af", "variance", "cohort_status")
    )
    scored = groups.filter(F.col("cohort_status").isNotNull()).withColumn(
        "somatic", F.when(F.col("cohort_status") == germline, 0).otherwise(1)
    )
    return {
        "rows": confirmed,
        "box": box_summary(confirmed, "variance", "cohort_status"),
        "counts": count_with_parent_total(confirmed, [], "cohort_status"),
        "kruskal": kruskal_wallis(confirmed, "variance", "cohort_status"),
        "metrics": cutoff_metrics(scored, "variance", "somatic"),
        "auc": auc_ci(class_moments(scored, "variance", "somatic")),
    }
