"""Panel calls: clean, annotate, grade, and narrow down to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.casting import parse_date, to_double
from cohortline.functions.dates import days_between
from cohortline.functions.predicates import on_or_before
from cohortline.functions.text import split_pair, unescape_gt, variant_key, variant_name
from cohortline.operators.grading import repaired_measure, stability_profile
from cohortline.operators.joins import annotate
from cohortline.operators.keys import attach
from cohortline.operators.keyed import with_time_offset
from cohortline.operators.recurrence import candidates_panel, recurrent_panel
from cohortline.operators.report import cohort_funnel
from cohortline.session import durable

LAST_DATE = "2021-12-31"
ASSEMBLY = "GRCh37"
NOT_IN_CLINVAR = "not in ClinVar"
UNKNOWN = "Unknown"
FREQUENCY_COLUMNS = (
    "rs_id", "chromosome", "position", "reference", "alternate", "consequence", "annotation",
    "allele_frequency",
)


def repair_panel(calls: DataFrame, last_date: str = LAST_DATE) -> DataFrame:
    """Distinct calls up to a date, with repaired text, dates, fractions and variant names."""
    typed = calls.distinct().withColumns(
        {
            "c_nom": unescape_gt("c_nom"),
            "request_date": parse_date("request_date", "mdy2"),
            "af": repaired_measure(to_double("af"), "zero"),
        }
    )
    g_nom, s_nom = split_pair("c_nom")
    return (
        typed.filter(on_or_before("request_date", last_date))
        .withColumns({"age": days_between("dob", "request_date"), "g_nom": g_nom, "s_nom": s_nom})
        .withColumns(
            {
                "name": variant_name("g_nom", "gene", "s_nom", "p_nom"),
                "gene_snv": variant_key("gene", "s_nom"),
                "mutation": variant_key("gene", "p_nom"),
            }
        )
        .drop("c_nom")
    )


def clean_panel(calls: DataFrame, last_date: str = LAST_DATE) -> DataFrame:
    """Repaired calls with the day offset from the subject's first test."""
    return with_time_offset(repair_panel(calls, last_date), "mrn", "request_date")


def grade_panel(calls: DataFrame, preset: str = "B", last_date: str = LAST_DATE) -> DataFrame:
    """Repaired calls with offset, CV and grade.

    Offset, CV and grade come from one profile, so the rows are joined once instead of three times.
    The fan-out of later annotation changes neither.
    """
    rows = repair_panel(calls, last_date)
    profile = stability_profile(
        rows, "mrn", ["gene", "p_nom"], "af", preset, "zero", date="request_date"
    )
    return (
        attach(rows, profile, ["mrn", "gene", "p_nom"], "inner")
        .withColumn("time_point", days_between("first_date", "request_date"))
        .drop("first_date", "max_cv")
    )


def annotate_variants(
    calls: DataFrame, clinvar: DataFrame, frequency: DataFrame, genes: DataFrame
) -> DataFrame:
    """Clinical significance by name, population frequency by gene and change, inheritance by gene."""
    known = clinvar.filter(F.col("assembly") == ASSEMBLY)
    calls = annotate(
        calls, known, "name", ["clinical_significance", "origin_simple", "phenotype_list"],
        fill={"clinical_significance": NOT_IN_CLINVAR, "origin_simple": NOT_IN_CLINVAR},
    )
    # a key with a missing part names no variant; such rows would pile up under one key
    named = frequency.dropna(subset=["gene", "s_nom"])
    keyed = named.withColumn("gene_snv", variant_key("gene", "s_nom"))
    calls = annotate(calls, keyed, "gene_snv", list(FREQUENCY_COLUMNS))
    return annotate(
        calls, genes, {"gene": "germline_blood"}, ["inheritance_blood"],
        fill={"inheritance_blood": UNKNOWN},
    )


def panel_study(
    calls: DataFrame, clinvar: DataFrame, frequency: DataFrame, genes: DataFrame, preset: str = "B"
) -> dict[str, DataFrame]:
    """Raw calls to graded rows, recurrent rows, candidates and the funnel over the three.

    Each stage is written once, as the next one and the funnel read it.
    """
    graded = durable(annotate_variants(grade_panel(calls, preset), clinvar, frequency, genes))
    recurrent = durable(recurrent_panel(graded))
    candidates = candidates_panel(recurrent)
    funnel = cohort_funnel(
        [("all", graded), ("recurrent", recurrent), ("candidates", candidates)],
        {
            "patients": "mrn",
            "assays": ["patient", "request_date"],
            "variants": None,
            "unique_variants": "gene_snv",
            "genes": "gene",
        },
    )
    return {"graded": graded, "recurrent": recurrent, "candidates": candidates, "funnel": funnel}
