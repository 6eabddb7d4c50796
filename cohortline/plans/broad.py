"""Broad-panel calls: unite the extracts, grade, attach clinical data, narrow down to candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.casting import parse_date, pivot_year, to_double
from cohortline.functions.dates import days_between
from cohortline.functions.significance import normalize_significance
from cohortline.functions.text import blank_to, compact, empty_to, strip_from
from cohortline.operators.aggregates import distinct_per_key, union_extracts
from cohortline.operators.grading import stability_profile
from cohortline.operators.joins import annotate, flag_gene_lists
from cohortline.operators.keys import attach
from cohortline.operators.keyed import first_per_key
from cohortline.operators.recurrence import candidates_broad, recurrent_broad
from cohortline.operators.report import cohort_funnel
from cohortline.session import durable

NOT_DESIGNATED = "Not Designated"
NON_CODING = "non-coding"
SYNONYMOUS = "synonymous"
BLOOD_SITES = ("Blood/Bone Marrow", "Lymph")
#: Clinical rows of one sample that a task joins; more are dealt to several tasks.
HOT_ORDERS = 100_000
CLINICAL_COLUMNS = (
    "mrn", "dob", "order_date", "sequence_date", "age", "sex", "onco_tree_specimen_site",
    "onco_tree_primary_tumor_site", "onco_tree_diagnosis", "percent_tumor",
)


def clean_broad(
    extracts: Sequence[DataFrame],
    genes: DataFrame,
    preset: str = "B",
    chip_lists: Sequence[str] = ("ch_ip_nejm", "ch_ip_nat_med"),
) -> DataFrame:
    """United extracts with subject, offset, CV, grade, list flag and variants per sample.

    A sample repeats a variant when it was run twice; the row of the earliest date is kept, ties by
    value, so a subject's first date is always among the kept rows. Rows without a readable fraction
    are dropped afterwards, as a repeat may hide behind one. The kept rows are used three times and
    therefore written once.
    """
    stacked = union_extracts(*extracts).withColumns(
        {"cgl": strip_from("sample", "S"), "date": parse_date("date", "ymd2")}
    )
    others = [c for c in stacked.columns if c not in ("sample", "g_nomen", "date")]
    order = [F.col("date").asc_nulls_last(), *others]
    rows = durable(
        first_per_key(stacked, ["sample", "g_nomen"], order).withColumns(
            {"sample": strip_from("sample", "T"), "af": to_double("af")}
        )
    )
    profile = stability_profile(rows, "cgl", "g_nomen", "af", preset, date="date").drop("max_cv")
    measured = rows.filter(F.col("af").isNotNull())
    graded = (
        attach(measured, profile, ["cgl", "g_nomen"], "inner")
        .withColumn("time_point", days_between("first_date", "date"))
        .drop("first_date")
    )
    flagged = flag_gene_lists(graded, genes, "gene", list(chip_lists), "chip", "all")
    sizes = distinct_per_key(measured, "sample", "g_nomen", "number_variants")
    return attach(flagged, sizes, "sample")


def clean_clinical(extracts: Sequence[DataFrame], reference_year: int = 2018) -> DataFrame:
    """United distinct clinical orders with dates, age in days and the sample they belong to.

    The distinct rows are used more than once, for the count of a sample's orders and for the rows, and therefore written once.
    """
    rows = durable(union_extracts(*extracts).distinct())
    dated = rows.withColumns(
        {
            "dob": pivot_year(parse_date("dob", "mdy4"), reference_year),
            "order_date": parse_date("order_date", "mdy"),
            "sequence_date": parse_date("sequence_date", "mdy"),
        }
    )
    return dated.withColumns(
        {
            "age": days_between("dob", "order_date"),
            "sample": compact(strip_from("order", ".T"), "s"),
        }
    )


def enrich_broad(calls: DataFrame, clinical: DataFrame, genes: DataFrame) -> DataFrame:
    """Calls with clinical data, labelled gaps, reduced significance, blood flag and inheritance;
    synonymous variants and those of unknown effect are left out.

    Orders without a number share one sample key, which may be hot; so may the orders of one sample.
    """
    rows = annotate(calls, clinical, "sample", list(CLINICAL_COLUMNS), hot_rows=HOT_ORDERS)
    rows = rows.withColumns(
        {
            "onco_tree_primary_tumor_site": blank_to("onco_tree_primary_tumor_site", NOT_DESIGNATED),
            "onco_tree_diagnosis": blank_to("onco_tree_diagnosis", NOT_DESIGNATED),
            "significance": normalize_significance("clin_var_clin_signifs"),
            "coding_effect": empty_to("coding_effect", NON_CODING),
        }
    ).withColumn("in_blood", F.col("onco_tree_primary_tumor_site").isin(*BLOOD_SITES))
    inherited = annotate(rows, genes, {"gene": "germline_blood"}, ["inheritance_blood"])
    return inherited.filter(F.col("coding_effect") != SYNONYMOUS)


def broad_study(
    extracts: Sequence[DataFrame],
    clinical_extracts: Sequence[DataFrame],
    genes: DataFrame,
    preset: str = "B",
) -> dict[str, DataFrame]:
    """Extracts to enriched rows, recurrent rows, candidates and the funnel over them.

    Each stage is written once, as the next one and the funnel read it.
    """
    enriched = durable(
        enrich_broad(clean_broad(extracts, genes, preset), clean_clinical(clinical_extracts), genes)
    )
    recurrent = durable(recurrent_broad(enriched))
    candidates = candidates_broad(recurrent)
    funnel = cohort_funnel(
        [
            ("in blood", enriched.filter(F.col("in_blood"))),
            ("recurrent", recurrent),
            ("candidates", candidates),
        ],
        {
            "patients": "cgl",
            "samples": "sample",
            "diagnoses": "onco_tree_diagnosis",
            "genes": "gene",
            "variants": "g_nomen",
        },
    )
    return {
        "enriched": enriched, "recurrent": recurrent, "candidates": candidates, "funnel": funnel,
    }
