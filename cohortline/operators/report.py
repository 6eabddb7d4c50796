"""Cohort funnel, validation frame, gene classes, sub-studies and variant tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.aggregates import count_by, describe_by, having, n_unique, ratio, unique_count
from cohortline.operators.charts import ranked_bars
from cohortline.operators.joins import annotate, flag_gene_lists, flag_membership
from cohortline.operators.keys import as_list
from cohortline.operators.keyed import first_per_key, with_group_id, with_group_max
from cohortline.session import durable


def cohort_funnel(
    stages: Sequence[tuple[str, DataFrame]], measures: Mapping[str, str | Sequence[str] | None]
) -> DataFrame:
    """One row per stage: rows, distinct counts (missing counts as one value) and share of the
    first stage for each. A measure mapped to ``None`` counts rows."""
    rows = [
        frame.agg(
            *[
                (F.count("*") if cols is None else unique_count(cols)).alias(name)
                for name, cols in measures.items()
            ]
        ).select(F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"), *measures)
        for i, (stage, frame) in enumerate(stages)
    ]
    # as many rows as stages were named
    base = Window.orderBy("stage_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return reduce(DataFrame.unionByName, rows).select(
        "*",
        *[
            ratio(F.col(name), F.first(name).over(base)).alias(f"{name}_share")
            for name in measures
        ],
    )


def stage_funnel(
    df: DataFrame, stages: Sequence[tuple[str, Column]], measures: Mapping[str, str | Sequence[str] | None]
) -> DataFrame:
    """The funnel of stages that are conditions on the rows of one table, as :func:`cohort_funnel` gives it, from one scan.

    A row's stages are the bits of one number. Rows are reduced to the combinations of measured values, then to the values of
    each measure, their numbers joined by or; how many values have a stage's bit is the count. A null condition doesn't hold.
    """
    if len(stages) > 62:
        raise ValueError("more than 62 stages")
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, c) in enumerate(stages)],
    )
    keys = {name: as_list(cols) for name, cols in measures.items() if cols is not None}
    wanted = list(dict.fromkeys(c for cols in keys.values() for c in cols))

    def has(i: int, value: str = "__stages") -> Column:
        return F.col(value).bitwiseAND(F.lit(1 << i).cast("long")) != 0

    combined = df.select(*wanted, bits.alias("__stages")).groupBy(*wanted).agg(
        F.bit_or("__stages").alias("__stages"), *[F.count_if(has(i)).alias(f"__rows{i}") for i in range(len(stages))]
    )
    # every measure references all of it, so that they keep one exchange, which Spark reuses
    untouched = reduce(lambda a, b: a & b, [F.max(f"__rows{i}").isNotNull() for i in range(len(stages))])

    def counted(name: str, cols: list[str] | None) -> DataFrame:
        if cols is None:
            sums = F.array(*[F.coalesce(F.sum(f"__rows{i}"), F.lit(0)) for i in range(len(stages))])
            found = combined.agg(F.when(F.coalesce(F.bit_or("__stages"), F.lit(0)) >= 0, sums).alias("n"))
        else:
            values = combined.groupBy(*cols).agg(F.bit_or("__stages").alias("__stages"), untouched.alias("__whole")).filter("__whole")
            found = values.agg(F.array(*[F.count_if(has(i)) for i in range(len(stages))]).alias("n"))
        return found.select(F.lit(name).alias("measure"), "n")

    counts = reduce(DataFrame.unionAll, [counted(name, keys.get(name)) for name in measures])
    wide = counts.agg(*[F.max(F.when(F.col("measure") == name, F.col("n"))).alias(f"__{name}") for name in measures])
    named = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage")) for i, (name, _) in enumerate(stages)])
    return wide.select("*", F.inline(named)).select(
        "stage_no", "stage", *[F.get(f"__{name}", "stage_no").alias(name) for name in measures],
        *[ratio(F.get(f"__{name}", "stage_no"), F.get(f"__{name}", F.lit(0))).alias(f"{name}_share") for name in measures],
    )


def unique_by_grade(df: DataFrame, item: str | Sequence[str] = "c_nomen", grade: str = "grade") -> DataFrame:
    """Distinct items per grade, and their share of the distinct items of all grades. An item of several grades counts in
    each; a missing grade is one."""
    total = n_unique(df, item).scalar()
    counts = df.groupBy(grade).agg(unique_count(item).alias("count"))
    return counts.withColumns({"all_items": total, "share": ratio(F.col("count"), total)})


def gene_class_study(
    candidates: DataFrame, universe: DataFrame, lists: DataFrame, subject: str = "cgl", variant: str = "c_nomen", floor: int = 3,
    germline: str = "germline_blood", chip_lists: Sequence[str] = ("ch_ip_nejm", "ch_ip_nat_med"),
) -> dict[str, DataFrame]:
    """The candidates' genes by the lists they are on: their distinct variants per subject counted, what the lists account for
    beside what their size lets expect, and the bars by class, inheritance and chip list."""
    distinct = candidates.select(subject, variant, "gene").groupBy(subject, variant).agg(F.min("gene").alias("gene"))
    classified = durable(classify_genes(count_by(distinct, "gene"), lists, either=chip_lists))
    # inheritance may name a gene several times; the summaries count it once
    single = classified.drop("inheritance_blood").distinct()
    inherited = F.col("inheritance_blood").isNotNull()
    return {
        "genes": classified.orderBy(F.desc("count"), "gene", "inheritance_blood"),
        "described": describe_by(single, ["count"], "known"),
        "germline": class_summary(single, F.col("known").startswith("Germline"), lists, [germline], universe),
        "chip": class_summary(single, F.col("chip"), lists, list(chip_lists), universe),
        "bars_by_class": ranked_bars(single, "gene", "known", floor),
        "bars_by_inheritance": ranked_bars(classified, "gene", "inheritance_blood", 0, inherited),
        "bars_by_chip": ranked_bars(single, "gene", "chip", floor),
    }


def _total_order(first: str | Sequence[str], df: DataFrame) -> list[str]:
    """The given columns, then all others, so that which row comes first doesn't depend on the order of files."""
    first = as_list(first)
    return [*first, *[c for c in df.columns if c not in first]]


def validation_frame(
    labels: DataFrame,
    grades: DataFrame,
    keys: Sequence[str] = ("mrn", "gene", "s_nom"),
    subject: str = "mrn",
    grade: str = "grade",
    consent: str = "consented_to_research",
    etiology: str = "etiology",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Labelled variants beside their new grade: consented and tested only, one row per variant,
    ``cohort_status`` 1 for germline and 0 otherwise, ``id`` numbering the subjects.

    ``order_by`` says which label row of a variant wins; the other columns, in turn, settle ties.
    """
    keys = list(keys)
    # a variant's label rows and grade rows are reduced first, so the join cannot fan out
    tested = labels.filter((F.col(consent) != "No") & (F.col(etiology) != "not tested"))
    tested = first_per_key(tested, keys, _total_order(order_by, tested))
    joined = annotate(
        tested, grades, keys, [grade], rename={grade: "grade_new"}, dedupe_by=[F.col(grade)]
    )
    status = F.when(F.col(etiology) == "germline", 1).otherwise(0)
    return with_group_id(joined.withColumn("cohort_status", status), subject, "id")


def confusion_rows(
    df: DataFrame,
    grade_new: str = "grade_new",
    grade_old: str = "grade",
    etiology: str = "etiology",
) -> DataFrame:
    """Germline rows graded 5 (``false_negative``) and somatic rows graded 1 (``false_positive``)."""
    missed = (F.col(grade_new) == 5) & (F.col(etiology) == "germline")
    mistaken = (F.col(grade_old) == 1) & (F.col(etiology) == "somatic")
    kind = F.when(missed, "false_negative").when(mistaken, "false_positive")
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def classify_genes(
    counts: DataFrame,
    lists: DataFrame,
    gene: str = "gene",
    germline: str = "germline_blood",
    somatic: str = "somatic_blood",
    inheritance: str | None = "inheritance_blood",
    either: Sequence[str] = (),
) -> DataFrame:
    """Label each counted gene by the lists it is on, with its inheritance.

    ``either`` names list columns of which one suffices for the ``chip`` flag.
    """
    flagged = flag_gene_lists(counts, lists, gene, [germline], "__germline", "any")
    flagged = flag_gene_lists(flagged, lists, gene, [somatic], "__somatic", "any")
    known = (
        F.when(F.col("__germline") & F.col("__somatic"), "Germline Somatic")
        .when(F.col("__germline"), "Germline")
        .when(F.col("__somatic"), "Somatic")
        .otherwise("Not Associated")
    )
    labelled = flagged.withColumn("known", known).drop("__germline", "__somatic")
    if either:
        labelled = flag_gene_lists(labelled, lists, gene, list(either), "chip", "any")
    if inheritance:
        labelled = annotate(labelled, lists, {gene: germline}, [inheritance])
    return labelled


def class_summary(
    classified: DataFrame,
    member: Column,
    lists: DataFrame,
    list_columns: Sequence[str],
    universe: DataFrame,
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """How much of the counted variants and genes is in a class, beside the share to expect from
    the lists' size (all listed columns together) relative to the genes sequenced."""
    listed = lists.select(
        F.explode(F.array(*[F.col(c) for c in list_columns])).alias("__g")
    ).agg(F.count_distinct("__g"))
    sequenced = universe.agg(unique_count(gene))
    inside = F.coalesce(member, F.lit(False))
    return classified.agg(
        F.coalesce(F.sum(F.when(inside, F.col(count))), F.lit(0)).alias("class_variants"),
        F.coalesce(F.sum(count), F.lit(0)).alias("all_variants"),
        ratio(F.sum(F.when(inside, F.col(count)).otherwise(0)), F.sum(count)).alias("variant_share"),
        F.count_if(inside).alias("class_genes"),
        F.count("*").alias("all_genes"),
        ratio(F.count_if(inside), F.count("*")).alias("gene_share"),
    ).withColumn("expected_share", ratio(listed.scalar(), sequenced.scalar()))


def gene_substudy(
    df: DataFrame,
    gene_value: str,
    labels_by_change: DataFrame,
    labels_by_protein: DataFrame,
    gene: str = "gene",
    subject: str = "mrn",
    patient: str = "patient",
    change: str = "s_nom",
    protein: str = "p_nom",
    mutation: str = "mutation",
    variance: str = "variance",
    variant_key: str = "gene_snv",
    af: str = "af",
    at_least: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """One gene's calls: the recurrent (patient, variant, CV) groups with their confirmed status,
    and all rows with status, ``reocc`` flag of the subject and ``max_af`` of the variant."""
    rows = df.filter(F.col(gene) == gene_value)
    groups = having(
        count_by(rows, [patient, subject, change, protein, mutation, variance]), at_least
    )
    recurrent = annotate(groups, labels_by_change, {change: "s_nom"}, ["cohort_status"])
    flagged = flag_membership(rows, groups, subject, "reocc")
    labelled = annotate(flagged, labels_by_protein, {protein: "p_nom_r"}, ["cohort_status"])
    return recurrent, with_group_max(labelled, variant_key, af, "max_af")


def variant_report(
    df: DataFrame,
    inheritance_predicate: Column,
    subject: str = "mrn",
    variant: str = "g_nomen",
    grades: Sequence[int] = (1, 2),
    grade: str = "grade",
    columns: Sequence[str] = ("gene", "c_nomen", "p_nomen", "grade", "inheritance_blood"),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Variant table of a report: one row per subject and variant, subjects numbered, by number."""
    chosen = df.filter(F.col(grade).isin(*grades) & inheritance_predicate)
    # numbering reads the rows twice, so what led to these few is not to be repeated
    single = durable(
        first_per_key(chosen, [subject, variant], _total_order(order_by, chosen))
    )
    return with_group_id(single, subject, "id").select("id", *columns).orderBy("id", *columns)
