"""Recurrence, candidates, subjects, reports, and the two end-to-end call tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import recurrence, report, subjects
from cohortline.operators.aggregates import count_by
from cohortline.operators.grading import stability_profile
from cohortline.operators.joins import annotate
from cohortline.operators.keys import attach
from cohortline.plans import broad, panel
from workload.base import OBSERVATIONS, months_sql, observations, profile_sql, query, r6, rounded
from workload.rows import FREQUENCY_SQL, part_frequency
from workload.wording import significance_sql, wording, wording_sql

# --- recurrence ----------------------------------------------------------------------------------


def line_calls(t):
    """Line items as calls: supplier-group subject, part variant, sample order."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("PT"), F.col("l_suppkey")).alias("patient"),
        F.col("l_suppkey").alias("mrn"),
        F.col("l_returnflag").alias("gene"),
        F.col("l_partkey").alias("p_nom"),
        F.concat_ws("/", "l_returnflag", "l_partkey").alias("name"),
        (0.2 + F.col("l_discount") * 4.0).alias("af"),
        (F.col("l_linestatus") == "O").alias("in_blood"),
    )


LINE_CALLS = """
calls AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'PT' || l_suppkey AS patient, l_suppkey AS mrn,
         l_returnflag AS gene, l_partkey AS p_nom, l_returnflag || '/' || l_partkey AS name,
         0.2 + l_discount * 4.0 AS af, l_linestatus = 'O' AS in_blood FROM lineitem
)"""


def recurrent_sql(kept: str) -> str:
    return f"""{LINE_CALLS}, in_gene AS (
  SELECT mrn FROM calls GROUP BY patient, mrn, gene HAVING count(*) >= 2),
changes AS (SELECT mrn, p_nom FROM calls WHERE mrn IN (SELECT mrn FROM in_gene)
  GROUP BY patient, mrn, p_nom HAVING count(*) >= 2),
kept AS (SELECT * FROM calls WHERE {kept}),
recurrent AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY patient, name) AS count FROM kept) WHERE count >= 2)"""


LOOSE = "p_nom IN (SELECT p_nom FROM changes) AND mrn IN (SELECT mrn FROM changes)"
STRICT = "(mrn, p_nom) IN (SELECT (mrn, p_nom) FROM changes)"
CALL_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "name", "count"]


@query(f"WITH {recurrent_sql(LOOSE)} SELECT {', '.join(CALL_COLUMNS)} FROM recurrent")
def recurrent_panel(t):
    return recurrence.recurrent_panel(line_calls(t)).select(*CALL_COLUMNS)


@query(f"WITH {recurrent_sql(STRICT)} SELECT {', '.join(CALL_COLUMNS)} FROM recurrent")
def recurrent_panel_strict(t):
    return recurrence.recurrent_panel(line_calls(t), strict_pairs=True).select(*CALL_COLUMNS)


@query(f"""WITH {recurrent_sql(LOOSE)}, freqs AS (SELECT p_partkey, {FREQUENCY_SQL} AS freq FROM part)
SELECT {', '.join(CALL_COLUMNS)}, freq AS allele_frequency FROM recurrent LEFT JOIN freqs ON l_partkey = p_partkey
WHERE af >= 0.3 AND (freq < 1e-4 OR freq IS NULL)""")
def candidates_panel(t):
    rows = annotate(
        recurrence.recurrent_panel(line_calls(t)), part_frequency(t), {"l_partkey": "p_partkey"},
        ["freq"], rename={"freq": "allele_frequency"},
    )
    return recurrence.candidates_panel(rows).select(*CALL_COLUMNS, "allele_frequency")


def broad_recurrent_sql(counted: str) -> str:
    return f"""{LINE_CALLS}, tested AS (SELECT mrn FROM calls GROUP BY mrn HAVING count(DISTINCT {counted}) >= 2),
recurrent AS (SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY mrn, p_nom) AS count FROM calls
  WHERE in_blood AND mrn IN (SELECT mrn FROM tested)) WHERE count >= 2)"""


@query(f"WITH {broad_recurrent_sql('p_nom')} SELECT {', '.join(CALL_COLUMNS)} FROM recurrent")
def recurrent_broad(t):
    return recurrence.recurrent_broad(line_calls(t), "mrn", "p_nom").select(*CALL_COLUMNS)


@query(f"WITH {broad_recurrent_sql('l_orderkey')} SELECT {', '.join(CALL_COLUMNS)} FROM recurrent")
def recurrent_broad_samples(t):
    rows = recurrence.recurrent_broad(line_calls(t), "mrn", "p_nom", sample="l_orderkey")
    return rows.select(*CALL_COLUMNS)


@query(f"""WITH {OBSERVATIONS}, {profile_sql()}
SELECT o.call_id, o.mrn, o.variant, p.grade, f.freq AS gnomad_alt_freq_all
FROM obs o JOIN profile p ON o.mrn = p.mrn AND o.variant = p.variant
LEFT JOIN (SELECT p_partkey, {FREQUENCY_SQL} AS freq FROM part) f ON f.p_partkey = o.call_id
WHERE p.grade IN (1, 2) AND (f.freq < 1e-4 OR f.freq IS NULL)""")
def candidates_broad(t):
    rows = observations(t)
    graded = attach(
        rows, stability_profile(rows, "mrn", "variant", "af"), ["mrn", "variant"], "inner"
    )
    known = annotate(
        graded, part_frequency(t), {"call_id": "p_partkey"}, ["freq"],
        rename={"freq": "gnomad_alt_freq_all"},
    )
    return recurrence.candidates_broad(known).select(
        "call_id", "mrn", "variant", "grade", "gnomad_alt_freq_all"
    )


# --- subjects ------------------------------------------------------------------------------------


def survival_orders(t):
    """Orders as the survival extract: text dates, the customer number in parentheses."""
    written = F.date_format("o_orderdate", "MM/dd/yyyy")
    return t.orders.select(
        "o_orderkey",
        F.concat(F.lit("Doe ("), F.col("o_custkey"), F.lit(")")).alias("patient_name_mrn"),
        written.alias("order_date"),
        F.lit("02/28/1950").alias("date_of_birth"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 400), "MM/dd/yyyy"),
        ).alias("death_date"),
    )


def clinical_rows(t):
    return t.customer.select(
        F.col("c_custkey").alias("mrn"), F.col("c_mktsegment").alias("site"), "c_name"
    )


SUBJECTS = f"""
extract AS (
  SELECT o_orderkey, o_custkey AS mrn, CAST(o_orderdate AS DATE) AS order_date, DATE '1950-02-28' AS birth_date,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 400 END AS death_date
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY mrn ORDER BY order_date, o_orderkey) AS rn FROM extract),
subjects AS (
  SELECT mrn, o_orderkey, order_date, death_date, death_date IS NOT NULL AS event,
    {months_sql("birth_date", "coalesce(death_date, DATE '2021-06-25')")} AS age_months,
    {months_sql("order_date", "coalesce(death_date, DATE '2021-12-31')")} AS landmark, c_mktsegment AS site
  FROM firsts LEFT JOIN customer ON mrn = c_custkey WHERE rn = 1)"""


def subject_table(t):
    os = subjects.parse_subjects(survival_orders(t))
    sequenced = clinical_rows(t).filter(F.col("site") != "MACHINERY")
    return subjects.build_subjects(
        os, sequenced, clinical_rows(t), clinical_order=["c_name"], clinical_columns=["site"],
        tie_break=["o_orderkey"],
    )


@query(f"WITH {SUBJECTS} SELECT * FROM subjects", name="subjects")
def subjects_query(t):
    return subject_table(t).select(
        "mrn", "o_orderkey", "order_date", "death_date", "event", "age_months", "landmark", "site"
    )


@query(f"""WITH {SUBJECTS}, {OBSERVATIONS}, {profile_sql()}, facts AS (
  SELECT mrn, bool_or(grade IN (1, 2)) AS exposed, bool_or(variant IN ('2-HIGH', '5-LOW')) AS dominant,
    bool_or(variant = '1-URGENT') AS path FROM profile WHERE n_obs >= 3 GROUP BY mrn),
flags AS (SELECT s.mrn, f.mrn IS NOT NULL AS in_germline, coalesce(exposed, false) AS exposed,
  coalesce(dominant, false) AS dominant, coalesce(path, false) AS in_pathogenic, s.landmark
  FROM subjects s LEFT JOIN facts f ON s.mrn = f.mrn)
SELECT *, CASE WHEN exposed THEN 'Grade_12' ELSE 'Grade_345' END AS exposure,
  CASE WHEN exposed AND dominant THEN 'Grade_12_AD' WHEN exposed THEN 'Grade_12' ELSE 'Grade_345' END AS exposure_ad
FROM flags""")
def exposure_groups(t):
    pattern = F.when(F.col("variant") == "2-HIGH", "AD").when(F.col("variant") == "5-LOW", "AD/AR")
    profile = stability_profile(observations(t), "mrn", "variant", "af").filter("n_obs >= 3")
    candidates = profile.withColumns(
        {
            "inheritance_blood": pattern,
            "significance": F.when(F.col("variant") == "1-URGENT", "Likely pathogenic"),
        }
    )
    return subjects.exposure_groups(subject_table(t), candidates).select(
        "mrn", "in_germline", "exposed", "dominant", "in_pathogenic", "landmark", "exposure",
        "exposure_ad",
    )


# --- validation ----------------------------------------------------------------------------------


def label_rows(t):
    """Labelled documents: subject = source, gene = language, variant = first words' length class."""
    etiology = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "not tested").otherwise("germline")).otherwise("somatic")
    return t.labels.join(t.documents, "doc_id").select(
        F.col("source").alias("mrn"),
        F.col("lang").alias("gene"),
        F.concat(F.lit("c."), F.col("n_chars") % 40).alias("s_nom"),
        F.concat(F.lit("p."), F.col("doc_id")).alias("p_nom"),
        (1 + F.col("n_chars") % 5).cast("int").alias("grade"),
        F.when(F.col("n_chars") % 11 == 0, "No").otherwise("Yes").alias("consented_to_research"),
        etiology.alias("etiology"),
        "doc_id",
    )


def label_grades(t):
    return t.documents.select(
        F.col("source").alias("mrn"),
        F.col("lang").alias("gene"),
        F.concat(F.lit("c."), F.col("n_chars") % 40).alias("s_nom"),
        (1 + F.col("doc_id") % 5).cast("int").alias("grade"),
    )


VALIDATION = """
labelled AS (
  SELECT source AS mrn, lang AS gene, 'c.' || (n_chars % 40) AS s_nom, 'p.' || d.doc_id AS p_nom,
    CAST(1 + n_chars % 5 AS INTEGER) AS grade, CASE WHEN n_chars % 11 = 0 THEN 'No' ELSE 'Yes' END AS consent,
    CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'not tested' ELSE 'germline' END ELSE 'somatic' END AS etiology,
    d.doc_id
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
single AS (SELECT * FROM labelled WHERE consent <> 'No' AND etiology <> 'not tested'
  QUALIFY row_number() OVER (PARTITION BY mrn, gene, s_nom ORDER BY doc_id) = 1),
grades AS (SELECT source AS m, lang AS g, 'c.' || (n_chars % 40) AS s, min(CAST(1 + doc_id % 5 AS INTEGER)) AS grade_new
  FROM documents GROUP BY 1, 2, 3),
validation AS (
  SELECT mrn, gene, s_nom, p_nom, grade, grade_new, etiology, CASE WHEN etiology = 'germline' THEN 1 ELSE 0 END AS cohort_status,
    dense_rank() OVER (ORDER BY mrn) AS id
  FROM single LEFT JOIN grades ON mrn = m AND gene = g AND s_nom = s)"""
VALIDATION_COLUMNS = [
    "mrn", "gene", "s_nom", "p_nom", "grade", "grade_new", "etiology", "cohort_status", "id",
]


def validated(t):
    frame = report.validation_frame(label_rows(t), label_grades(t), order_by=["doc_id"])
    return frame.select(*VALIDATION_COLUMNS)


@query(f"WITH {VALIDATION} SELECT * FROM validation")
def validation_frame(t):
    return validated(t)


@query(f"""WITH {VALIDATION} SELECT *, CASE WHEN grade_new = 5 AND etiology = 'germline' THEN 'false_negative'
  WHEN grade = 1 AND etiology = 'somatic' THEN 'false_positive' END AS kind
FROM validation WHERE (grade_new = 5 AND etiology = 'germline') OR (grade = 1 AND etiology = 'somatic')""")
def confusion_rows(t):
    return report.confusion_rows(validated(t))


# --- gene classes and reports --------------------------------------------------------------------


def brand_lists(t):
    """Independent lists in one table, padded with nulls, made of brand names."""
    brands = t.part.select("p_brand").distinct()
    number = F.substring("p_brand", 7, 9).cast("int")
    return brands.select(
        F.when(number < 10, F.col("p_brand")).alias("germline_blood"),
        F.when(number < 10, F.when(number < 5, "AD").otherwise("AR")).alias("inheritance_blood"),
        F.when(number.between(7, 15), F.col("p_brand")).alias("somatic_blood"),
        F.when(number.between(12, 18), F.col("p_brand")).alias("chip_a"),
        F.when(number > 16, F.col("p_brand")).alias("chip_b"),
    )


CLASSES = """
counts AS (SELECT p_brand AS gene, count(*) AS count, CAST(substring(p_brand, 7, 9) AS INTEGER) AS k
  FROM part WHERE p_size > 25 GROUP BY p_brand),
classes AS (
  SELECT gene, count, CASE WHEN k < 10 AND k >= 7 THEN 'Germline Somatic' WHEN k < 10 THEN 'Germline'
    WHEN k <= 15 THEN 'Somatic' ELSE 'Not Associated' END AS known,
    (k BETWEEN 12 AND 18) OR k > 16 AS chip, CASE WHEN k < 5 THEN 'AD' WHEN k < 10 THEN 'AR' END AS inheritance_blood
  FROM counts)"""


def classified(t):
    counts = count_by(
        t.part.filter(F.col("p_size") > 25).withColumnRenamed("p_brand", "gene"), "gene"
    )
    return report.classify_genes(counts, brand_lists(t), either=["chip_a", "chip_b"])


@query(f"WITH {CLASSES} SELECT * FROM classes")
def classify_genes(t):
    return classified(t).select("gene", "count", "known", "chip", "inheritance_blood")


def summary_sql(member: str, listed: str) -> str:
    return f"""WITH {CLASSES} SELECT CAST(sum(count) FILTER ({member}) AS BIGINT) AS class_variants,
  CAST(sum(count) AS BIGINT) AS all_variants, round(sum(count) FILTER ({member}) / sum(count), 6) AS variant_share,
  count(*) FILTER ({member}) AS class_genes, count(*) AS all_genes, round(count(*) FILTER ({member}) / count(*), 6) AS gene_share,
  round((SELECT count(DISTINCT p_brand) FROM part WHERE {listed}) / (SELECT count(DISTINCT p_brand) FROM part), 6) AS expected_share
FROM classes"""


@query(summary_sql("contains(known, 'Germline')", "CAST(substring(p_brand, 7, 9) AS INTEGER) < 10"))
def class_summary_germline(t):
    return _summary(t, F.col("known").contains("Germline"), ["germline_blood"])


def _summary(t, member, columns):
    universe = t.part.withColumnRenamed("p_brand", "gene")
    summary = report.class_summary(classified(t), member, brand_lists(t), columns, universe)
    return rounded(summary, "variant_share", "gene_share", "expected_share")


@query(summary_sql("chip", "CAST(substring(p_brand, 7, 9) AS INTEGER) >= 12"))
def class_summary_chip(t):
    return _summary(t, F.col("chip"), ["chip_a", "chip_b"])


def substudy(t):
    rows = observations(t)
    graded = attach(
        rows, stability_profile(rows, "mrn", "variant", "af"), ["mrn", "variant"], "inner"
    ).select(
        "call_id", "mrn", "gene", F.concat(F.lit("PT"), F.col("mrn")).alias("patient"),
        F.col("variant").alias("s_nom"), F.col("variant").alias("p_nom"),
        F.concat_ws(" ", "gene", "variant").alias("mutation"),
        F.concat_ws("   ", "gene", "variant").alias("gene_snv"), "variance", "af",
    )
    urgency = F.when(F.col("o_orderpriority") < "3", "Germline").otherwise("Somatic")
    status = (
        t.orders.filter(F.col("o_orderpriority") != "5-LOW").select("o_orderpriority").distinct()
        .select(
            F.col("o_orderpriority").alias("s_nom"), F.col("o_orderpriority").alias("p_nom_r"),
            urgency.alias("cohort_status"),
        )
    )
    return report.gene_substudy(graded, "F", status, status)


SUBSTUDY = f"""{OBSERVATIONS}, {profile_sql()}, graded AS (
  SELECT o.*, p.variance FROM obs o JOIN profile p ON o.mrn = p.mrn AND o.variant = p.variant),
picked AS (SELECT *, CASE WHEN variant < '3' THEN 'Germline' WHEN variant <> '5-LOW' THEN 'Somatic' END AS cohort_status
  FROM graded WHERE gene = 'F')"""


@query(f"""WITH {SUBSTUDY} SELECT mrn, variant AS s_nom, round(variance, 6) AS variance, count(*) AS count, cohort_status
FROM picked GROUP BY mrn, variant, variance, cohort_status HAVING count(*) >= 2""")
def gene_substudy_groups(t):
    groups = substudy(t)[0].select("mrn", "s_nom", "variance", "count", "cohort_status")
    return rounded(groups, "variance")


@query(f"""WITH {SUBSTUDY}, repeated AS (SELECT mrn FROM picked GROUP BY mrn, variant HAVING count(*) >= 2)
SELECT call_id, mrn, cohort_status, mrn IN (SELECT mrn FROM repeated) AS reocc,
  max(af) OVER (PARTITION BY variant) AS max_af FROM picked""")
def gene_substudy_rows(t):
    return substudy(t)[1].select("call_id", "mrn", "cohort_status", "reocc", "max_af")


def report_sql(condition: str) -> str:
    return f"""WITH {OBSERVATIONS}, {profile_sql()}, chosen AS (
  SELECT mrn, variant, grade, CASE variant WHEN '1-URGENT' THEN 'AD' WHEN '2-HIGH' THEN 'AR' WHEN '3-MEDIUM' THEN 'AD/AR' END AS inheritance_blood
  FROM profile WHERE grade IN (1, 2))
SELECT dense_rank() OVER (ORDER BY mrn) AS id, variant, grade, inheritance_blood FROM chosen WHERE {condition}"""


def variant_table(t, predicate):
    pattern = (
        F.when(F.col("variant") == "1-URGENT", "AD").when(F.col("variant") == "2-HIGH", "AR")
        .when(F.col("variant") == "3-MEDIUM", "AD/AR")
    )
    rows = observations(t)
    graded = attach(
        rows, stability_profile(rows, "mrn", "variant", "af"), ["mrn", "variant"], "inner"
    ).withColumn("inheritance_blood", pattern)
    return report.variant_report(
        graded, predicate, variant="variant", columns=["variant", "grade", "inheritance_blood"],
        order_by=["call_id"],
    )


@query(report_sql("inheritance_blood <> 'AR'"))
def variant_report_dominant(t):
    pattern = F.col("inheritance_blood")
    return variant_table(t, pattern.isNotNull() & (pattern != "AR"))


@query(report_sql("inheritance_blood = 'AR' OR inheritance_blood IS NULL"))
def variant_report_other(t):
    pattern = F.col("inheritance_blood")
    return variant_table(t, (pattern == "AR") | pattern.isNull())


# --- the two call tables, from raw text ----------------------------------------------------------


def raw_panel(t) -> DataFrame:
    change = F.concat(
        F.lit("NM_"), F.col("o_orderkey"), F.lit(":c."), F.col("o_orderkey"), F.lit("A&gt;T")
    )
    return t.orders.select(
        F.concat(F.lit("PT"), F.col("o_custkey")).alias("patient"),
        F.col("o_custkey").alias("mrn"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int")).alias("dob"),
        F.date_format("o_orderdate", "MM/dd/yy").alias("request_date"),
        F.concat(F.lit("GENE_"), F.col("o_orderstatus")).alias("gene"),
        change.alias("c_nom"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p_nom"),
        F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(
            (0.5 + F.col("o_totalprice") * 0.4 / 1e6).cast("string")
        ).alias("af"),
    )


STATUSES = ["GENE_F", "GENE_O", "GENE_P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "NA"]


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def pick_sql(values, index):
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(1 + {index} AS BIGINT))"


def panel_references(t):
    key = F.col("p_partkey")
    gene, protein = pick(STATUSES, key % 3), pick(PRIORITIES, key % 5)
    name = F.concat(
        F.lit("NM_"), key, F.lit("("), gene, F.lit("):c."), key, F.lit("A>T ("), protein, F.lit(")")
    )
    clinvar = t.part.select(
        F.when(F.col("p_size") > 40, "GRCh38").otherwise("GRCh37").alias("assembly"),
        name.alias("name"), F.col("p_type").alias("clinical_significance"),
        F.col("p_brand").alias("origin_simple"), F.col("p_name").alias("phenotype_list"),
    )
    frequency = t.part.select(
        gene.alias("gene"), F.concat(F.lit("c."), key, F.lit("A>T")).alias("s_nom"),
        *[F.col("p_name").alias(c) for c in panel.FREQUENCY_COLUMNS[:-1]],
        F.when(F.col("p_size") > 10, (F.col("p_retailprice") - 900) / 5e5).alias("allele_frequency"),
    )
    genes = t.nation.select(
        F.when(F.col("n_nationkey") == 3, "GENE_F").when(F.col("n_nationkey") == 9, "GENE_P").alias("germline_blood"),
        F.when(F.col("n_nationkey") == 3, "AD").when(F.col("n_nationkey") == 9, "AR").alias("inheritance_blood"),
    )
    return clinvar, frequency, genes


PANEL = f"""
raw AS (
  SELECT DISTINCT o_orderkey AS k, o_custkey AS mrn, CAST(o_orderdate AS DATE) AS request_date,
    DATE '1950-01-01' + CAST(o_custkey % 9000 AS INTEGER) AS dob, 'GENE_' || o_orderstatus AS gene,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS p_nom,
    CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE 0.5 + o_totalprice * 0.4 / 1e6 END AS af
  FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-12-31'),
cvs AS (SELECT mrn, gene, p_nom, count(*) AS n_obs, coalesce(stddev_samp(af) / nullif(avg(af), 0), 1.0) AS variance
  FROM raw GROUP BY 1, 2, 3),
"""


@query(f"""WITH {PANEL} widest AS (SELECT *, max(variance) OVER (PARTITION BY mrn) AS m FROM cvs),
graded AS (SELECT r.*, c.variance, c.n_obs, min(r.request_date) OVER (PARTITION BY r.mrn) AS first_date, m
  FROM raw r JOIN widest c ON r.mrn = c.mrn AND r.gene = c.gene AND r.p_nom IS NOT DISTINCT FROM c.p_nom),
part_keys AS (SELECT *, {pick_sql(STATUSES, "p_partkey % 3")} AS pg, {pick_sql(PRIORITIES, "p_partkey % 5")} AS pp FROM part)
SELECT g.mrn, 'NM_' || g.k || '(' || g.gene || '):c.' || g.k || 'A>T (' || coalesce(g.p_nom, 'NA') || ')' AS name,
  g.gene || '   c.' || g.k || 'A>T' AS gene_snv, g.request_date, CAST(g.request_date - g.dob AS INTEGER) AS age,
  CAST(g.request_date - first_date AS INTEGER) AS time_point, g.af, g.n_obs, round(g.variance, 6) AS variance,
  CASE WHEN variance <= 0.03 AND m > 0.1 THEN 1 WHEN variance < 0.03 AND m < 0.1 THEN 2
    WHEN variance > 0.03 AND variance <= 0.05 AND m > 0.1 THEN 2 WHEN variance > 0.03 AND variance <= 0.05 AND m < 0.1 THEN 3
    WHEN variance > 0.05 AND variance <= 0.1 AND m > 0.1 THEN 3 WHEN variance > 0.05 AND variance <= 0.2 AND m < 0.2 THEN 4
    ELSE 5 END AS grade,
  coalesce(c.p_type, 'not in ClinVar') AS clinical_significance,
  CASE WHEN f.p_size > 10 THEN (f.p_retailprice - 900) / 5e5 END AS allele_frequency,
  CASE g.gene WHEN 'GENE_F' THEN 'AD' WHEN 'GENE_P' THEN 'AR' ELSE 'Unknown' END AS inheritance_blood
FROM graded g
LEFT JOIN part_keys c ON c.p_partkey = g.k AND c.p_size <= 40 AND c.pg = g.gene AND c.pp = coalesce(g.p_nom, 'NA')
LEFT JOIN part_keys f ON f.p_partkey = g.k AND f.pg = g.gene""")
def panel_graded(t):
    graded = panel.grade_panel(raw_panel(t), last_date="1999-12-31")
    return panel.annotate_variants(graded, *panel_references(t)).select(
        "mrn", "name", "gene_snv", "request_date", "age", "time_point", "af", "n_obs",
        r6("variance").alias("variance"), "grade", "clinical_significance", "allele_frequency",
        "inheritance_blood",
    )


def raw_broad(t) -> list[DataFrame]:
    """Three extracts, one per return flag, of line items as calls."""
    sample = F.concat(
        F.lit("CGL"), F.floor(F.col("l_orderkey") / 8), F.lit("S"), F.col("l_suppkey") % 3,
        F.lit("T"), F.col("l_linenumber"),
    )
    rows = t.lineitem.select(
        "l_returnflag",
        sample.alias("sample"),
        F.date_format("l_shipdate", "yyMMdd").alias("date"),
        F.concat(F.lit("G"), F.col("l_partkey") % 25).alias("gene"),
        F.concat(F.lit("g."), F.col("l_partkey") % 12).alias("g_nomen"),
        F.concat(F.lit("c."), F.col("l_partkey") % 12).alias("c_nomen"),
        F.concat(F.lit("p."), F.col("l_partkey") % 12).alias("p_nomen"),
        F.when(F.col("l_extendedprice") % 7 < 1, "n/a").otherwise(
            (0.5 + F.col("l_extendedprice") * 2.0 / 1e6).cast("string")
        ).alias("af"),
        wording((F.col("l_partkey") % 15).cast("int")).alias("clin_var_clin_signifs"),
        F.when(F.col("l_quantity") < 10, "synonymous").when(F.col("l_quantity") < 20, "")
        .when(F.col("l_quantity") < 45, "missense").alias("coding_effect"),
        F.when(F.col("l_tax") < 0.07, F.col("l_tax") / 400).alias("gnomad_alt_freq_all"),
    )
    return [rows.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")]


def raw_clinical(t) -> list[DataFrame]:
    site = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Blood/Bone Marrow")
        .when(F.col("o_orderpriority") == "2-HIGH", "Lymph")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Skin")
    )
    rows = t.orders.select(
        "o_orderstatus",
        F.col("o_custkey").alias("mrn"),
        F.concat(F.lit("CGL"), F.floor(F.col("o_orderkey") / 8), F.lit("-T1")).alias("order"),
        F.concat(F.lit(" S "), F.col("o_orderkey") % 8).alias("s"),
        F.concat(F.lit("3/15/"), 30 + F.col("o_custkey") % 60).alias("dob"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"),
        F.date_format("o_orderdate", "M/d/yy").alias("sequence_date"),
        F.col("o_orderstatus").alias("sex"),
        site.alias("onco_tree_specimen_site"),
        site.alias("onco_tree_primary_tumor_site"),
        site.alias("onco_tree_diagnosis"),
        F.lit("50").alias("percent_tumor"),
    )
    return [
        rows.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus"),
        rows.filter(F.col("o_orderstatus") != "F").drop("o_orderstatus"),
    ]


def broad_lists(t):
    name = F.concat(F.lit("G"), F.col("n_nationkey"))
    return t.nation.select(
        F.when(F.col("n_nationkey") < 10, name).alias("germline_blood"),
        F.when(F.col("n_nationkey") < 10, F.when(F.col("n_nationkey") < 5, "AD").otherwise("AR")).alias("inheritance_blood"),
        F.when(F.col("n_nationkey") < 18, name).alias("ch_ip_nejm"),
        F.when(F.col("n_nationkey") > 12, name).alias("ch_ip_nat_med"),
    )


SITE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Blood/Bone Marrow' WHEN '2-HIGH' THEN 'Lymph'
  WHEN '4-NOT SPECIFIED' THEN 'Skin' ELSE 'Not Designated' END"""

BROAD = f"""
stacked AS (
  SELECT l_orderkey // 8 AS unit, l_suppkey % 3 AS s, l_linenumber AS run, CAST(l_shipdate AS DATE) AS date,
    l_partkey % 25 AS gene, l_partkey % 12 AS v,
    CASE WHEN l_extendedprice % 7 < 1 THEN NULL ELSE 0.5 + l_extendedprice * 2.0 / 1e6 END AS af,
    {wording_sql("l_partkey % 15")} AS signif,
    CASE WHEN l_quantity < 10 THEN 'synonymous' WHEN l_quantity < 20 THEN '' WHEN l_quantity < 45 THEN 'missense' END AS effect,
    CASE WHEN l_tax < 0.07 THEN l_tax / 400 END AS freq
  FROM lineitem),
timed AS (SELECT *, date - min(date) OVER (PARTITION BY unit) AS time_point FROM stacked),
single AS (SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY unit, s, run, v ORDER BY date,
  'G' || gene NULLS FIRST, 'c.' || v, 'p.' || v, coalesce(CAST(af AS VARCHAR), 'n/a'), signif, effect NULLS FIRST, freq NULLS FIRST) = 1),
kept AS (SELECT * FROM single WHERE af IS NOT NULL),
cvs AS (SELECT unit, v, count(*) AS n_obs, coalesce(stddev_samp(af) / nullif(avg(af), 0), 1.0) AS variance FROM kept GROUP BY 1, 2),
widest AS (SELECT *, max(variance) OVER (PARTITION BY unit) AS m FROM cvs),
sizes AS (SELECT unit, s, count(DISTINCT v) AS number_variants FROM kept GROUP BY 1, 2),
cleaned AS (SELECT k.*, w.n_obs, w.variance, CASE WHEN w.variance <= 0.03 AND m > 0.1 THEN 1 WHEN w.variance < 0.03 AND m < 0.1 THEN 2
    WHEN w.variance > 0.03 AND w.variance <= 0.05 AND m > 0.1 THEN 2 WHEN w.variance > 0.03 AND w.variance <= 0.05 AND m < 0.1 THEN 3
    WHEN w.variance > 0.05 AND w.variance <= 0.1 AND m > 0.1 THEN 3 WHEN w.variance > 0.05 AND w.variance <= 0.2 AND m < 0.2 THEN 4
    ELSE 5 END AS grade, number_variants, gene BETWEEN 13 AND 17 AS chip
  FROM kept k JOIN widest w ON k.unit = w.unit AND k.v = w.v JOIN sizes z ON k.unit = z.unit AND k.s = z.s)"""


@query(f"""WITH {BROAD} SELECT 'CGL' || unit AS cgl, 'CGL' || unit || 'S' || s AS sample, 'g.' || v AS g_nomen,
  CAST(time_point AS INTEGER) AS time_point, af, n_obs, round(variance, 6) AS variance, grade, chip, number_variants FROM cleaned""")
def broad_cleaned(t):
    return broad.clean_broad(raw_broad(t), broad_lists(t)).select(
        "cgl", "sample", "g_nomen", "time_point", "af", "n_obs", r6("variance").alias("variance"),
        "grade", "chip", "number_variants",
    )


@query(f"""SELECT o_custkey AS mrn, 'CGL' || (o_orderkey // 8) || 'S' || (o_orderkey % 8) AS sample, dob, d AS order_date, d AS sequence_date,
  CAST(d - dob AS INTEGER) AS age FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS d, make_date(CAST(1930 + o_custkey % 60 AS BIGINT), 3, 15) AS dob FROM orders)""")
def clinical_cleaned(t):
    return broad.clean_clinical(raw_clinical(t)).select(
        "mrn", "sample", "dob", "order_date", "sequence_date", "age"
    )


@query(f"""WITH {BROAD}, worded AS (SELECT *, {significance_sql("signif")} AS w FROM cleaned)
SELECT 'CGL' || unit AS cgl, 'CGL' || unit || 'S' || s AS sample, 'g.' || v AS g_nomen, grade, o_custkey AS mrn,
  coalesce({SITE}, 'Not Designated') AS onco_tree_diagnosis,
  coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS in_blood,
  w AS significance,
  CASE WHEN effect = '' THEN 'non-coding' ELSE effect END AS coding_effect,
  CASE WHEN gene < 5 THEN 'AD' WHEN gene < 10 THEN 'AR' END AS inheritance_blood
FROM worded LEFT JOIN orders ON o_orderkey = unit * 8 + s WHERE effect <> 'synonymous'""")
def broad_enriched(t):
    cleaned = broad.clean_broad(raw_broad(t), broad_lists(t))
    enriched = broad.enrich_broad(cleaned, broad.clean_clinical(raw_clinical(t)), broad_lists(t))
    return enriched.select(
        "cgl", "sample", "g_nomen", "grade", "mrn", "onco_tree_diagnosis", "in_blood",
        "significance", "coding_effect", "inheritance_blood",
    )
