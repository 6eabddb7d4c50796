"""Joins, membership, tags, set operations."""

from pyspark.sql import functions as F

from cohortline.operators import joins
from cohortline.operators.aggregates import distinct_values as values_of
from cohortline.operators.aggregates import sort_history as history
from cohortline.operators.aggregates import union_extracts
from cohortline.operators.grading import stability_profile
from cohortline.operators.subjects import collapse_tags as collapse
from cohortline.operators.subjects import gene_tags as genes_of
from cohortline.operators.subjects import grade_tags as grades_of
from cohortline.operators.subjects import subject_inheritance as inherited
from workload.base import OBSERVATIONS, observations, profile_sql, query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_brand, 'not listed') AS p_brand, p_type
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def annotate_left(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    listed = t.part.filter(F.col("p_size") > 10)
    return joins.annotate(
        rows, listed, {"l_partkey": "p_partkey"}, ["p_brand", "p_type"],
        fill={"p_brand": "not listed"},
    )


@query("""SELECT c_custkey, c_mktsegment, coalesce(n_name, 'Unknown') AS nation_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey""")
def annotate_renamed(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    nations = t.nation.filter(F.col("n_regionkey") != 1)
    return joins.annotate(
        rows, nations, {"c_nationkey": "n_nationkey"}, ["n_name"],
        fill={"nation_name": "Unknown"}, rename={"n_name": "nation_name"},
    ).drop("c_nationkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, coalesce(n_returned, 0) AS n_returned
FROM lineitem l LEFT JOIN (
  SELECT l_partkey AS pk, l_suppkey AS sk, count(*) AS n_returned FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1, 2) ON l_partkey = pk AND l_suppkey = sk""")
def annotate_composite(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    returned = (
        t.lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.count("*").alias("n_returned"))
    )
    return joins.annotate(
        rows, returned, ["l_partkey", "l_suppkey"], ["n_returned"], fill={"n_returned": 0}
    )


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (
  SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey""")
def annotate_fanout(t):
    failed = t.orders.filter(F.col("o_orderstatus") == "F")
    return joins.annotate(
        t.customer.select("c_custkey"), failed, {"c_custkey": "o_custkey"}, ["o_orderkey"]
    )


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
ON c_custkey = o_custkey""")
def annotate_deduplicated(t):
    return joins.annotate(
        t.customer.select("c_custkey"), t.orders, {"c_custkey": "o_custkey"}, ["o_orderkey"],
        dedupe_by=["o_orderdate", "o_orderkey"],
    )


@query("""SELECT p_partkey, kind, n FROM (
  SELECT p_partkey, nullif(p_type, 'PROMO') AS kind FROM part) p LEFT JOIN (
  SELECT nullif(p_type, 'PROMO') AS k, count(*) AS n FROM part GROUP BY 1)
ON kind IS NOT DISTINCT FROM k""")
def annotate_null_safe(t):
    kinds = t.part.select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("kind"))
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    return joins.annotate(kinds, counts, "kind", ["n"], null_safe=True)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count FROM (
  SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS count FROM lineitem)
WHERE count >= 2""")
def attach_count(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.attach_group_count(rows, ["l_partkey", "l_suppkey"], at_least=2)


@query("""SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_join(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return joins.semi_join(
        t.customer.select("c_custkey", "c_name"),
        urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey",
    )


@query("""SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_join(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return joins.anti_join(
        t.customer.select("c_custkey", "c_name"),
        urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey",
    )


@query("""SELECT c_custkey AS mrn FROM customer EXCEPT SELECT o_custkey FROM orders""")
def key_difference(t):
    return joins.difference(
        t.customer.select(F.col("c_custkey").alias("mrn")),
        t.orders.select(F.col("o_custkey").alias("mrn")),
    )


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
  AND o_orderpriority = '2-HIGH') AS flagged FROM customer""")
def membership_flag(t):
    chosen = t.orders.filter("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
    return joins.flag_membership(
        t.customer.select("c_custkey"), chosen, {"c_custkey": "o_custkey"}, "flagged"
    )


@query(f"""WITH {OBSERVATIONS}, repeated AS (
  SELECT mrn, variant FROM obs WHERE gene = 'F' GROUP BY mrn, variant HAVING count(*) >= 3)
SELECT call_id, variant IN (SELECT variant FROM repeated) AND mrn IN (SELECT mrn FROM repeated) AS both_in
FROM obs""")
def independent_flags(t):
    rows = observations(t)
    repeated = (
        rows.filter(F.col("gene") == "F")
        .groupBy("mrn", "variant").agg(F.count("*").alias("n")).filter("n >= 3")
    )
    return joins.flag_membership_independent(
        rows, {"variant": repeated, "mrn": repeated}, "both_in"
    ).select("call_id", "both_in")


@query(f"""WITH {OBSERVATIONS}, repeated AS (
  SELECT mrn, variant FROM obs WHERE gene = 'F' GROUP BY mrn, variant HAVING count(*) >= 3)
SELECT call_id, r.mrn IS NOT NULL AS pair_in
FROM obs o LEFT JOIN repeated r ON o.mrn = r.mrn AND o.variant = r.variant""")
def pair_flag(t):
    rows = observations(t)
    repeated = (
        rows.filter(F.col("gene") == "F")
        .groupBy("mrn", "variant").agg(F.count("*").alias("n")).filter("n >= 3")
    )
    return joins.flag_membership(rows, repeated, ["mrn", "variant"], "pair_in").select(
        "call_id", "pair_in"
    )


def nation_lists(t):
    """Two independent lists of nation names in the columns of one table, padded with nulls."""
    return t.nation.select(
        F.when(F.col("n_regionkey") <= 2, F.col("n_name")).alias("list_a"),
        F.when(F.col("n_nationkey") >= 8, F.col("n_name")).alias("list_b"),
    )


@query("""WITH a AS (SELECT n_name FROM nation WHERE n_regionkey <= 2),
b AS (SELECT n_name FROM nation WHERE n_nationkey >= 8)
SELECT c_custkey, n_name, n_name IN (SELECT n_name FROM a) AND n_name IN (SELECT n_name FROM b) AS in_all,
       n_name IN (SELECT n_name FROM a) OR n_name IN (SELECT n_name FROM b) AS in_any
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def gene_list_flags(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name"
    )
    columns = ["list_a", "list_b"]
    flagged = joins.flag_gene_lists(rows, nation_lists(t), "n_name", columns, "in_all", "all")
    return joins.flag_gene_lists(flagged, nation_lists(t), "n_name", columns, "in_any", "any")


def tagged_sql(rules: list[tuple[str, str]], source: str, key: str) -> str:
    flags = ", ".join(f"coalesce(bool_or({rule}), false) AS t{i}" for i, (_, rule) in enumerate(rules))
    text = ", ".join(f"CASE WHEN t{i} THEN '{label}' END" for i, (label, _) in enumerate(rules))
    return f"""SELECT c_custkey AS mrn, coalesce(tags, '') AS tags FROM customer LEFT JOIN (
      SELECT k, concat_ws(' ', {text}) AS tags FROM (
        SELECT {key} AS k, {flags} FROM {source} GROUP BY 1)) ON c_custkey = k"""


def subjects(t):
    return t.customer.select(F.col("c_custkey").alias("mrn"))


@query(tagged_sql(
    [("urgent", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
     ("large", "o_totalprice > 480000"), ("late", "o_orderdate >= TIMESTAMP '2001-06-01'")],
    "orders", "o_custkey"))
def accumulate_tags(t):
    rows = t.orders.withColumnRenamed("o_custkey", "mrn")
    tags = [
        ("urgent", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")),
        ("large", F.col("o_totalprice") > 480000),
        ("late", F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")),
    ]
    return joins.accumulate_tags(subjects(t), rows, "mrn", tags, "tags")


@query(f"""WITH {OBSERVATIONS}, {profile_sql()} """ + tagged_sql(
    [(str(g), f"grade = {g}") for g in range(1, 6)], "profile", "mrn"))
def grade_tags(t):
    profile = stability_profile(observations(t), "mrn", "variant", "af")
    return grades_of(subjects(t), profile).withColumnRenamed("in_grade", "tags")


@query(tagged_sql([("F", "o_orderstatus = 'F'"), ("P", "o_orderstatus = 'P'")], "orders", "o_custkey"))
def gene_tags(t):
    return genes_of(subjects(t), observations(t), ["F", "P"]).withColumnRenamed("in_gene", "tags")


@query("""SELECT c_custkey AS mrn, CASE WHEN p THEN 'P' WHEN v THEN 'VUS' WHEN b THEN 'B' ELSE '' END AS path_review
FROM customer LEFT JOIN (
  SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 300000) AS p,
         bool_or(o_orderstatus = 'P' AND o_totalprice > 300000) AS v,
         bool_or(o_orderstatus = 'O' AND o_totalprice > 300000) AS b
  FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def collapse_tags(t):
    level = (
        F.when(F.col("gene") == "F", "P").when(F.col("gene") == "P", "VUS").otherwise("B")
    )
    reviewed = t.orders.filter(F.col("o_totalprice") > 300000).select(
        F.col("o_custkey").alias("mrn"), F.col("o_orderstatus").alias("gene")
    ).withColumn("path_level", level)
    return collapse(subjects(t), reviewed)


@query("""SELECT c_custkey AS mrn, nullif(concat_ws(' ', CASE WHEN ar THEN 'AR' END,
  CASE WHEN ad THEN 'AD' END, CASE WHEN xl THEN 'X-linked' END), '') AS inheritance
FROM customer LEFT JOIN (
  SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS ar,
         bool_or(o_orderpriority IN ('2-HIGH', '3-MEDIUM')) AS ad,
         bool_or(o_orderpriority = '5-LOW') AS xl
  FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def inheritance(t):
    pattern = (
        F.when(F.col("variant") == "1-URGENT", "AR")
        .when(F.col("variant") == "2-HIGH", "AD/AR")
        .when(F.col("variant") == "3-MEDIUM", "AD")
        .when(F.col("variant") == "5-LOW", "X-linked")
    )
    return inherited(subjects(t), observations(t).withColumn("inheritance_blood", pattern))


@query("""SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'""")
def union_distinct(t):
    columns = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus")
    extracts = [
        columns.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "P")
    ]
    return union_extracts(*extracts).distinct()


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'""")
def union_all(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return union_extracts(
        rows.filter(F.col("o_totalprice") > 400000).drop("o_totalprice"),
        rows.filter(F.col("o_orderstatus") == "F").drop("o_totalprice"),
    )


@query("""SELECT DISTINCT p_brand, p_type FROM part""")
def distinct_values(t):
    return values_of(t.part, ["p_brand", "p_type"])


@query(f"""WITH {OBSERVATIONS} SELECT mrn, gene, variant, test_date, af FROM obs
ORDER BY mrn, gene, variant, test_date DESC""")
def sort_history(t):
    rows = observations(t).select("mrn", "gene", "variant", "test_date", "af")
    return history(rows, ["mrn", "gene", "variant"], "test_date")
