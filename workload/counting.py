"""Counts, shares, description, funnel."""

from pyspark.sql import functions as F

from cohortline.operators import aggregates as agg
from cohortline.operators import report
from cohortline.operators.grading import with_grade
from cohortline.operators.report import stage_funnel
from workload.base import OBSERVATIONS, observations, profile_sql, query, rounded


@query("""SELECT o_custkey, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) >= 4""")
def count_having(t):
    return agg.having(agg.count_by(t.orders, ["o_custkey", "o_orderstatus"]), 4)


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""")
def distinct_per_key(t):
    return agg.distinct_per_key(t.lineitem, "l_partkey", "l_suppkey", "n_suppliers")


@query("""SELECT count(*) AS n_rows FROM events""")
def row_count(t):
    return agg.n_rows(t.events)


@query("""SELECT count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT kind) + max(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) AS kinds,
  count(DISTINCT kind) AS known_kinds FROM (
  SELECT l_partkey, l_suppkey, nullif(l_returnflag, 'N') AS kind FROM lineitem)""")
def n_unique(t):
    rows = t.lineitem.select(
        "l_partkey", "l_suppkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("kind")
    )
    return rows.agg(
        agg.unique_count(["l_partkey", "l_suppkey"]).alias("pairs"),
        agg.unique_count("kind").alias("kinds"),
        agg.unique_count("kind", count_null=False).alias("known_kinds"),
    )


@query("""SELECT round(count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN o_custkey END)
  / CAST(count(DISTINCT o_custkey) AS DOUBLE), 6) AS patient_share FROM orders""")
def count_ratio(t):
    chosen = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)
    part = F.count_distinct(F.when(chosen, F.col("o_custkey")))
    return rounded(
        t.orders.agg(agg.ratio(part, F.count_distinct("o_custkey")).alias("patient_share")),
        "patient_share",
    )


@query("""SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders GROUP BY 1""")
def median(t):
    return rounded(agg.median(t.orders, "o_totalprice", ["o_orderstatus"]), "median")


@query("""SELECT min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders""")
def date_range(t):
    return agg.date_range(observations(t), "test_date")


@query("""SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
  CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS DOUBLE) AS closed_quantity,
  count(*) FILTER (l_linestatus = 'F') AS closed_rows FROM lineitem GROUP BY 1""")
def sum_if(t):
    closed = F.col("l_linestatus") == "F"
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("quantity"),
        agg.sum_if("l_quantity", closed).alias("closed_quantity"),
        F.count_if(closed).alias("closed_rows"),
    )


@query("""SELECT kind, count(*) AS count FROM (SELECT nullif(event_type, 'view') AS kind FROM events)
WHERE kind IS NOT NULL GROUP BY 1""")
def freq_table(t):
    kinds = t.events.select(F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return agg.freq_table(kinds, "kind")


@query("""SELECT p_brand, p_type, count, CAST(sum(count) OVER (PARTITION BY p_brand) AS BIGINT) AS freq
FROM (SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY 1, 2)""")
def count_parent_total(t):
    return agg.count_with_parent_total(t.part, "p_brand", "p_type")


@query("""SELECT l_shipmonth, count, CAST(sum(count) OVER () AS BIGINT) AS freq FROM (
  SELECT CAST(month(l_shipdate) AS INTEGER) AS l_shipmonth, count(*) AS count FROM lineitem GROUP BY 1)""")
def count_overall_total(t):
    months = t.lineitem.select(F.month("l_shipdate").alias("l_shipmonth"))
    return agg.count_with_parent_total(months, [], "l_shipmonth")


@query("""WITH base AS (
  SELECT o_orderstatus AS grp, o_totalprice AS x, count(*) OVER w AS n, avg(o_totalprice) OVER w AS mu,
         quantile_cont(o_totalprice, 0.5) OVER w AS med,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS rn
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus)
), sums AS (
  SELECT grp, max(n) AS n, max(mu) AS mean, max(med) AS median, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
         avg((x - mu) * (x - mu)) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4,
         avg(x) FILTER (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) AS trimmed,
         quantile_cont(abs(x - med), 0.5) * 1.4826 AS mad
  FROM base GROUP BY grp
)
SELECT grp, 'price' AS measure, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median, 4) AS median,
       round(trimmed, 4) AS trimmed, round(mad, 4) AS mad, lo AS min, hi AS max, round(hi - lo, 4) AS range,
       round(m3 / (m2 ** 1.5) * ((n - 1.0) / n) ** 1.5, 6) AS skew,
       round(m4 / (m2 * m2) * (1.0 - 1.0 / n) ** 2 - 3, 6) AS kurtosis, round(sd / sqrt(n), 4) AS se FROM sums""")
def describe_by(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("price"))
    described = rounded(agg.describe_by(rows, ["price"], "grp"), "skew", "kurtosis")
    coarse = ["mean", "sd", "median", "trimmed", "mad", "range", "se"]
    return described.withColumns({c: F.round(c, 4) for c in coarse})


@query("""SELECT o_custkey, count(*) AS count FROM orders
GROUP BY 1 HAVING count(*) > 12 ORDER BY count DESC, o_custkey""")
def top_categories(t):
    return agg.top_categories(t.orders, "o_custkey", floor=12)


@query("""SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1
ORDER BY quantity DESC, l_partkey LIMIT 20""")
def top_categories_limited(t):
    return agg.top_categories(t.lineitem, "l_partkey", F.sum("l_quantity"), limit=20, name="quantity")


def stage_sql(number: int, name: str, condition: str) -> str:
    return f"""SELECT {number} AS stage_no, '{name}' AS stage, count(DISTINCT mrn) AS patients,
      count(DISTINCT (mrn, test_date)) AS assays, count(*) AS calls, count(DISTINCT variant) AS variants
      FROM obs WHERE {condition}"""


@query(f"""WITH {OBSERVATIONS}, stages AS (
  {stage_sql(0, "all", "true")} UNION ALL {stage_sql(1, "high", "af >= 0.6")}
  UNION ALL {stage_sql(2, "high and F", "af >= 0.6 AND gene = 'F'")})
SELECT *, round(patients / first(patients) OVER w, 6) AS patients_share,
  round(assays / first(assays) OVER w, 6) AS assays_share, round(calls / first(calls) OVER w, 6) AS calls_share,
  round(variants / first(variants) OVER w, 6) AS variants_share
FROM stages WINDOW w AS (ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def cohort_funnel(t):
    rows = observations(t)
    high = F.col("af") >= 0.6
    measures = {
        "patients": "mrn", "assays": ["mrn", "test_date"], "calls": None, "variants": "variant"
    }
    stages = [("all", F.lit(True)), ("high", high), ("high and F", high & (F.col("gene") == "F"))]
    return rounded(stage_funnel(rows, stages, measures), *[f"{m}_share" for m in measures])


@query(f"""WITH {OBSERVATIONS}, {profile_sql()}, rows AS (SELECT o.call_id, p.grade FROM obs o JOIN profile p ON o.mrn = p.mrn AND o.variant = p.variant)
SELECT grade, count(DISTINCT call_id % 97) AS count, (SELECT count(DISTINCT call_id % 97) FROM rows) AS all_items,
  round(count(DISTINCT call_id % 97) / (SELECT count(DISTINCT call_id % 97) FROM rows), 6) AS share FROM rows GROUP BY grade""")
def unique_by_grade(t):
    rows = with_grade(observations(t), "mrn", ["variant"], "af").withColumn("item", F.col("call_id") % 97)
    return rounded(report.unique_by_grade(rows, "item"), "share")
