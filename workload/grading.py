"""Stability, offsets and group facts."""

from pyspark.sql import functions as F

from cohortline.operators.grading import grade_histogram as histogram
from cohortline.operators.grading import stability_profile, with_cv, with_grade
from cohortline.operators.keyed import (
    first_per_key as first_rows,
    keep_earliest,
    with_distinct_count,
    with_group_id,
    with_group_max,
    with_time_offset,
)
from workload.base import OBSERVATIONS, observations, profile_sql, query, rounded


@query(f"""WITH {OBSERVATIONS}, {profile_sql()}
SELECT variant, grade, CAST(sum(n_obs) AS BIGINT) AS n_rows, count(*) AS n_variants
FROM profile GROUP BY variant, grade""")
def grade_histogram(t):
    return histogram(stability_profile(observations(t), "mrn", "variant", "af"), ["variant"])


@query(f"""WITH {OBSERVATIONS}, {profile_sql("A")}
SELECT grade, CAST(sum(n_obs) AS BIGINT) AS n_rows, count(*) AS n_variants
FROM profile GROUP BY grade""")
def grade_preset_a(t):
    return histogram(stability_profile(observations(t), "mrn", "variant", "af", preset="A"))


@query(f"""WITH {OBSERVATIONS}, {profile_sql()}
SELECT o.call_id, o.mrn, o.variant, o.af, p.n_obs, round(p.variance, 6) AS variance,
       round(p.max_cv, 6) AS max_cv, p.grade
FROM obs o JOIN profile p ON o.mrn = p.mrn AND o.variant = p.variant""")
def graded_rows(t):
    graded = with_grade(observations(t), "mrn", "variant", "af")
    return rounded(
        graded.select("call_id", "mrn", "variant", "af", "n_obs", "variance", "max_cv", "grade"),
        "variance", "max_cv",
    )


@query(f"""WITH {OBSERVATIONS}, patched AS (
  SELECT mrn, variant, CASE WHEN gene = 'P' THEN 0.0 ELSE af END AS af FROM obs
), {profile_sql(source="patched")}
SELECT grade, CAST(sum(n_obs) AS BIGINT) AS n_rows, count(*) AS n_variants
FROM profile GROUP BY grade""")
def grade_missing_as_zero(t):
    gaps = observations(t).withColumn("af", F.when(F.col("gene") != "P", F.col("af")))
    return histogram(stability_profile(gaps, "mrn", "variant", "af", missing="zero"))


@query(f"""WITH {OBSERVATIONS}
SELECT call_id, count(*) OVER w AS n_obs,
       round(coalesce(stddev_samp(af) OVER w / avg(af) OVER w, 1.0), 6) AS variance
FROM obs WINDOW w AS (PARTITION BY mrn, variant)""")
def cv_rows(t):
    rows = with_cv(observations(t), ["mrn", "variant"], "af")
    return rounded(rows.select("call_id", "n_obs", "variance"), "variance")


@query(f"""WITH {OBSERVATIONS}
SELECT call_id, CAST(test_date - min(test_date) OVER (PARTITION BY mrn) AS INTEGER) AS time_point
FROM obs""")
def time_offset(t):
    return with_time_offset(observations(t), "mrn", "test_date").select("call_id", "time_point")


@query("""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1""")
def first_per_key(t):
    return first_rows(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "value"
    )


@query("""SELECT call_id, mrn, test_date FROM (
  SELECT o_orderkey AS call_id, o_custkey AS mrn, CAST(o_orderdate AS DATE) AS test_date,
         min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS first_date FROM orders)
WHERE test_date = first_date""")
def earliest_rows(t):
    rows = observations(t).select("call_id", "mrn", "test_date")
    return keep_earliest(rows, "mrn", "test_date")


@query("""SELECT o_orderkey AS call_id, dense_rank() OVER (ORDER BY o_custkey) AS id FROM orders""")
def group_ids(t):
    rows = t.orders.select(F.col("o_orderkey").alias("call_id"), "o_custkey")
    return with_group_id(rows, "o_custkey").select("call_id", "id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, n_parts FROM lineitem JOIN (
  SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1)
ON l_orderkey = k""")
def variants_per_sample(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return with_distinct_count(rows, "l_orderkey", "l_partkey", "n_parts")


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
  max(l_extendedprice) OVER (PARTITION BY l_partkey) AS max_price FROM lineitem""")
def group_max(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return with_group_max(rows, "l_partkey", "l_extendedprice", "max_price").drop("l_extendedprice")
