"""Tables behind the charts."""

from pyspark.sql import functions as F

from cohortline.operators import charts
from cohortline.operators.aggregates import count_by
from cohortline.operators.grading import with_grade
from cohortline.operators.keyed import with_time_offset
from workload.base import OBSERVATIONS, observations, profile_sql, query, rounded


@query(f"""WITH {OBSERVATIONS}, timed AS (
  SELECT *, test_date - min(test_date) OVER (PARTITION BY mrn) AS days FROM obs)
SELECT call_id, mrn, gene || '   ' || variant AS series, round(days / 30.0, 6) AS months, af
FROM timed WHERE af BETWEEN 0 AND 1""")
def trajectory(t):
    rows = with_time_offset(observations(t), "mrn", "test_date")
    points = charts.trajectory(rows, "time_point", "af", ["gene", "variant"], ["call_id", "mrn"])
    return rounded(points, "months")


@query("""SELECT p_brand, p_type, count, CAST(sum(count) OVER (PARTITION BY p_brand) AS BIGINT) AS freq FROM (
  SELECT p_brand, p_type, count(*) AS count FROM (
    SELECT DISTINCT p_brand, p_type, p_name FROM part) GROUP BY 1, 2)""")
def stacked_counts(t):
    return charts.stacked_counts(t.part, "p_brand", "p_type", ["p_name"])


@query(f"""WITH {OBSERVATIONS}, {profile_sql()}, kinds AS (
  SELECT DISTINCT grade, gene, o.mrn, o.variant FROM obs o JOIN profile p ON o.mrn = p.mrn AND o.variant = p.variant),
counts AS (SELECT grade, gene, count(*) AS count FROM kinds GROUP BY 1, 2)
SELECT *, CAST(sum(count) OVER w AS BIGINT) AS freq, round(count / sum(count) OVER w, 6) AS share
FROM counts WINDOW w AS (PARTITION BY grade)""")
def share_by_grade(t):
    graded = with_grade(observations(t), "mrn", "variant", "af")
    return rounded(charts.shares(graded, "grade", "gene", ["mrn", "variant"]), "share")


@query("""SELECT event_type, bin, count(*) AS count, DATE '2024-01-01' + bin * 15 AS bin_start FROM (
  SELECT event_type, CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 15.0) AS INTEGER) AS bin FROM events)
GROUP BY 1, 2""")
def date_histogram(t):
    rows = t.events.select("event_type", F.col("ts").cast("date").alias("day"))
    return charts.date_histogram(rows, "day", "2024-01-01", by=["event_type"])


BOXES = """boxes AS (
  SELECT event_type, count(*) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max
  FROM events GROUP BY 1),
joined AS (
  SELECT e.event_id, e.event_type, e.value,
         e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM events e JOIN boxes b ON e.event_type = b.event_type)"""


@query(f"""WITH {BOXES}
SELECT b.event_type, n, min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, max,
       lower_whisker, upper_whisker, n_outliers
FROM boxes b JOIN (
  SELECT event_type, min(value) FILTER (inside) AS lower_whisker, max(value) FILTER (inside) AS upper_whisker,
         count(*) FILTER (NOT inside) AS n_outliers FROM joined GROUP BY 1) w ON b.event_type = w.event_type""")
def box_summary(t):
    return rounded(charts.box_summary(t.events, "value", "event_type"), "q1", "median", "q3")


@query(f"""WITH {BOXES} SELECT event_id, event_type, value FROM joined WHERE NOT inside""")
def box_outliers(t):
    rows = t.events.select("event_id", "event_type", "value")
    boxes = charts.box_summary(rows, "value", "event_type")
    return charts.outliers(rows, boxes, "value", "event_type")


@query("""SELECT p_brand, count, kind FROM (
  SELECT p_brand, count(*) AS count, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'known' ELSE 'other' END AS kind
  FROM part GROUP BY 1) WHERE count > 3 ORDER BY count DESC, p_brand""")
def ranked_bars(t):
    known = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "known").otherwise("other")
    counts = count_by(t.part, "p_brand").withColumn("kind", known)
    return charts.ranked_bars(counts, "p_brand", "kind")
