"""Row filters and null policies."""

from pyspark.sql import functions as F

from cohortline.functions.predicates import drop_incomplete, on_or_before
from cohortline.functions.predicates import rare_or_unknown as is_rare
from cohortline.functions.text import contains_any
from cohortline.operators.aggregates import count_by, having, null_count
from cohortline.operators.joins import annotate
from workload.base import OBSERVATIONS, observations, query

FREQUENCY_SQL = "CASE WHEN p_size > 10 THEN (p_retailprice - 900) / 5e5 END"


def part_frequency(t):
    return t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 10, (F.col("p_retailprice") - 900) / 5e5).alias("freq"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, freq FROM lineitem LEFT JOIN (
  SELECT p_partkey, {FREQUENCY_SQL} AS freq FROM part) ON l_partkey = p_partkey
WHERE freq < 1e-4 OR freq IS NULL""")
def rare_or_unknown(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return annotate(rows, part_frequency(t), {"l_partkey": "p_partkey"}, ["freq"]).filter(
        is_rare("freq")
    )


@query(f"""WITH {OBSERVATIONS}
SELECT mrn, count(*) AS count FROM obs WHERE af >= 0.65 GROUP BY mrn HAVING count(*) > 3""")
def threshold_filter(t):
    return having(count_by(observations(t).filter(F.col("af") >= 0.65), "mrn"), 4)


@query("""SELECT o_orderpriority, count(*) AS count FROM orders
WHERE CAST(o_orderdate AS DATE) <= DATE '1998-12-31' GROUP BY 1""")
def date_cutoff(t):
    early = t.orders.filter(on_or_before("o_orderdate", "1998-12-31"))
    return count_by(early, "o_orderpriority")


@query("""SELECT event_id, kind FROM (
  SELECT event_id, nullif(event_type, 'view') AS kind FROM events) WHERE kind <> 'error'""")
def not_equal_filter(t):
    kinds = t.events.select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return kinds.filter(F.col("kind") != "error")


@query("""SELECT o_orderkey FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') OR o_orderstatus = 'P'""")
def compound_filter(t):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.filter(((status == "F") & (priority == "5-LOW")) | (status == "P")).select(
        "o_orderkey"
    )


@query("""SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'gear')""")
def pattern_filter(t):
    return t.part.filter(contains_any("p_name", ["ring", "gear"])).select("p_partkey", "p_name")


@query("""SELECT doc_id, lang FROM documents
WHERE regexp_matches(text, '[0-9]{4}-[0-9]{2}') OR regexp_matches(text, 'MIT|BSD')""")
def pattern_filter_regex(t):
    found = contains_any("text", ["[0-9]{4}-[0-9]{2}", "MIT|BSD"], regex=True)
    return t.documents.filter(found).select("doc_id", "lang")


def gappy_parts(t):
    return t.part.select(
        "p_partkey",
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("kind"),
        F.nullif(F.col("p_size"), F.lit(7)).alias("size"),
    )


GAPPY = """SELECT p_partkey, nullif(p_type, 'PROMO') AS kind, nullif(p_size, 7) AS size FROM part"""


@query(f"""SELECT * FROM ({GAPPY}) WHERE kind IS NOT NULL AND size IS NOT NULL""")
def complete_cases(t):
    return drop_incomplete(gappy_parts(t), ["kind", "size"])


@query(f"""SELECT count(*) FILTER (kind IS NULL) AS kind, count(*) FILTER (size IS NULL) AS size
FROM ({GAPPY})""")
def null_census(t):
    return null_count(gappy_parts(t), ["kind", "size"])
