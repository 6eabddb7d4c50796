"""Text, number and date repair."""

from pyspark.sql import functions as F

from cohortline.functions import casting, dates, text
from cohortline.functions.significance import normalize_significance as reduce_wording
from workload.base import months_sql, query

WORDINGS = (
    "Pathogenic/Likely pathogenic", "Benign/Likely benign", "Likely benign", "Pathogenic",
    "Conflicting interpretations of pathogenicity", "not provided", "Other", "",
    "Uncertain significance", "Drug response|Benign", "Pathogenic, Risk factor", "Not in ClinVar",
    "Drug response", "VUS, other", "Likely pathogenic, Drug response",
)


def wording_sql(pick: str) -> str:
    values = ", ".join(f"'{w}'" for w in WORDINGS)
    return f"list_extract([{values}], CAST(1 + {pick} AS BIGINT))"


def wording(pick):
    return F.get(F.array(*[F.lit(w) for w in WORDINGS]), pick)


#: What each of the wordings is reduced to, worked out by hand from the described rewrites.
REDUCED = (
    "Likely pathogenic", "Likely benign", "Likely benign", "Pathogenic", "VUS", "Not in ClinVar", "Benign", "Not in ClinVar",
    "Uncertain significance", "Benign", "Risk factor", "Not in ClinVar", "Drug response", "VUS", "Likely pathogenic",
)


def significance_sql(value: str) -> str:
    cases = " ".join(f"WHEN '{raw}' THEN '{label}'" for raw, label in zip(WORDINGS, REDUCED))
    return f"CASE {value} {cases} END"


@query(f"""SELECT p_partkey, raw, {significance_sql("raw")} AS significance FROM (
  SELECT p_partkey, CASE WHEN p_size <> 50 THEN {wording_sql("p_partkey % 15")} END AS raw FROM part)""")
def normalize_significance(t):
    rows = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") != 50, wording((F.col("p_partkey") % 15).cast("int"))).alias("raw"),
    )
    return rows.withColumn("significance", reduce_wording("raw"))


@query("""SELECT p_partkey, coalesce(p_brand, 'NA') || '(' || coalesce(nullif(p_type, 'PROMO'), 'NA') || '):'
  || p_name || ' (' || p_size || ')' AS name,
  coalesce(nullif(p_type, 'PROMO'), 'NA') || '   ' || p_name AS key FROM part""")
def variant_name(t):
    kind = F.nullif(F.col("p_type"), F.lit("PROMO"))
    return t.part.select(
        "p_partkey",
        text.variant_name("p_brand", kind, "p_name", F.col("p_size")).alias("name"),
        text.variant_key(kind, "p_name").alias("key"),
    )


@query("""SELECT c_custkey, replace(c_name || '&gt;' || c_mktsegment, '&gt;', '>') AS fixed FROM customer""")
def entity_fix(t):
    escaped = F.concat("c_name", F.lit("&gt;"), "c_mktsegment")
    return t.customer.select("c_custkey", text.unescape_gt(escaped).alias("fixed"))


@query("""SELECT c_custkey, nullif(split_part(v, '#', 1), '') AS head, CASE WHEN contains(v, '#') THEN split_part(v, '#', 2) END AS tail FROM (
  SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE c_name || '#more' END AS v FROM customer)""")
def safe_split(t):
    joined = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise(
        F.concat("c_name", F.lit("#more"))
    )
    head, tail = text.split_pair(joined, "#")
    return t.customer.select("c_custkey", head.alias("head"), tail.alias("tail"))


@query("""SELECT l_orderkey, l_linenumber, 'CGL' || l_orderkey AS patient,
  'CGL' || l_orderkey || 'S' || l_suppkey AS sample, 'CGL' || l_orderkey AS ordered,
  'CGL' || l_orderkey || 'S' || l_suppkey AS joined FROM lineitem""")
def strip_ids(t):
    sample = F.concat(
        F.lit("CGL"), F.col("l_orderkey"), F.lit("S"), F.col("l_suppkey"), F.lit("T"),
        F.col("l_linenumber"),
    )
    order = F.concat(F.lit("CGL"), F.col("l_orderkey"), F.lit("-T"), F.col("l_linenumber"))
    ordered = text.strip_from(order, ".T")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        text.strip_from(sample, "S").alias("patient"),
        text.strip_from(sample, "T").alias("sample"),
        ordered.alias("ordered"),
        text.compact(ordered, F.concat(F.lit(" S "), F.col("l_suppkey"))).alias("joined"),
    )


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS mrn FROM customer""")
def paren_extract(t):
    named = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_name")).otherwise(
        F.concat("c_name", F.lit(" ("), F.col("c_custkey"), F.lit(")"))
    )
    return t.customer.select(
        "c_custkey", casting.to_long(text.between_parentheses(named)).alias("mrn")
    )


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Not Designated' ELSE c_mktsegment END AS site,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'non-coding' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS effect,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'Unknown' ELSE c_mktsegment END AS pattern
FROM customer""")
def blank_defaults(t):
    value = F.when(F.col("c_mktsegment") == "BUILDING", "").when(
        F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")
    )
    return t.customer.select(
        "c_custkey",
        text.blank_to(value, "Not Designated").alias("site"),
        text.empty_to(value, "non-coding").alias("effect"),
        text.null_to(value, "Unknown").alias("pattern"),
    )


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS number,
  CASE WHEN event_type <> 'error' THEN CAST(trunc(value) AS BIGINT) END AS whole FROM events""")
def number_repair(t):
    written = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.col("value").cast("string")
    )
    return t.events.select(
        "event_id",
        casting.to_double(written).alias("number"),
        casting.to_long(written).alias("whole"),
    )


@query(f"""WITH spans AS (
  SELECT o_custkey AS mrn, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e,
         count(*) AS n FROM orders GROUP BY 1),
closed AS (SELECT mrn, s, CASE WHEN n > 5 THEN e ELSE DATE '2002-02-28' END AS e FROM spans)
SELECT mrn, {months_sql("s", "e")} AS months FROM closed""")
def completed_months(t):
    day = F.col("o_orderdate").cast("date")
    spans = t.orders.groupBy(F.col("o_custkey").alias("mrn")).agg(
        F.min(day).alias("s"), F.max(day).alias("e"), F.count("*").alias("n")
    )
    ended = F.when(F.col("n") > 5, F.col("e"))
    return spans.select("mrn", dates.followed_months("s", ended, "2002-02-28").alias("months"))


@query("""SELECT o_orderkey, d AS mdy2, d AS ymd2, d AS mdy4, d AS mdy, d AS iso, CAST(NULL AS DATE) AS bad
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def parse_dates(t):
    written = {
        "mdy2": "MM/dd/yy", "ymd2": "yyMMdd", "mdy4": "M/d/yyyy", "mdy": "M-d-yyyy", "iso": "yyyy-MM-dd",
    }
    return t.orders.select(
        "o_orderkey",
        *[
            casting.parse_date(F.date_format("o_orderdate", pattern), style).alias(style)
            for style, pattern in written.items()
        ],
        casting.parse_date(F.concat(F.lit("13/45/"), F.year("o_orderdate")), "mdy4").alias("bad"),
    )


@query("""SELECT o_orderkey, CASE WHEN y % 100 > 18 THEN make_date(1900 + y % 100, m, LEAST(d, 28))
  ELSE make_date(2000 + y % 100, m, LEAST(d, 28)) END AS dob,
  make_date(y, m, LEAST(d, 28)) AS written_out
FROM (SELECT o_orderkey, CAST(1930 + o_custkey % 80 AS BIGINT) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)""")
def year_pivot(t):
    year = 1930 + F.col("o_custkey") % 80
    month, day = F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(28))
    short = F.concat_ws("/", month, day, year % 100)
    full = F.concat_ws("/", month, day, year)
    return t.orders.select(
        "o_orderkey",
        casting.pivot_year(casting.parse_date(short, "mdy4")).alias("dob"),
        casting.pivot_year(casting.parse_date(full, "mdy4")).alias("written_out"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS age,
  round((CAST(l_shipdate AS DATE) - DATE '1995-01-01') / 30.0, 6) AS months FROM lineitem""")
def day_difference(t):
    age = dates.days_between(F.lit("1995-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        age.cast("bigint").alias("age"),
        F.round(dates.plotted_months(age), 6).alias("months"),
    )
