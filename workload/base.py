"""Registry, and the roles the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.dates import completed_months
from cohortline.session import configure
from cohortline.sources.delimited import read_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The tables of one scale factor, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = read_table(self.spark, self.folder, name)
        setattr(self, name, table)
        return table


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its name, beside its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        QUERIES[name or build.__name__] = Query(run, sql)
        return build

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# --- repeated measurements: orders of a customer, one variant per priority -----------------------

AF = "0.5 + o_totalprice * 0.4 / 1e6"


def observations(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("mrn"),
        F.col("o_orderstatus").alias("gene"),
        F.col("o_orderpriority").alias("variant"),
        F.col("o_orderdate").cast("date").alias("test_date"),
        (0.5 + F.col("o_totalprice") * 0.4 / 1e6).alias("af"),
    )


OBSERVATIONS = f"""
obs AS (
  SELECT o_orderkey AS call_id, o_custkey AS mrn, o_orderstatus AS gene,
         o_orderpriority AS variant, CAST(o_orderdate AS DATE) AS test_date, {AF} AS af
  FROM orders
)"""


def grade_case(v: str, m: str, preset: str = "B") -> str:
    loose, widest = {"A": ("0.12", "0.12"), "B": ("0.1", "0.2")}[preset]
    return f"""CASE
    WHEN {v} <= 0.03 AND {m} > {loose} THEN 1
    WHEN {v} < 0.03 AND {m} < {loose} THEN 2
    WHEN {v} > 0.03 AND {v} <= 0.05 AND {m} > {loose} THEN 2
    WHEN {v} > 0.03 AND {v} <= 0.05 AND {m} < {loose} THEN 3
    WHEN {v} > 0.05 AND {v} <= {loose} AND {m} > {loose} THEN 3
    WHEN {v} > 0.05 AND {v} <= {widest} AND {m} < {widest} THEN 4
    ELSE 5 END"""


def profile_sql(preset: str = "B", source: str = "obs", keys: str = "mrn, variant") -> str:
    subject = keys.split(",")[0]
    return f"""
cvs AS (
  SELECT {keys}, count(*) AS n_obs, coalesce(stddev_samp(af) / nullif(avg(af), 0), 1.0) AS variance
  FROM {source} GROUP BY {keys}
),
widest AS (SELECT *, max(variance) OVER (PARTITION BY {subject}) AS max_cv FROM cvs),
profile AS (SELECT *, {grade_case("variance", "max_cv", preset)} AS grade FROM widest)"""


# --- followed subjects: a customer from the first to the last order ------------------------------


def followed(t: Tables) -> DataFrame:
    """Months from first to last order; died if the last order is F; arm = first order's status."""
    step = F.struct(
        F.col("o_orderdate").cast("date").alias("d"),
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("s"),
    )
    ends = t.orders.groupBy(F.col("o_custkey").alias("mrn")).agg(
        F.min(step).alias("a"), F.max(step).alias("z"), F.count("*").alias("n_orders")
    )
    return ends.select(
        "mrn",
        completed_months("a.d", "z.d").alias("months"),
        (F.col("z.s") == "F").alias("died"),
        F.col("a.s").alias("arm"),
        F.when(F.col("n_orders") >= 10, "many").otherwise("few").alias("volume"),
    )


def months_sql(start: str, end: str) -> str:
    calendar = f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"
    return (
        f"CAST({calendar} - CASE WHEN {start} + to_months(CAST({calendar} AS INTEGER)) > {end}"
        f" THEN 1 ELSE 0 END AS INTEGER)"
    )


FOLLOWED = f"""
numbered AS (
  SELECT o_custkey AS mrn, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down,
         count(*) OVER (PARTITION BY o_custkey) AS n_orders
  FROM orders
),
followed AS (
  SELECT a.mrn, {months_sql("a.d", "z.d")} AS months, z.s = 'F' AS died, a.s AS arm,
         CASE WHEN a.n_orders >= 10 THEN 'many' ELSE 'few' END AS volume
  FROM numbered a JOIN numbered z ON a.mrn = z.mrn AND a.up = 1 AND z.down = 1
)"""


# --- scored and labelled items -------------------------------------------------------------------


def scored(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("doc_id", "n_chars", "quality", "toxic")


SCORED = """
scored AS (
  SELECT l.doc_id, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


# --- tails in SQL --------------------------------------------------------------------------------


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = "0.17087277"
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418,
              0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + ({a}))"
    tail = f"{t} * exp(-({x}) * ({x}) + {poly})"
    return f"(CASE WHEN ({x}) >= 0 THEN {tail} ELSE 2.0 - {tail} END)"


def normal_cdf_sql(x: str) -> str:
    return f"(0.5 * {erfc_sql(f'(-({x}) / sqrt(2.0::DOUBLE))')})"
