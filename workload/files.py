"""Delimited files written from the tables and read back."""

import uuid

from pyspark.sql import functions as F

from cohortline.session import shared_folder
from cohortline.sources.delimited import read_delimited, write_table
from cohortline.sources.schemas import DATE, NUMBER, TEXT, WHOLE, schema
from workload.base import query


def new_folder(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/delimited-{uuid.uuid4().hex}"


@query("""SELECT nullif(c_custkey, 999) AS c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN NULL
  ELSE c_mktsegment END AS segment, c_name || ', "' || c_mktsegment || '"' AS quoted, c_acctbal FROM customer""")
def delimited_null_tokens(t):
    """Comma-delimited, with two tokens for a missing value in any column, and text to be quoted."""
    segment = (
        F.when(F.col("c_mktsegment") == "BUILDING", "NA")
        .when(F.col("c_mktsegment") == "MACHINERY", "999")
        .otherwise(F.col("c_mktsegment"))
    )
    rows = t.customer.select(
        F.col("c_custkey").alias("c.custkey"),
        segment.alias("Segment"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("Quoted"),
        F.col("c_acctbal").alias("c.acctbal"),
    )
    folder = new_folder(t)
    write_table(rows, folder, ["`c.custkey`"])
    kinds = schema(c_custkey=WHOLE, segment=TEXT, quoted=TEXT, c_acctbal=NUMBER)
    return read_delimited(t.spark, folder, kinds, null_tokens=["NA", "999"])


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate FROM orders""")
def delimited_ragged(t):
    """Tab-delimited rows of two lengths; what the short ones lack is missing."""
    head = F.concat_ws("\t", "o_orderkey", "o_orderstatus")
    full = F.concat_ws("\t", head, "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.when(F.col("o_orderstatus") == "F", head).otherwise(full)
    folder = new_folder(t)
    # the writer's own header line names all four columns in every part
    t.orders.select(
        line.alias("o_orderkey\to_orderstatus\to_orderpriority\to_orderdate")
    ).write.option("header", True).option("sep", "\x01").option("quote", "").csv(folder)
    kinds = schema(o_orderkey=WHOLE, o_orderstatus=TEXT, o_orderpriority=TEXT, o_orderdate=DATE)
    return read_delimited(t.spark, folder, kinds, sep="\t", ragged=True)


@query("""SELECT c_custkey, 'say "' || c_name || '", ' || c_mktsegment AS said, c_acctbal FROM customer""")
def delimited_quoted(t):
    """Lines as other tools write them: quoted cells with commas and doubled quotes; two files of different column order."""
    said = F.concat(F.lit('"say ""'), "c_name", F.lit('"", '), "c_mktsegment", F.lit('"'))
    folder = new_folder(t)
    halves = (
        (F.col("c_custkey") % 2 == 0, "c_custkey,said,c_acctbal", ["c_custkey", said, "c_acctbal"]),
        (F.col("c_custkey") % 2 == 1, "c_acctbal,c_custkey,said", ["c_acctbal", "c_custkey", said]),
    )
    for number, (chosen, header, cells) in enumerate(halves):
        lines = t.customer.filter(chosen).select(F.concat_ws(",", *cells).alias(header))
        lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(f"{folder}/{number}")
    kinds = schema(c_custkey=WHOLE, said=TEXT, c_acctbal=NUMBER)
    return read_delimited(t.spark, [f"{folder}/0", f"{folder}/1"], kinds)
