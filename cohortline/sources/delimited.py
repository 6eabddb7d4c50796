"""Delimited text in and out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.casting import parse_date, to_double, to_long

CORRUPT = "__unparsed"


def snake_case(header: str) -> str:
    """``Patient Name (MRN)`` and ``Patient.Name..MRN.`` → ``patient_name_mrn``; ``gNomen`` → ``g_nomen``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", header.strip())
    return re.sub(r"[^0-9a-z]+", "_", spaced.lower()).strip("_")


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        return to_long(text).try_cast(kind)
    if isinstance(kind, T.FractionalType):
        return to_double(text).try_cast(kind)
    if isinstance(kind, T.DateType):
        return parse_date(text, "iso")
    return text.try_cast(kind)


def _first_line(spark: SparkSession, path: str) -> str:
    """A file's first line, read on the driver through the file system and codec that Spark would use."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    plain = codec.createInputStream(stream) if codec is not None else stream
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
    try:
        return lines.readLine() or ""
    finally:
        lines.close()


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    sep: str = ",",
    null_tokens: Sequence[str] = ("NA",),
    ragged: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text with a header; columns are found by (normalised) name, in any order.

    Every file has its own header: files with the same one are read together, and the parts are united. Quotes inside
    quoted cells are doubled. With ``multi_line`` quoted cells may hold line breaks, for which a file can't be
    split among tasks. Columns the schema does not name are not read. Text in ``null_tokens`` is missing; an empty cell
    is the empty text in a text column unless ``""`` is such a token, and missing elsewhere.
    Unreadable numbers and dates become null. With ``ragged`` short rows are padded with nulls.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def reader():
        options = {"header": True, "sep": sep, "mode": "PERMISSIVE", "escape": '"', "multiLine": multi_line}
        return spark.read.options(**options)

    by_header: dict[str, list[str]] = {}
    for file in sorted(spark.read.text(paths).inputFiles()):
        if line := _first_line(spark, file):
            by_header.setdefault(line, []).append(file)
    parts = [_read_alike(reader, files, schema, null_tokens, ragged) for files in by_header.values()]
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _read_alike(reader, files: list[str], schema: T.StructType, null_tokens: Sequence[str], ragged: bool) -> DataFrame:
    """Files that share a header."""
    headers = reader().csv(files[0]).columns
    by_name = {snake_case(h): h for h in headers}
    absent = [f.name for f in schema if f.name not in by_name]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} among {', '.join(by_name)} in {files[0]}")

    raw_schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    short, rows = F.lit(False), reader()
    if ragged:
        raw_schema = raw_schema.add(CORRUPT, T.StringType())
        rows = rows.option("columnNameOfCorruptRecord", CORRUPT)
        short = F.col(CORRUPT).isNotNull()
    raw = rows.schema(raw_schema).csv(files)

    tokens = list(null_tokens)

    def cell(field: T.StructField) -> Column:
        text = F.col(f"`{by_name[field.name]}`")
        if isinstance(field.dataType, T.StringType) and "" not in tokens:
            text = F.coalesce(text, F.when(~short, F.lit("")))
        return _typed(F.when(~text.isin(tokens), text), field.dataType).alias(field.name)

    return raw.select(*[cell(f) for f in schema])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(
    df: DataFrame, path: str, order_by: Sequence[Column | str], mode: str = "errorifexists"
) -> None:
    """Write delimited text with a header, in order.

    Rows are range-partitioned, so part files follow one another in order and a large table is not
    squeezed through one task; a small one ends up in a single part.
    """
    df.orderBy(*order_by).write.mode(mode).option("header", True).option("escape", '"').csv(path)
