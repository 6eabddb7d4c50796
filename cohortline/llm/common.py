"""What several corpus operators share: table access, durable steps, safe column handling, plain byte helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.session import durable, ship

__all__ = ["ASCII_SPACE", "durable", "pack_row", "ship", "table", "unpack_row"]

#: Space and U+0009 to U+000D, the only characters that separate words here; bytes.split() cuts at the same ones.
ASCII_SPACE = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pack_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``_row`` beside internal columns, so that no column of the input can clash."""
    return df.select(F.struct("*").alias("_row"), *[c.alias(f"_{name}") for name, c in columns.items()])


def unpack_row(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The packed columns again, some of them replaced."""
    return df.select(*[replaced.get(n, F.col("_row").getField(n)).alias(n) for n in names])
