"""The corpus pipeline: documents through quality, line dedup, near-dedup, secret scan and packing.

Each stage reads all that its predecessor kept, and all but the last give the columns of documents. Between stages rows
are written as Parquet and read again, so that each stage recovers by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import durable, table
from cohortline.llm.line_dedup import line_dedup
from cohortline.llm.nbsvm import quality_scores
from cohortline.llm.queries import pack_documents
from cohortline.llm.secrets import scan_secrets
from cohortline.llm.simhash import one_per_group
from cohortline.session import release, written


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; n_chars, where there is one, follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 0 go. Null and empty texts are scored like others, by the
    constant alone; rows of equal texts fare alike, repeated rows stay or go together; ties don't arise, as the score decides."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of the source have go; every document stays, even if nothing is left of it."""
    return _measured(line_dedup(docs).select("row.*"), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints stays."""
    return one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays. Null texts stay null, empty ones empty; repeated rows are masked alike."""
    return _measured(scan_secrets(docs).select("row.*"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences. A null or empty text is its end id alone; repeated rows and null
    ids are packed each for itself; pieces of equal length are placed by id and start."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Fitted models and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage read and wrote on the way is deleted once its rows are written.

    An empty table goes through all stages and gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    before = len(written(spark))
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        release(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
