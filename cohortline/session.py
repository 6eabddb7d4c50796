"""Session settings the operators rely on, the package on the executors, and durable cuts of a long lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime (SQL) settings only; everything here may be changed on a live session.
RUNTIME_SETTINGS = {
    # calendar arithmetic must not depend on where the driver runs
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # join-backs meet hot subjects: let AQE split the hot partition, even when a later
    # aggregate on the same key then needs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are designed for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shared-")


_shipped: set[str] = set()


def written(spark: SparkSession) -> list[str]:
    """Folders that this session has written and not released; other sessions have lists of their own."""
    return spark.__dict__.setdefault("_cohortline_written", [])


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver was started; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    # Spark serves this file to the executors; its folder belongs to the driver's Spark
    target = os.path.join(context._temp_dir, f"{root.name}-package.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session that names none (tests) gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _local_folder()
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder and reading them back.

    For rows that several later steps use: a lost executor costs no recomputation of what led here,
    and each of the steps reads only the columns it needs. Runs when called. The rows stay until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cohortline-{uuid.uuid4().hex}"
    written(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete what ``durable`` has written in this session so far, but for the first ``since`` folders and the last ``keep``
    ones; results that were not written elsewhere can't be read after that."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    mine, gone = written(spark), 0
    for folder in mine[since:len(mine) - keep]:
        mine.remove(folder)
        path = paths(folder)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Release what ``durable`` writes within the block at its end; what was written before stays."""
    before = len(written(spark))
    try:
        yield
    finally:
        release(spark, before)
