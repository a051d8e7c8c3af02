"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only on a local master (tests) is a temporary folder set where neither is; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of each query when the query ends."""
    known = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if known is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, known)


@contextmanager
def small_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, tasks of queries that run get ``most`` rows at a time in Python, for rows that are large."""
    known = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, known)


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: several readers do not repeat the work, and a lost executor costs a reread only.  The shuffle
    files of the write go when it ends.  ``group_bytes``: of a row group, which a reader holds as a whole; for large rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    schema = df.schema
    writer = df.write
    if group_bytes:
        # rows are checked one by one, as a hundred of them may be far beyond that size
        writer = writer.options(**{"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4"})
    with tidy(spark):
        writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files that a table of ``stored`` reads; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
