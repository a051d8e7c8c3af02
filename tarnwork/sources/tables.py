"""Readers: Parquet tables with timestamps as UTC instants, tolerant JSON lines, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; its zone-less timestamps become timestamps (the session's zone is UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, if they come in fewer parts: a file or two, however many rows, are the work of as many tasks."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def json_lines(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> DataFrame:
    """JSON lines of which some may be damaged: the schema's columns, raw, reason.

    reason is NULL for a good line; else blank, not_json or missing:<field>.  Nothing is dropped here, so that callers
    can count what they skip.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    parsed = lines.withColumn("r", F.from_json("raw", StructType([*schema.fields]).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}))
    missing = F.coalesce(*[F.when(F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("")) == "", F.lit(f"missing:{c}")) for c in required]) if required else F.lit(None)
    reason = F.when(F.trim("raw") == "", "blank").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not_json").otherwise(missing)
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], "raw", reason.alias("reason"))


def append_json(df: DataFrame, path: str) -> None:
    """Append-only store of records."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace the rows of each key that ``df`` has; other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
