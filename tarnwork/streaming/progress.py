"""Structured Streaming over the events: latest state per key, counters per day, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files; its zone-less time as an instant."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders: the glob lets it read a single file as well
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def latest_per_key(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by time, ties by event_id; state is one row a key."""
    last = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id"))
    return stream.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def user_day_count(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


def tumbling(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts per window; with a watermark, so that state of closed windows is dropped.  (An extension.)"""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def settled(result: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run the stream over all that is there and return its final table, written to ``folder`` by each batch; an empty stream has an empty one."""
    spark = result.sparkSession
    out = f"{folder}/out"
    spark.createDataFrame([], result.schema).write.parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.parquet(out)
