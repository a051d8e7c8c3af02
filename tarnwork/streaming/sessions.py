"""Streams with state of their own that expires: progress that never falls back, and limits of events per key and window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import latest_wins

#: Groups of keys whose limits are one state of a window.
LIMIT_BUCKETS = 256


def progress_snapshots(stream: DataFrame, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """Changes (key, percent, step, at, expired) of the snapshots of a stream (key long, event_id long, ts timestamp, step, percent double).

    A snapshot's percent never falls; its step is that of the last event (by time, then id).  A key that is silent for longer than
    ``ttl_seconds`` is forgotten: later events begin anew, and once the watermark is past that time the change says that it is
    expired and the state goes.  Null percents count as 0; rows without key or time are left out.
    """
    ttl = ttl_seconds * 1000

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            percent, step, at = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "percent": [percent], "step": [step], "at": [at], "expired": [True]})
            return
        percent, step, at = state.get if state.exists else (0.0, None, None)
        rows = pd.concat(list(frames)).sort_values(["millis", "event_id"])
        for millis, said, value in zip(rows["millis"].tolist(), rows["step"].tolist(), rows["percent"].tolist()):
            value = 0.0 if value is None or value != value else value
            percent = value if at is None or millis - at > ttl else max(percent, value)
            if at is None or millis >= at:
                step, at = said, millis
        gone = at + ttl <= state.getCurrentWatermarkMs()
        if gone:
            if state.exists:
                state.remove()
        else:
            state.update((float(percent), step, int(at)))
            state.setTimeoutTimestamp(int(at) + ttl)
        yield pd.DataFrame({"key": [key[0]], "percent": [percent], "step": [step], "at": [at], "expired": [gone]})

    known = stream.where("key is not null and ts is not null").withWatermark("ts", late).withColumn("millis", F.unix_millis("ts"))
    return known.groupBy("key").applyInPandasWithState(follow, "key long, percent double, step string, at long, expired boolean", "percent double, step string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def limited(stream: DataFrame, most: int, window_seconds: int, late: str = "1 hour", buckets: int = LIMIT_BUCKETS) -> DataFrame:
    """The events (key long, event_id long, ts timestamp) that are let through: of each key and window the first ``most`` to come.

    Of those that come together the earlier (then of smaller id) are first.  The counts of a window go once the watermark is past its
    end.  Keys are dealt into ``buckets``; a state holds the counts of a bucket's keys in a window, so a batch has as many groups as
    buckets and windows, however many keys there are.
    """
    width = window_seconds * 1000

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows[["key", "millis", "event_id"]].sort_values(["key", "millis", "event_id"])
        return ordered[ordered.groupby("key").cumcount() < most]

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = None
        for frame in frames:
            held = first(frame if held is None else pd.concat([held, frame]))
        seen = pd.Series(dtype="int64")
        if state.exists:
            keys, counts = (np.frombuffer(part, np.int64) for part in state.get)
            seen = pd.Series(counts, keys)
        rows = held[held.groupby("key").cumcount() + held["key"].map(seen).fillna(0) < most]
        end = (int(key[1]) + 1) * width
        if end > state.getCurrentWatermarkMs():
            seen = seen.add(rows.groupby("key").size(), fill_value=0).astype("int64")
            state.update((seen.index.to_numpy(np.int64).tobytes(), seen.to_numpy().tobytes()))
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "window": int(key[1]), "event_id": rows["event_id"].to_numpy()}).astype({"key": "int64", "window": "int64", "event_id": "int64"})

    millis = F.unix_millis("ts")
    known = stream.where("key is not null and ts is not null").select(F.col("key").cast("long").alias("key"), "event_id", "ts").withWatermark("ts", late).withColumn("millis", millis)
    known = known.withColumn("window", F.floor(millis / width).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return known.groupBy("bucket", "window").applyInPandasWithState(follow, "key long, window long, event_id long", "keys binary, counts binary", "append", GroupStateTimeout.EventTimeTimeout)


def gathered(changes: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there; its rows, or with ``keys`` the last change of each key.

    Each batch is written once under its own number, so a batch that is run again replaces itself.
    """
    spark, out = changes.sparkSession, f"{folder}/out"
    fields = changes.schema
    spark.createDataFrame([], fields).withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = changes.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    schema = spark.createDataFrame([], fields).withColumn("batch", F.lit(0).cast("long")).schema
    every = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    return (latest_wins(every, keys, ["batch"]) if keys else every).drop("batch")
