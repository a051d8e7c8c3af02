"""Intervals and span trees: unions, overlaps, self time, concurrency, ancestors, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .relational import islands


def interval_union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """covered: length of the union of each key's intervals [start, stop]; busy: the sum of their lengths."""
    merged = islands(spans, keys, "start", "stop").groupBy(*keys, "island").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.sum(F.col("stop") - F.col("start")).alias("part"))
    return merged.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.sum("part").alias("busy"), F.count("*").alias("n_islands"))


def overlap_groups(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more intervals that truly overlap (touching is not enough)."""
    return islands(spans, keys, "start", "stop", touching=False).groupBy(*keys, "island").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop")).where("n > 1")


def in_flight(spans: DataFrame, keys: list[str]) -> DataFrame:
    """peak: the most intervals open at a time; those that end at an instant are closed before others open."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    running = F.sum("step").over(Window.partitionBy(*keys).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return ends.withColumn("open", running).groupBy(*keys).agg(F.max("open").alias("peak"))


def self_time(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(parent, total, child_time, self_time): a parent's length less the union of its children, clipped to it.

    parents: (parent, start, stop); children: (parent, start, stop).
    """
    p = parents.select("parent", F.col("start").alias("from"), F.col("stop").alias("to"))
    clipped = children.join(p, "parent").select("parent", F.greatest("start", "from").alias("start"), F.least("stop", "to").alias("stop")).where("stop > start")
    union = interval_union(clipped, ["parent"]).select("parent", F.col("covered").alias("child_time"))
    total = F.col("to") - F.col("from")
    return p.join(union, "parent", "left").select("parent", total.alias("total"), F.coalesce("child_time", F.lit(0.0)).alias("child_time"), (total - F.coalesce("child_time", F.lit(0.0))).alias("self_time"))


def longest_prefix_price(rows: DataFrame, name: str, prices: dict[str, float]) -> DataFrame:
    """Add price: that of the longest prefix of ``name``; NULL if none fits (unknown, not free)."""
    price = F.lit(None).cast("double")
    for prefix in sorted(prices, key=len):
        price = F.when(F.col(name).startswith(prefix), prices[prefix]).otherwise(price)
    return rows.withColumn("price", price)


def critical_path(spans: DataFrame) -> DataFrame:
    """(span_id, critical): the time for which each span alone kept its trace from ending; only spans with such time.

    spans: (span_id, parent_id, start, stop); spans without a parent are the roots.  Going back from a span's end, the child that
    ends last blocks it until that child's start, then the next child that began earlier, and so on; what no child blocks is
    the span's own.  The children before which the walk has come to an instant are those that end later, so that instant is a
    running minimum of their starts.  Shares of a trace sum to its root's length.  Ties: earlier start, then smaller id, first.
    """
    known = spans.where("stop > start").select("span_id", "parent_id", "start", "stop")
    level = known.where("parent_id is null").select("span_id", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    later = Window.partitionBy("parent_id").orderBy(F.desc("stop"), "start", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    shares = []
    while True:
        above = level.select(F.col("span_id").alias("parent_id"), "lo", "hi")
        below = stored(
            known.join(above, "parent_id")
            .withColumn("cursor", F.least("hi", F.coalesce(F.min("start").over(later), F.col("hi"))))
            .select("span_id", "parent_id", F.greatest("start", "lo").alias("lo"), F.least("stop", "cursor").alias("hi"))
            .where("hi > lo")
        )
        blocked = below.groupBy(F.col("parent_id").alias("span_id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("blocked"))
        shares.append(level.join(blocked, "span_id", "left").select("span_id", (F.col("hi") - F.col("lo") - F.coalesce("blocked", F.lit(0.0))).alias("critical")))
        if below.isEmpty():
            break
        level = below.select("span_id", "lo", "hi")
    found = shares[0]
    for s in shares[1:]:
        found = found.unionByName(s)
    return found.where("critical > 0")


def span_walls(spans: DataFrame) -> DataFrame:
    """(trace_id, wall): the run span's length, else from the first start to the last end of the roots; NULL if neither is known.

    spans: (trace_id, parent_id, kind, start, stop, duration); a known duration goes before the difference of start and stop.
    """
    wall = F.coalesce("duration", F.greatest(F.lit(0.0), F.col("stop") - F.col("start")))
    root = F.col("parent_id").isNull()
    return spans.groupBy("trace_id").agg(F.coalesce(
        F.max(F.when(F.col("kind") == "run", wall)), F.max(F.when(root, F.col("stop"))) - F.min(F.when(root, F.col("start")))
    ).alias("wall"))
