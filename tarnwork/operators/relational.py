"""Relational macros: top-k per key, latest and first wins, islands, null-aware filters, paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each task's rows before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; an aggregation with map-side combine, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def islands(df: DataFrame, keys: list[str], start: str, stop: str, touching: bool = True) -> DataFrame:
    """Number the runs of overlapping intervals of each key; ``touching``: an interval that begins where another ends belongs to it."""
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reached = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reached if touching else F.col(start) >= reached
    new = F.when(reached.isNull() | apart, 1).otherwise(0)
    return df.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def status_filter(column: Column, status: str, default: str = "new") -> Column:
    """NULL counts as the default status."""
    return (column == status) | (F.lit(status == default) & column.isNull())


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with total and has_more."""
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))  # one row


def running_counts(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(value, rows, before): rows of each distinct value of a column, and rows below it.  NULL values do not count.

    The values are cut into ranges at estimated quantiles; the ranges' totals are a table of ``parts`` rows at most, and
    within a range a window adds up, so no task sorts all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    bounds = counts.agg(F.percentile_approx("value", [i / parts for i in range(1, parts)]).alias("_bounds"))
    ranged = counts.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds")  # one row
    totals = ranged.groupBy("_range").agg(F.sum("rows").alias("_total"))
    below = totals.select("_range", F.coalesce(F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    within = F.coalesce(F.sum("rows").over(Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(below), "_range").select("value", "rows", (F.col("_below") + F.col("_within")).alias("before"))  # at most ``parts`` rows


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the mean rank, from 1, of the rows with each value."""
    return running_counts(df, column).select(F.col("value").alias(column), (F.col("before") + (F.col("rows") + 1) / 2).alias(name))


def values_at(df: DataFrame, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: the values at places (from 0) in the order of all of a column's values; places are given the number of values.

    A place between two whole numbers lies as far between their values; NULLs do not count; no task sorts all values.
    """
    counts = running_counts(df, value)
    known = counts.join(F.broadcast(counts.agg(F.sum("rows").alias("n"))))  # one row
    upto = F.col("before") + F.col("rows")
    least = lambda at: F.min(F.when(upto > at, F.col("value")))
    of = {name: at(F.col("n")).cast("double") for name, at in places.items()}
    ends = known.agg(*[x for name, at in of.items() for x in (least(F.floor(at)).alias(f"{name}_lo"), least(F.ceil(at)).alias(f"{name}_hi"), F.max(at - F.floor(at)).alias(f"{name}_part"))])
    between = lambda name: F.when(F.col(f"{name}_part") == 0, F.col(f"{name}_lo")).otherwise(F.col(f"{name}_lo") + F.col(f"{name}_part") * (F.col(f"{name}_hi") - F.col(f"{name}_lo")))
    return ends.select(*[between(name).alias(name) for name in places])


def index_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): the value at index floor(n * share) from 0, the last at most, of each key's sorted values.

    From counts of distinct values, combined before the shuffle; no key's rows are gathered in one row, and without keys no
    task orders all values.
    """
    at = lambda n, q: F.least(F.floor(n * F.lit(q)), n - 1)
    if not keys:
        return values_at(df, value, {c: lambda n, q=q: at(n, q) for c, q in shares.items()})
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(F.col("n"), q), F.col(value))).alias(c) for c, q in shares.items()])
