"""Summaries of usage, cost and load, boards over runs, and checks that rows belong together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_k_per, values_at


def cost_summary(costs: DataFrame) -> DataFrame:
    """One row over (user_id, cost): users, total, mean, median (of an even number the mean of the two), p90 and p95 at index floor(n * share)."""
    s = costs.agg(F.count("*").alias("users"), F.sum("cost").alias("total"), F.avg("cost").alias("mean"))
    at = lambda q: lambda n: F.least(F.floor(n * F.lit(q)), n - 1)
    q = values_at(costs, "cost", {"median": lambda n: (n - 1) / 2, "p90": at(0.9), "p95": at(0.95)})
    return s.join(F.broadcast(q))  # one row each


def load_summary(requests: DataFrame, slo_seconds: float) -> DataFrame:
    """One row over requests (scheduled, finished, response, error, warmup): counts, window, throughput, goodput, percentiles.

    Warm-up does not count.  The window runs from the first arrival to the last end, so that waiting counts; goodput
    is of requests that worked within the objective.
    """
    measured, ok = ~F.col("warmup"), F.col("error").isNull()
    s = requests.agg(
        F.count("*").alias("offered"), F.count_if("warmup").alias("warmup"), F.count_if(measured).alias("measured"), F.count_if(measured & ok).alias("ok"),
        F.count_if(measured & ok & (F.col("response") <= slo_seconds)).alias("within_slo"), (F.max(F.when(measured, F.col("finished"))) - F.min(F.when(measured, F.col("scheduled")))).alias("window"))
    p = values_at(requests.where(measured & ok), "response", {name: lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)), F.lit(1)) - 1 for name, q in (("p50", 0.5), ("p95", 0.95))})
    s = s.withColumn("window", F.greatest("window", F.lit(1e-9)))
    return s.withColumn("throughput", F.col("ok") / F.col("window")).withColumn("goodput", F.col("within_slo") / F.col("window")).join(F.broadcast(p))  # one row each


def error_kinds(requests: DataFrame) -> DataFrame:
    """(kind, n): failed requests by what stands before the colon of their error."""
    return requests.where("error IS NOT NULL").groupBy(F.element_at(F.split("error", ":"), 1).alias("kind")).agg(F.count("*").alias("n"))


def savings(costs: DataFrame, order: str, cost: str) -> DataFrame:
    """Add saved (the cost of all nodes before) and share (of all cost); a row for each node, so one task may order them."""
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum(cost).over(before), F.lit(0.0))
    return costs.withColumn("saved", saved).withColumn("share", F.try_divide("saved", F.sum(cost).over(Window.partitionBy(F.lit(0)))))


def weighted_recall(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, units, recall, plain): matched weight over all weight (NULL without weight), and the plain share of units (weight, matched)."""
    hit = F.coalesce(F.sum(F.when(F.col("matched"), F.col("weight"))), F.lit(0.0))
    return units.groupBy(*keys).agg(F.count("*").alias("units"), F.when(F.sum("weight") > 0, hit / F.sum("weight")).alias("recall"), F.avg(F.col("matched").cast("double")).alias("plain"))


def superseded(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """(keys, name, current, superseded_by): the latest row of each key is current, the others know what took their place."""
    last = rows.groupBy(*keys).agg(F.max_by(name, F.struct(*order)).alias("_last"))
    joined = rows.join(last, keys)
    current = F.col(name) == F.col("_last")
    return joined.select(*keys, name, current.alias("current"), F.when(~current, F.col("_last")).alias("superseded_by"))


def run_board(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, headline, last, delta, invalid) of runs (keys, at, run, value, invalid).

    Invalid runs are counted apart.  The last valid run is the headline; delta, from the first, needs two of them.
    """
    valid = ~F.col("invalid")
    only = lambda c: F.when(valid, F.col(c))
    b = runs.groupBy(*keys).agg(
        F.count_if(valid).alias("runs"), F.max_by("run", only("at")).alias("headline"), F.max_by("value", only("at")).alias("last"), F.min_by("value", only("at")).alias("first"), F.count_if("invalid").alias("invalid"))
    return b.where("runs > 0").withColumn("delta", F.when(F.col("runs") >= 2, F.col("last") - F.col("first")))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): how often each value of each column occurs, and the number of rows as field ``all``; one pass."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    every = F.struct(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value"))
    return df.select(F.explode(F.array(*fields, every)).alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


def cost_board(sinks: dict[str, DataFrame]) -> DataFrame:
    """(sink, usd, unpriced) of each sink (usd); the total is NULL, as sinks may count the same call twice."""
    parts = [s.agg(F.lit(name).alias("sink"), F.round(F.sum("usd"), 2).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced")) for name, s in sinks.items()]
    total = parts[0].select(F.lit("total").alias("sink"), F.lit(None).cast("double").alias("usd"), F.lit(None).cast("long").alias("unpriced"))
    return reduce(DataFrame.unionByName, [*parts, total])


def section_summary(kinds: list[DataFrame], statuses: list[str], section: str = "introduction", status: str = "new") -> DataFrame:
    """(section, one column a status, total) over all kinds of feedback (section, status); missing ones take the defaults."""
    rows = reduce(DataFrame.unionByName, kinds).select(F.coalesce("section", F.lit(section)).alias("section"), F.coalesce("status", F.lit(status)).alias("status"))
    return rows.groupBy("section").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def rewarded_domains(people: DataFrame, person: str, free: list[str], least: int) -> DataFrame:
    """(domain, completed) of mail domains, free ones aside, with ``least`` people (person, email) or more."""
    domain = F.lower(F.element_at(F.split("email", "@"), -1))
    return people.select(person, domain.alias("domain")).where(~F.col("domain").isin(free)).groupBy("domain").agg(F.countDistinct(person).alias("completed")).where(F.col("completed") >= least)


def most_frequent(values: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """(key, value, n): the most frequent values of each key; of equally frequent ones the first seen."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return top_k_per(counts, [key], [F.desc("n"), F.asc("_first"), F.asc(value)], most).select(key, value, "n")


def integrity(violations: dict[str, DataFrame]) -> DataFrame:
    """(check_name, broken): how many rows break each check."""
    return reduce(DataFrame.unionByName, [v.agg(F.lit(name).alias("check_name"), F.count("*").alias("broken")) for name, v in violations.items()])


def isolated(rows: DataFrame, run: str, active: Column, published: str) -> DataFrame:
    """The rows, if each is of the active run and published; the first that is not stops the query."""
    wrong = F.when(~F.col(run).eqNullSafe(active), F.concat(F.lit("isolation violation: run "), F.coalesce(F.col(run).cast("string"), F.lit("none"))))
    wrong = F.coalesce(wrong, F.when(~F.coalesce(F.col(published), F.lit(False)), F.lit("isolation violation: not published")))
    return rows.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))
