"""Boards over records that keep coming: pools, contexts, staleness, timelines, recurring findings, failure flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_k_per


def severity_weight(rating: Column, confidence: Column, in_meta: Column) -> Column:
    """Weight of a finding from its reviewer's rating (0 to 10, NULL is 5) and confidence (1 to 5, NULL is 3), 0.1 to 1."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(rating.cast("double"), F.lit(5.0))))
    c = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(confidence.cast("double"), F.lit(3.0))))
    weight = (1 - r / 10) * (c / 5) * F.when(in_meta, 1.5).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), weight))


def draft_health(critical: Column, major: Column, high_gaps: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 15 * critical - 8 * major - 5 * high_gaps).cast("int")


def over_cap(pool: DataFrame, keys: list[str], order: list[str], batch: int, most: int) -> DataFrame:
    """Rows to delete so that ``batch`` new ones fit: the oldest by ``order`` of each key beyond ``most`` - ``batch``."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return pool.withColumn("_turn", F.row_number().over(newest)).where(F.col("_turn") > max(0, most - batch)).drop("_turn")


def grouped_by_context(rows: DataFrame, ident: str, status: str, contexts: dict[str, str], overall: int = 5, each: int = 3) -> DataFrame:
    """(context, name, position, id): the first rows overall and of each name of each context, in order of ``ident``.

    contexts: context -> column of array<string>.  Dismissed rows are left out; a NULL status is not dismissed.
    """
    shown = rows.where(F.coalesce(F.col(status) != "dismissed", F.lit(True)))
    first = shown.orderBy(ident).limit(overall).select(F.lit("summary").alias("context"), F.lit("").alias("name"), F.col(ident).alias("id"))
    first = first.withColumn("position", F.row_number().over(Window.partitionBy("context").orderBy("id")))
    def labelled(context: str, column: str) -> Column:
        names = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(names, lambda x: F.struct(F.lit(context).alias("context"), x.alias("name")))

    named = F.flatten(F.array(*[labelled(k, c) for k, c in contexts.items()]))
    every = shown.select(F.col(ident).alias("id"), F.explode(named).alias("n")).select("n.*", "id")
    return top_k_per(every, ["context", "name"], [F.asc("id")], each, "position").unionByName(first)


def staleness(count_then: Column, count_now: Column, written: Column, latest: Column) -> Column:
    """Why stored insights are stale, NULL if they are not; an unknown time is no change."""
    counted = count_now != F.coalesce(count_then, F.lit(0))
    changed = F.coalesce(latest > written, F.lit(False))
    return F.when(counted & changed, "documents_changed_and_count_changed").when(counted, "document_count_changed").when(changed, "documents_changed")


def failures_since_success(calls: DataFrame, key: str, order: list[str], failed: Column, error: str) -> DataFrame:
    """(key, failures, last_error): failures after the key's last success.  Two aggregations with map-side combine, no sort."""
    marked = calls.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_at", F.struct(*order))
    success = marked.groupBy(key).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_success"))
    after = marked.where("_failed").join(success, key).where("_success is null or _at > _success")
    counted = after.groupBy(key).agg(F.count("*").alias("failures"), F.max_by(error, "_at").alias("last_error"))
    return success.select(key).join(counted, key, "left").select(key, F.coalesce("failures", F.lit(0)).alias("failures"), "last_error")


def recurring_patterns(findings: DataFrame, owner: str, version: str, text: str, least_versions: int = 3, most: int = 8) -> DataFrame:
    """(owner, pattern, n, versions array, rank): openings of 80 characters that an owner's findings share, most frequent first.

    Owners of fewer than ``least_versions`` versions have none; a pattern counts if it is found twice or more.
    """
    rows = findings.select(owner, version, F.lower(F.trim(F.substring(F.coalesce(text, F.lit("")), 1, 80))).alias("pattern")).where("pattern <> ''")
    many = findings.groupBy(owner).agg(F.count_distinct(version).alias("_n")).where(F.col("_n") >= least_versions).select(owner)
    counted = rows.join(many, owner, "left_semi").groupBy(owner, "pattern").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(version)).alias("versions"))
    return top_k_per(counted.where("n >= 2"), [owner], [F.desc("n"), F.asc("pattern")], most)


def first_and_last(runs: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, runs, first, last, delta) of keys with two runs or more."""
    at = F.struct(*order)
    ends = runs.groupBy(key).agg(F.count("*").alias("runs"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return ends.where("runs >= 2").withColumn("delta", F.col("last") - F.col("first"))


def effective_sample(weighted: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, n, n_eff): Kish's effective sample size; NULL where the weights' squares sum to 0."""
    squares = F.sum(F.col(weight) * F.col(weight))
    return weighted.groupBy(key).agg(F.count(weight).alias("n"), F.when(squares > 0, F.sum(weight) * F.sum(weight) / squares).alias("n_eff"))


def keyset_page(rows: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """The ``limit`` rows below ``before`` (all if None), from the largest down; the filter reaches the scan."""
    return (rows if before is None else rows.where(F.col(key) < before)).orderBy(F.desc(key)).limit(limit)
