"""Keeping records in order: gates, filling from parents, merging of sources, expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wording import normal_finding
from ..sources.stored import stored
from .relational import first_wins, latest_wins, top_k_per

#: The least parser quality and page coverage of the two gates.
PUBLISH_PARSER, PUBLISH_COVERAGE = 0.55, 0.75
HALT_PARSER, HALT_COVERAGE = 0.6, 0.7


def publish_gate(parser: Column, blocked: Column, is_pdf: Column, tasks: Column, coverage: Column, pruned: Column) -> Column:
    """The verdict on a run, first rule that holds; an unknown (NULL) figure holds no rule."""
    return (
        F.when(F.coalesce(blocked, F.lit(False)) | (parser < PUBLISH_PARSER), "needs_parser_review")
        .when(is_pdf & (tasks > 0) & (coverage < PUBLISH_COVERAGE), "needs_retry")
        .when(F.coalesce(pruned, F.lit(False)), "ok_sources_pruned").otherwise("ok")
    )


def halt_reasons(parser: Column, blocked: Column, coverage: Column) -> Column:
    """Array of the reasons to halt before the reviewers; NULL figures never halt."""
    return F.array_compact(F.array(F.when(blocked, "blocked"), F.when(parser < HALT_PARSER, "parser"), F.when(coverage < HALT_COVERAGE, "coverage")))


def fill_from_parent(children: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """Children whose ``column`` is NULL take their parent's; parents: (key, column), one row a key."""
    given = parents.select(F.col(key).alias("_of"), F.col(column).alias("_given"))
    return children.join(given, F.col(key) == F.col("_of"), "left").withColumn(column, F.coalesce(column, "_given")).drop("_of", "_given")


def first_source_wins(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of the sources, one row a key: that of the first source, in it the first by ``order``; source counts from 0."""
    every = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    return first_wins(every, [key], ["source", *order])


def best_per_key(df: DataFrame, key: str, score: str, tie: str, most: int) -> DataFrame:
    """The ``most`` best rows of each key; rows without a key are left out."""
    return top_k_per(df.where(F.col(key).isNotNull()), [key], [F.desc(score), F.asc(tie)], most)


def task_fingerprint(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the first 220 characters of the parts' normal form (without stopwords); empty parts do not count."""
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.substring(F.sha1(F.substring(normal_finding(joined), 1, 220)), 1, 16)


#: How severe a task is.
SEVERITY_RANK = {"critical": 4, "major": 3, "minor": 2, "suggestion": 1}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.lower(severity)], F.lit(0))


def strength(severity: Column, page: Column, action: Column, order: Column) -> Column:
    """What the stronger of two tasks has more of: severity, then a known page, then the longer action, then the earlier place."""
    return F.struct(severity_rank(severity).alias("severity"), page.isNotNull().alias("anchored"), F.length(F.coalesce(action, F.lit(""))).alias("length"), (-order).alias("order"))


def merge_anchor_collisions(tasks: DataFrame, order: str) -> DataFrame:
    """Tasks (order, anchor, problem, severity, page, action, protected) of which those with the same normal anchor become one.

    The stronger task stays (strength over the tasks as they came); the others' problems, in order, that its action does
    not name are its ``points``; ``duplicates`` counts them with what was merged.  Protected tasks, and tasks whose anchor
    has fewer than four telling words, stand alone.
    """
    anchor = F.col("_anchor")
    alone = F.col("protected") | (F.size(F.split(anchor, " ")) < 4) | (anchor == "")
    key = F.when(alone, F.concat(F.lit("#"), F.col(order).cast("string"))).otherwise(F.sha2(anchor, 256))
    power = strength(F.col("severity"), F.col("page"), F.col("action"), F.col(order))
    # stored, as four readers need the key of a whole text
    keyed = stored(tasks.withColumn("_anchor", normal_finding(F.col("anchor"))).withColumns({"_key": key, "_power": power}).drop("_anchor"))
    best = keyed.groupBy("_key").agg(F.max("_power").alias("_best"), F.count("*").alias("_n"))
    marked = keyed.join(best, "_key").withColumn("_stays", F.col("_power") == F.col("_best"))
    kept = marked.where("_stays")
    other = marked.where("NOT _stays AND trim(coalesce(problem, '')) <> ''").select("_key", F.col(order).alias("_o"), F.trim("problem").alias("_p"))
    named = other.join(kept.select("_key", F.coalesce("action", F.lit("")).alias("_a")), "_key").where(~F.contains(F.col("_a"), F.col("_p")))
    points = named.groupBy("_key", "_p").agg(F.min("_o").alias("_o")).groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_p"))), lambda x: x["_p"]).alias("points"))
    return kept.join(points, "_key", "left").select(*tasks.columns, (F.col("_n") - 1).alias("duplicates"), F.coalesce("points", F.expr("cast(array() as array<string>)")).alias("points"))


def unexpired(df: DataFrame, written: str, ttl_seconds: float, now: Column) -> DataFrame:
    """Rows that have not expired at ``now``; a NULL time never expires."""
    return df.where(F.col(written).isNull() | (F.unix_micros(written) + int(ttl_seconds * 1e6) >= F.unix_micros(now)))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of the same keys; of several changes the last by ``order``.

    Both have the same columns.  NULL keys equal nothing in ``current``: its rows stay.
    """
    latest = latest_wins(changes, keys, order).select(*current.columns)
    return current.join(latest.select(*keys), keys, "left_anti").select(*latest.columns).unionByName(latest)


def published(rows: DataFrame, pointers: DataFrame, owner: str, run: str) -> DataFrame:
    """Rows with is_published: true for those of their owner's active run; pointers: (owner, active), one row an owner.

    Rows of owners without a pointer are not published.  Written as one table, the change shows at once or not at all.
    """
    active = pointers.select(F.col(owner).alias("_of"), F.col("active").alias("_active"))
    return rows.join(active, F.col(owner) == F.col("_of"), "left").withColumn("is_published", F.coalesce(F.col(run) == F.col("_active"), F.lit(False))).drop("_of", "_active")


def reference_keys(references: DataFrame) -> DataFrame:
    """(scope, key, position): under what a reference list's entries are cited; of entries with the same key the last counts.

    references: (scope, position from 1, author, year).  Keys: the position, and the first author's first and last word, alone
    and with the year.
    """
    words = F.filter(F.split(F.lower(F.coalesce("author", F.lit(""))), r"\s+"), lambda w: w != "")
    names = F.transform(F.array_compact(F.array(F.get(words, F.lit(0)), F.get(words, F.size(words) - 1))), lambda w: F.btrim(w, F.lit(".,;")))
    named = references.select("scope", "position", "year", F.explode(F.filter(F.array_distinct(names), lambda w: w != "")).alias("name"))
    year = F.col("year").cast("string")
    spoken = named.select("scope", "position", F.explode(F.array_compact(F.array(F.col("name"), F.concat("name", year), F.concat("name", F.lit(" "), year)))).alias("key"))
    ordinal = references.select("scope", "position", F.col("position").cast("string").alias("key"))
    return ordinal.unionByName(spoken).groupBy("scope", "key").agg(F.max("position").alias("position"))


#: The forms of a citation marker, "[5]" or "5", and "Smith et al. (2020)".
NUMERIC_MARKER = r"^\[?(\d{1,3})\]?$"
AUTHOR_YEAR_MARKER = r"^\(?([A-Z][A-Za-z\-]+)(?:\s+et\s+al\.)?[,\s\(]+(\d{4}[a-z]?)\)?"


def resolve_markers(markers: DataFrame, references: DataFrame) -> DataFrame:
    """``markers`` (scope, marker, ...) with position: the reference that each marker names, else NULL.

    An author-year marker falls back to the author alone.  Each distinct marker of a scope is looked up once.
    """
    text = F.trim("marker")
    number, name = F.regexp_extract(text, NUMERIC_MARKER, 1), F.lower(F.regexp_extract(text, AUTHOR_YEAR_MARKER, 1))
    year = F.substring(F.regexp_extract(text, AUTHOR_YEAR_MARKER, 2), 1, 4)
    tried = F.when(number != "", F.array(number)).when(name != "", F.array(F.concat(name, year), F.concat(name, F.lit(" "), year), name))
    asked = markers.select("scope", "marker").distinct().select("scope", "marker", F.posexplode(tried).alias("turn", "key"))
    named = asked.join(reference_keys(references), ["scope", "key"]).groupBy("scope", "marker").agg(F.min_by("position", "turn").alias("position"))
    return markers.join(named, ["scope", "marker"], "left")
