"""Query sets, content hashes, evidence gates, joins of labels and links between works."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wording import is_verbatim
from .consolidation import of_equal_length, pairs_in_groups, unit
from .relational import first_wins, latest_wins, top_k_per
from .texts import together

#: The shortest and longest claim that is a query; verdicts that need a quotation.
CLAIM_CHARS = (40, 600)
ADVERSE = ["contradicts", "overclaim", "unrelated"]


def query_set(claims: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, topic, text) of claims (topic, text) of fitting length: white space as one space, one row a query id.

    The id is 16 hex digits of the SHA-256 of topic, a zero byte and the lower-case text, so equal claims are one.
    ``most``: at most so many of a topic, by id.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f\\u000b]+", " "))
    fit = claims.select("topic", text.alias("text")).where(F.length("text").between(*CLAIM_CHARS))
    keyed = fit.withColumn("query_id", F.substring(F.sha2(F.concat(F.col("topic"), F.lit("\0"), F.lower("text")), 256), 1, 16))
    once = keyed.groupBy("query_id", "topic").agg(F.min("text").alias("text"))
    return top_k_per(once, ["topic"], [F.asc("query_id")], most).drop("rank") if most else once


def content_ids(docs: DataFrame, text: str) -> DataFrame:
    """Add content_sha256 and content_id (its first 16 hex digits); equal content has equal ids."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return docs.withColumn("content_sha256", digest).withColumn("content_id", F.substring(digest, 1, 16))


def fingerprint(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n, fingerprint): a number that depends on the rows of a key, not on their order or partitioning.

    The sum of the first 60 bits of each row's MD5; equal rows count as often as they occur.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])), 1, 15), 16, 10)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(bits.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def anchored(findings: DataFrame, drafts: DataFrame, draft: str) -> DataFrame:
    """Findings (draft, anchor, ...) whose anchor is blank or stands verbatim in their draft (draft, text); drafts without text keep all."""
    joined = findings.join(drafts.select(draft, F.col("text").alias("_text")), draft, "left")
    quoted = F.trim(F.coalesce("anchor", F.lit("")))
    keep = (quoted == "") | (F.coalesce("_text", F.lit("")) == "") | is_verbatim(F.col("anchor"), F.col("_text"))
    return joined.where(keep).drop("_text")


def sourced(verdict: Column, quotation: Column) -> Column:
    """False for adverse verdicts without a quotation."""
    return ~(F.coalesce(verdict, F.lit("")).isin(ADVERSE) & (F.trim(F.coalesce(quotation, F.lit(""))) == ""))


def labelled_exports(exports: DataFrame, labels: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exports (run, ...) with y of their latest label (1: degraded; unsure ones and those without a label go), and the labels' runs that have no export."""
    last = latest_wins(labels, ["run"], order)
    known = last.where("label <> 'unsure'").select("run", (F.col("label") == "degraded").cast("int").alias("y"))
    return exports.join(known, "run"), last.join(exports, "run", "left_anti").select("run")


def best_candidates(candidates: DataFrame, key: Column, score: str, tie: str, most: int) -> DataFrame:
    """The most relevant candidate of each key, ``most`` of them at most, the best first (a top-k report); those without a key go."""
    keyed = candidates.withColumn("_key", key).where("_key IS NOT NULL")
    best = top_k_per(keyed, ["_key"], [F.desc(score), F.asc(tie)], 1).drop("rank", "_key")
    return best.orderBy(F.desc(score), tie).limit(most)


def backfilled(primary: DataFrame, backup: DataFrame, group: str, title: str, order: str, most: int) -> DataFrame:
    """(group, title, source) with ``most`` rows of each group at most: the primary source's, then, while there are too few, the backup's with other titles."""
    every = primary.select(group, title, order).withColumn("source", F.lit(0)).unionByName(backup.select(group, title, order).withColumn("source", F.lit(1)))
    once = first_wins(every.withColumn("_t", F.lower(F.trim(title))), [group, "_t"], ["source", order])
    return top_k_per(once, [group], [F.asc("source"), F.asc(order)], most).select(group, title, "source")


def co_cited(references: DataFrame, least: int, own: DataFrame, most: int) -> DataFrame:
    """(work, cited_by): works that ``least`` of the citing works (citing, work) or more refer to, less those in ``own`` (work); the ``most`` most cited (a top-k report)."""
    counts = references.select("citing", "work").distinct().groupBy("work").agg(F.count("*").alias("cited_by")).where(F.col("cited_by") >= least)
    return counts.join(own, "work", "left_anti").orderBy(F.desc("cited_by"), "work").limit(most)


def near_in_group(left: DataFrame, right: DataFrame | None, group: str, least: float) -> DataFrame:
    """(group, left_id, right_id, similarity): pairs of a group with a cosine of ``least`` or more; sides are (group, id, vector).

    right: None if each row of left meets all others of its group; such a row is dealt once.  A group's rows meet in blocks, so no group is one
    task's work.  Null vectors and groups take part in nothing.
    """
    kind = left.schema[group].dataType.simpleString()
    side = lambda df, asked, met: df.where(f"vector is not null and {group} is not null").select(group, F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(asked).alias("asked"), F.lit(met).alias("met"))

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        for x, y in ((a, a),) if b is None else ((a, b), (b, a)):
            for one, two in of_equal_length(x[x["asked"]], y[y["met"]]):
                similar = unit(one["vector"]) @ unit(two["vector"]).T
                i, j = np.nonzero((similar >= least) & (one["id"].to_numpy()[:, None] != two["id"].to_numpy()[None]))
                out.append(pd.DataFrame({"left_id": one["id"].to_numpy()[i], "right_id": two["id"].to_numpy()[j], "similarity": similar[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})

    rows = side(left, True, True) if right is None else side(left, True, False).unionByName(side(right, False, True))
    return pairs_in_groups(rows, group, compare, f"{group} {kind}, left_id long, right_id long, similarity double")


def topic_terms(docs: DataFrame, without: list[str], most: int) -> DataFrame:
    """(doc_id, term, n, rank): the most frequent terms of each text; of equally frequent ones the first in it."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0))
    each = together(docs, "doc_id", "text").select("doc_id", F.posexplode(words).alias("place", "term")).where(~F.col("term").isin(without))
    counts = each.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "term", "n", "rank")


def titled(results: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Results (source_type, source_id, ...) with the title of their source (id, title) by type; NULL where there is none."""
    found = results
    for kind, names in sources.items():
        known = names.select(F.col("id").alias(f"_{kind}"), F.col("title").alias(f"_{kind}_title"))
        found = found.join(known, (F.col("source_type") == kind) & (F.col("source_id") == F.col(f"_{kind}")), "left")
    return found.withColumn("title", F.coalesce(*[F.col(f"_{k}_title") for k in sources])).drop(*[c for k in sources for c in (f"_{k}", f"_{k}_title")])
