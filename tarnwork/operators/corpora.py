"""Content-addressed corpora with labels by topic, units of reviews, checks of held-out results, methods of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import contained_in
from .relational import first_wins

ID_LENGTH = 16
KINDS = ["weakness", "question"]
ANCHOR_DROP = 0.10


def pooled_corpus(files: DataFrame) -> DataFrame:
    """(doc_id, topic, filename, size, sha256, topics): files (topic, filename, content) of all topics, equal contents once.

    doc_id: the first characters of the content's SHA-256; topic and filename are the first that have it; topics: all, in order: for each of
    these it is relevant.  A null content is no file; null topics are left out.
    """
    known = files.where("topic is not null and content is not null").select("topic", "filename", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    first = first_wins(known, ["sha256"], ["topic", "filename"])
    topics = known.groupBy("sha256").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    return first.join(topics, "sha256").select(F.substring("sha256", 1, ID_LENGTH).alias("doc_id"), "topic", "filename", "size", "sha256", "topics")


def review_units(reviews: DataFrame) -> DataFrame:
    """(unit_id, paper_id, reviewer, text, kind): the units of reviews (paper_id, reviewer, units array<struct<text, kind>>).

    unit_id has the unit's number in its review, blank ones counted but left out.  A kind that is neither weakness nor question is a
    question if the text has a question mark.  A null reviewer is ``anon``; null kinds are weaknesses, as they are when nothing is said.
    """
    each = reviews.select(F.col("paper_id").cast("string").alias("paper_id"), F.coalesce(F.col("reviewer"), F.lit("anon")).alias("reviewer"), F.posexplode("units").alias("at", "unit"))
    text = F.regexp_replace(F.coalesce("unit.text", F.lit("")), r"^\s+|\s+$", "")
    said = F.lower(F.trim(F.coalesce("unit.kind", F.lit("weakness"))))
    kind = F.when(said.isin(KINDS), said).when(F.contains(text, F.lit("?")), "question").otherwise("weakness")
    number = F.when(F.col("at") < 9, F.concat(F.lit("0"), (F.col("at") + 1).cast("string"))).otherwise((F.col("at") + 1).cast("string"))
    return each.select(F.concat_ws("::", "paper_id", "reviewer", number).alias("unit_id"), "paper_id", "reviewer", text.alias("text"), kind.alias("kind")).where("text <> ''")


def heldout_failures(manifest: DataFrame, results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(failure, paper_id, value): what is wrong with the results (paper_id, hallucinations, anchor) of held-out papers (paper_id).

    missing: a paper without a result; hallucinated: one with hallucinations (value: how many); anchor_drop: the mean anchor quality
    of the held-out results (value) lies more than 0.10 below the baseline's (one row: anchor).  Nulls count as 0; without results there is no drop.
    """
    ids = manifest.select("paper_id").distinct()
    held = results.join(ids, "paper_id", "left_semi")
    missing = ids.join(results.select("paper_id"), "paper_id", "left_anti").select(F.lit("missing").alias("failure"), F.col("paper_id").cast("string").alias("paper_id"), F.lit(None).cast("double").alias("value"))
    wrong = held.where("hallucinations > 0").select(F.lit("hallucinated").alias("failure"), F.col("paper_id").cast("string").alias("paper_id"), F.col("hallucinations").cast("double").alias("value"))
    mean = held.agg(F.avg(F.coalesce(F.col("anchor").cast("double"), F.lit(0.0))).alias("value")).join(baseline.select(F.col("anchor").alias("_base")))  # one row each
    drop = mean.where(F.col("value") + ANCHOR_DROP < F.col("_base")).select(F.lit("anchor_drop").alias("failure"), F.lit(None).cast("string").alias("paper_id"), "value")
    return missing.unionByName(wrong).unionByName(drop)


def methods_of_papers(papers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(paper_id, pattern_id): the first pattern (pattern_id, pattern) that a paper's approach (paper_id, approach) contains or is contained in.

    Both in lower case and trimmed; blank and null ones match nothing; papers without a pattern are left out.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    approach = papers.select("paper_id", clean(F.col("approach")).alias("approach"))
    said = approach.where("approach <> ''").groupBy("approach").agg(F.first("approach").alias("text")).select(F.xxhash64("approach").alias("said"), "text")
    known = patterns.select("pattern_id", clean(F.col("pattern")).alias("pattern")).where("pattern <> ''")
    inside = contained_in(known.select(F.col("pattern_id").alias("string_id"), F.col("pattern").alias("string")), said.select(F.col("said").alias("text_id"), "text"))
    around = contained_in(said.select(F.col("said").alias("string_id"), F.col("text").alias("string")), known.select(F.col("pattern_id").alias("text_id"), F.col("pattern").alias("text")))
    met = inside.select(F.col("text_id").alias("said"), F.col("string_id").alias("pattern_id")).unionByName(around.select(F.col("string_id").alias("said"), F.col("text_id").alias("pattern_id")))
    first = met.groupBy("said").agg(F.min("pattern_id").alias("pattern_id"))
    return approach.where("approach <> ''").withColumn("said", F.xxhash64("approach")).join(first, "said").select("paper_id", "pattern_id")
