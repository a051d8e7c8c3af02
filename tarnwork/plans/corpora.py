"""Queries of pooled corpora, review units, held-out checks and methods of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import corpora
from ..sources.tables import table
from .registry import query


@query("""WITH f AS (SELECT source AS topic, doc_id AS filename, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), t AS (SELECT sha256, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM f GROUP BY sha256)
SELECT substr(sha256, 1, 16) AS doc_id, topic, filename, size, topics FROM f JOIN t USING (sha256) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY topic, filename) = 1""")
def label_corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their source's topic, equal texts pooled."""
    files = table(spark, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("filename"), F.col("text").alias("content"))
    return corpora.pooled_corpus(files).select("doc_id", "topic", "filename", "size", F.array_join("topics", ",").alias("topics"))


@query(r"""WITH r AS (SELECT conv_id, role || turn AS reviewer, string_split(text, '. ') AS l FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id, reviewer, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS text FROM r, unnest(range(1, len(l) + 1)) AS t(i))
SELECT conv_id || '::' || reviewer || '::' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS unit_id, CASE WHEN i % 3 = 0 THEN 'question' WHEN contains(text, '?') THEN 'question' ELSE 'weakness' END AS kind, sha256(text) AS text_sha256 FROM u WHERE text <> ''""")
def atomize_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of turns as units of reviews; every third says that it is a question, the others say nothing known."""
    t = table(spark, d, "conversations").where("text is not null")
    units = F.transform(F.split("text", r"\. "), lambda x, i: F.struct(x.alias("text"), F.when((i + 1) % 3 == 0, " Question").otherwise("remark").alias("kind")))
    reviews = t.select(F.col("conv_id").alias("paper_id"), F.concat("role", F.col("turn").cast("string")).alias("reviewer"), units.alias("units"))
    return corpora.review_units(reviews).select("unit_id", "kind", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 100 = 0), h AS (SELECT l.* FROM labels l WHERE doc_id IN (SELECT doc_id FROM m))
SELECT 'missing' AS failure, CAST(doc_id AS VARCHAR) AS paper_id, NULL::DOUBLE AS value FROM m WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'hallucinated', CAST(doc_id AS VARCHAR), toxic::DOUBLE FROM h WHERE toxic > 0
UNION ALL SELECT 'anchor_drop', NULL, round(a, 6) FROM (SELECT avg(quality::DOUBLE) AS a FROM h) WHERE a + 0.1 < 0.99""")
def heldout_check(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document as held out, labels as results, against a baseline of 0.99."""
    results = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), F.col("toxic").alias("hallucinations"), F.col("quality").alias("anchor"))
    manifest = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("paper_id"))
    return corpora.heldout_failures(manifest, results, spark.range(1).select(F.lit(0.99).alias("anchor"))).withColumn("value", rounded("value"))


@query("""WITH p AS (SELECT DISTINCT lower(p_type) AS name FROM part UNION SELECT DISTINCT 'very ' || lower(p_name) || ' kind' FROM part WHERE p_size = 7), s AS (SELECT p_partkey AS paper_id, lower(p_name) AS approach FROM part)
SELECT paper_id, min(name) AS pattern_id FROM s JOIN p ON contains(name, approach) OR contains(approach, name) GROUP BY paper_id""")
def methodology_map_join(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as approaches; types, and longer names, as patterns in the order of their letters."""
    part = table(spark, d, "part")
    names = part.select(F.lower("p_type").alias("pattern")).unionByName(part.where("p_size = 7").select(F.concat(F.lit("very "), F.lower("p_name"), F.lit(" kind")).alias("pattern"))).distinct()
    return corpora.methods_of_papers(part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("approach")), names.select(F.col("pattern").alias("pattern_id"), "pattern"))
