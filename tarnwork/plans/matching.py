"""Queries of query sets, content hashes, evidence gates and links between works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded, word_set
from ..operators import matching as M
from ..operators import retrieval, texts
from ..operators.relational import top_k_per
from ..sources.tables import table
from .decisions import _STOP, STOPWORDS
from .registry import query
from .retrieval import _vectors

_WS = "[ \\t\\n\\r\\f\\x0B]+"


@query(f"""WITH c AS (SELECT role AS topic, trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS text FROM conversations), k AS (SELECT DISTINCT substr(sha256(topic || chr(0) || lower(text)), 1, 16) AS query_id, topic, lower(text) AS t FROM c WHERE length(text) BETWEEN 40 AND 600)
SELECT query_id, topic, length(t) AS n FROM k QUALIFY row_number() OVER (PARTITION BY topic ORDER BY query_id) <= 50""")
def query_set_build(spark: SparkSession, d: str) -> DataFrame:
    """Turns as claims, their roles as topics; fifty of each topic."""
    q = M.query_set(table(spark, d, "conversations").select(F.col("role").alias("topic"), "text"), 50)
    return q.select("query_id", "topic", F.length("text").alias("n"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT substr(h, 1, 16) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY h""")
def content_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.content_ids(table(spark, d, "documents"), "text").groupBy("content_sha256", "content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("content_sha256")


@query("""SELECT source, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(doc_id || '|' || coalesce(lang, '') || '|' || n_chars), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM documents GROUP BY source""")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return M.fingerprint(table(spark, d, "documents"), ["source"], ["doc_id", "lang", "n_chars"])


@query("""SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(doc_id || '|' || quality || '|' || toxic), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM labels""")
def label_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return M.fingerprint(table(spark, d, "labels"), [], ["doc_id", "quality", "toxic"])


@query(f"""WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN upper(text) || ' more of it' ELSE NULL END AS anchor FROM conversations), w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, turn, regexp_replace(coalesce(anchor, ''), '^{_WS}|{_WS}$', '', 'g') AS q, text FROM f JOIN w USING (conv_id))
SELECT conv_id, turn FROM q WHERE q = '' OR coalesce(text, '') = '' OR (len(regexp_split_to_array(q, '{_WS}')) < 3 AND length(q) < 24) OR contains(text, q) OR contains(regexp_replace(text, '{_WS}', ' ', 'g'), regexp_replace(q, '{_WS}', ' ', 'g'))""")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns joined are the draft; each turn's anchor is its text, a wording that is not there, or nothing."""
    c = table(spark, d, "conversations")
    anchor = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.upper("text"), F.lit(" more of it")))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return M.anchored(c.select("conv_id", "turn", anchor.alias("anchor")), whole, "conv_id").select("conv_id", "turn")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'view' THEN 'overclaim' ELSE 'supports' END AS verdict FROM events WHERE NOT (event_type IN ('error', 'view') AND user_id % 3 = 0)""")
def unsourced_verdict_filter(spark: SparkSession, d: str) -> DataFrame:
    """Errors and views as adverse verdicts; every third user gives no quotation."""
    verdict = F.when(F.col("event_type") == "error", "contradicts").when(F.col("event_type") == "view", "overclaim").otherwise("supports")
    rows = table(spark, d, "events").select("event_id", verdict.alias("verdict"), F.when(F.col("user_id") % 3 == 0, F.lit("  ")).otherwise(F.col("props")).alias("quotation"))
    return rows.where(M.sourced(F.col("verdict"), F.col("quotation"))).select("event_id", "verdict")


_LABELLED = """e AS (SELECT c_custkey AS run, c_acctbal FROM customer WHERE c_custkey % 4 > 0), l AS (SELECT o_custkey AS run, arg_max(CASE o_orderstatus WHEN 'F' THEN 'degraded' WHEN 'P' THEN 'unsure' ELSE 'ok' END, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY o_custkey)"""


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    exports = table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("run"), "c_acctbal")
    label = F.when(F.col("o_orderstatus") == "F", "degraded").when(F.col("o_orderstatus") == "P", "unsure").otherwise("ok")
    return M.labelled_exports(exports, table(spark, d, "orders").select(F.col("o_custkey").alias("run"), label.alias("label"), "o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])


@query(f"WITH {_LABELLED} SELECT run, c_acctbal, CAST(label = 'degraded' AS INT) AS y FROM e JOIN l USING (run) WHERE label <> 'unsure'")
def label_export_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers as exported runs, their orders as labels, of which the latest counts."""
    return _labelled(spark, d)[0]


@query(f"WITH {_LABELLED} SELECT run FROM l WHERE run NOT IN (SELECT run FROM e)")
def labels_without_export(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)[1]


@query("""WITH c AS (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN 'doi:10.1000/' || (p_partkey % 500) WHEN p_partkey % 3 = 1 THEN 'arxiv:' || p_size || '.' || (p_partkey % 300) ELSE 'title:' || lower(trim(p_name)) END AS key FROM part),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_retailprice DESC, p_partkey) = 1) SELECT p_partkey, p_retailprice FROM b ORDER BY p_retailprice DESC, p_partkey LIMIT 25""")
def dedupe_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates by price: the best of each key, the 25 best of these."""
    n = F.col("p_partkey")
    key = texts.paper_key(F.when(n % 3 == 0, F.concat(F.lit("10.1000/"), n % 500)), F.when(n % 3 == 1, F.concat_ws(".", "p_size", n % 300)), F.col("p_name"))
    return M.best_candidates(table(spark, d, "part"), key, "p_retailprice", "p_partkey", 25).select("p_partkey", "p_retailprice")


@query("""WITH e AS (SELECT p_brand AS gap, lower(trim(p_name)) AS t, p_name AS title, p_partkey AS id, CASE WHEN p_type = 'STANDARD' THEN 0 ELSE 1 END AS source FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY gap, t ORDER BY source, id) AS k FROM e)
SELECT gap, title, source FROM o WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY gap ORDER BY source, id) <= 3""")
def external_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Brands as gaps: parts of the standard type first, others fill up to three, no title twice."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("gap"), F.col("p_name").alias("title"), F.col("p_partkey").alias("id"), "p_type")
    return M.backfilled(p.where("p_type = 'STANDARD'"), p.where("p_type <> 'STANDARD'"), "gap", "title", "id", 3)


@query("""WITH r AS (SELECT DISTINCT o_custkey AS citing, l_partkey AS work FROM orders JOIN lineitem ON l_orderkey = o_orderkey), c AS (SELECT work, count(*) AS cited_by FROM r GROUP BY work HAVING count(*) >= 2)
SELECT work, cited_by FROM c WHERE work NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) ORDER BY cited_by DESC, work LIMIT 12""")
def co_citation(spark: SparkSession, d: str) -> DataFrame:
    """Customers cite the parts that they order; large parts are in the bibliography already."""
    refs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("citing"), F.col("l_partkey").alias("work"))
    return M.co_cited(refs, 2, table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("work")), 12)


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b USING (label) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.3""")
def within_group_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Findings and review units of the same label: every vector is both."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.near_in_group(e, None, "label", 0.3).withColumn("similarity", rounded("similarity"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 20) SELECT query_id, chunk_id, round(s, 6) AS similarity FROM t WHERE label < 4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 5""")
def claim_project_semi(spark: SparkSession, d: str) -> DataFrame:
    """Twenty neighbours over all projects first, then those of the project (labels below 4), five at most: fewer may be left."""
    q, c = _vectors(spark, d)
    near = retrieval.knn(q, c, 20).drop("rank").join(c.where("doc_id < 4").select("chunk_id"), "chunk_id", "left_semi")
    return top_k_per(near, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], 5).select("query_id", "chunk_id", rounded("similarity").alias("similarity"))


_NO = ["the", "and", "for", "with", "from", "into", "using", "study", "paper"]


@query(f"""WITH t AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(f"'{w}'" for w in _NO)})))) AS w FROM part),
c AS MATERIALIZED (SELECT w, min(id) AS class_id, bool_or(id % 100 = 0) AS asked FROM t WHERE len(w) > 0 GROUP BY w)
SELECT 'link' AS kind, a.class_id AS left_id, b.class_id AS right_id, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS similarity FROM c a, c b WHERE a.asked AND a.class_id <> b.class_id AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.72
UNION ALL SELECT 'member', class_id, id, 1.0 FROM t JOIN c USING (w)""")
def title_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every hundredth part against all: links of word sets, and the parts of each set."""
    words = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.filter(word_set(F.col("p_name")), lambda w: ~w.isin(_NO)).alias("words"))
    return texts.set_classes(words, F.col("id") % 100 == 0, 0.72, "largest").withColumn("similarity", rounded("similarity"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9-]{{3,}}') AS l FROM documents), e AS (SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS n, min(place) AS first FROM e WHERE term NOT IN {_STOP} GROUP BY ALL)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 25""")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return M.topic_terms(table(spark, d, "documents"), STOPWORDS, 25)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 THEN n_name END AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 40""")
def enrich_results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results of two kinds of sources, and of one that has no titles."""
    turn = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select("o_orderkey", F.when(turn == 0, "document").when(turn == 1, "draft").otherwise("other").alias("source_type"), F.when(turn == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") % 40).alias("source_id"))
    names = {"document": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), "draft": table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))}
    return M.titled(rows, names).select("o_orderkey", "title")
