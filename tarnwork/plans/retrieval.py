"""Retrieval and ranking quality over ``embeddings`` (vec_id: chunk, label: document) and ``documents``.

Queries are the vectors whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine, rounded
from ..operators import ranking, retrieval
from ..operators.relational import top_k_per
from ..sources.tables import table
from .registry import query

TERMS = ["that", "with", "from"]
_PAIRS = """
pairs AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS chunk_id, c.label AS doc_id,
  list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"""
_TOP = _PAIRS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs),
top AS (SELECT * FROM ranked WHERE rank <= 50)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("doc_id"))
    return chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.col("doc_id").alias("query_label")), chunks


def _top(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    q, c = _vectors(spark, d)
    found = retrieval.knn(q, c, k)
    return found.join(c.select("chunk_id", "doc_id"), "chunk_id").join(q.select("query_id", "query_label"), "query_id")


@query(f"WITH {_TOP} SELECT query_id, chunk_id, round(s, 6) AS similarity, rank FROM top WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(*_vectors(spark, d), 10).select("query_id", "chunk_id", rounded("similarity").alias("similarity"), "rank")


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs WHERE doc_id < 5) SELECT query_id, chunk_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return retrieval.knn(q, c.where("doc_id < 5"), 10).select("query_id", "chunk_id", rounded("similarity").alias("similarity"), "rank")


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id < 5 ORDER BY s DESC, chunk_id) AS rank FROM pairs WHERE s > 0.1)
SELECT query_id, chunk_id, CASE WHEN doc_id < 5 THEN 'documents' ELSE 'drafts' END AS source, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def knn_threshold_union(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    legs = [retrieval.knn(q, c.where(f), 5, least=0.1, strict=True).withColumn("source", F.lit(s)) for f, s in (("doc_id < 5", "documents"), ("doc_id >= 5", "drafts"))]
    return legs[0].unionByName(legs[1]).select("query_id", "chunk_id", "source", rounded("similarity").alias("similarity"))


@query(f"WITH {_TOP} SELECT query_id, chunk_id, round(s, 3) AS similarity FROM top WHERE rank <= 20 AND round(s, 3) >= 0.2 AND doc_id <> query_label")
def knn_rounded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Over-fetch first, filter afterwards: fewer rows than asked for may be left."""
    found = _top(spark, d, 20).withColumn("similarity", F.round("similarity", 3))
    return found.where("similarity >= 0.2 AND doc_id <> query_label").select("query_id", "chunk_id", "similarity")


@query(f"""WITH {_TOP}, pooled AS (SELECT query_id, doc_id, max(s) AS score FROM top GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pooled""")
def pool_max(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pool_max(_top(spark, d).withColumn("score", F.col("similarity"))).select("query_id", "doc_id", rounded("score").alias("score"), "rank")


_RUN = f"""{_TOP}, run AS (SELECT query_id, chunk_id AS doc_id, rank FROM top),
qrels AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, 1 AS grade FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"""


def _run_and_qrels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q, c = _vectors(spark, d)
    run = retrieval.knn(q, c, 50).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    qrels = q.select("query_id", "query_label").join(c.select(F.col("chunk_id"), F.col("doc_id").alias("query_label")), "query_label").where("query_id <> chunk_id").select("query_id", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("grade"))
    return run, qrels


@query(f"""WITH {_RUN}, n AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id),
hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM run JOIN qrels USING (query_id, doc_id)),
ideal AS (SELECT query_id, n_relevant, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_relevant) AS best FROM n),
h AS (SELECT query_id, max(1 / rank) AS rr, sum(nth / rank) AS p, count(*) FILTER (rank <= 10) AS h10, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY query_id)
SELECT query_id, n_relevant, round(coalesce(rr, 0), 6) AS rr, round(coalesce(p, 0) / n_relevant, 6) AS ap, round(coalesce(h10, 0) / n_relevant, 6) AS recall_10,
  round(coalesce(dcg, 0) / best, 6) AS ndcg_10, round(least(10, n_relevant) / n_relevant, 6) AS ceiling_10 FROM ideal LEFT JOIN h USING (query_id)""")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = ranking.per_query(*_run_and_qrels(spark, d), [10])
    return m.select("query_id", "n_relevant", *[rounded(c).alias(c) for c in ("rr", "ap", "recall_10", "ndcg_10", "ceiling_10")])


@query(f"""WITH {_RUN} SELECT CASE WHEN rank <= 10 THEN 'hit' WHEN rank IS NOT NULL THEN 'ranked_low' ELSE 'not_found' END AS outcome, count(*) AS n
FROM qrels LEFT JOIN run USING (query_id, doc_id) GROUP BY 1""")
def failure_attribution(spark: SparkSession, d: str) -> DataFrame:
    return ranking.failure_attribution(*_run_and_qrels(spark, d), 10).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {_RUN}, n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id), f AS (SELECT query_id, count(*) AS f FROM run JOIN qrels USING (query_id, doc_id) GROUP BY query_id)
SELECT query_id, round(least(10, coalesce(f, 0)) / n, 6) AS oracle_10, round(coalesce(f, 0) / n, 6) AS reachable FROM n LEFT JOIN f USING (query_id)""")
def pool_oracle(spark: SparkSession, d: str) -> DataFrame:
    """What a perfect reranker of the 50 found chunks would reach."""
    run, qrels = _run_and_qrels(spark, d)
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    f = run.join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("f"))
    got = F.coalesce("f", F.lit(0))
    return n.join(f, "query_id", "left").select("query_id", rounded(F.least(F.lit(10), got) / F.col("n")).alias("oracle_10"), rounded(got / F.col("n")).alias("reachable"))


@query(f"""WITH {_PAIRS} SELECT query_label = doc_id AS same, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most FROM pairs WHERE query_id <> chunk_id GROUP BY 1""")
def separation(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of the queries to chunks with their label and to others."""
    return retrieval.label_separation(*_vectors(spark, d)).select("same", "n", *[rounded(c).alias(c) for c in ("mean", "least", "most")])


@query(f"""WITH {_PAIRS}, pooled AS (SELECT query_id, query_label, doc_id, max(s) AS score FROM pairs WHERE query_id <> chunk_id GROUP BY ALL),
k AS (SELECT CASE WHEN query_label = doc_id THEN score END AS a, CASE WHEN query_label <> doc_id THEN score END AS b FROM pooled)
SELECT count(a) AS n_same, round(avg(a), 6) AS mean_same, round(stddev_pop(a), 6) AS sd_same, count(b) AS n_other, round(avg(b), 6) AS mean_other, round(stddev_pop(b), 6) AS sd_other, round(avg(a) - avg(b), 6) AS gap FROM k""")
def separation_pooled(spark: SparkSession, d: str) -> DataFrame:
    """The same after pooling to documents, with the deviations and the gap of the means."""
    found = retrieval.document_separation(*_vectors(spark, d))
    return found.select("n_same", "n_other", *[rounded(c).alias(c) for c in ("mean_same", "sd_same", "mean_other", "sd_other", "gap")])


def _keyword_sql(kinds: int) -> str:
    wanted = "['" + "', '".join(TERMS) + "']"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({wanted}, x))) AS hits, len(list_distinct(list_filter(w, lambda x: list_contains({wanted}, x)))) AS kinds FROM w),
s AS (SELECT doc_id, round(hits / (hits + 1) / (1 + ln(1 + n / 100.0)), 9) AS score FROM h WHERE kinds >= {kinds})
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20"""


@query(_keyword_sql(len(TERMS)))
def keyword_and(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, d, "documents"), TERMS, True, 20)


@query(_keyword_sql(1))
def keyword_or(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, d, "documents"), TERMS, False, 20)


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def keyword_empty(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, d, "documents"), [], False, 20)


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _search_sql(queries: str, k: int, every: bool = False) -> str:
    return f"""asked AS ({queries}), wanted AS (SELECT query_id, list_distinct({_WORDS}) AS w FROM asked), terms AS (SELECT query_id, len(w) AS n_terms, unnest(w) AS word FROM wanted),
split AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), sized AS MATERIALIZED (SELECT doc_id, len(w) AS n_words FROM split), spoken AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM split),
said AS (SELECT doc_id, n_words, word FROM spoken JOIN sized USING (doc_id)), counts AS (SELECT doc_id, n_words, word, count(*) AS n FROM said GROUP BY ALL),
sums AS (SELECT query_id, doc_id, n_words, n_terms, sum(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j)))) AS s, count(*) AS kinds FROM counts JOIN terms USING (word) GROUP BY ALL),
met AS (SELECT *, s * 0.1 / 1.64493406685 / n_terms / log2(n_words + 1) AS raw FROM sums),
scored AS (SELECT query_id, doc_id, round(raw / (raw + 1), 9) AS score FROM met{' WHERE kinds = n_terms' if every else ''}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_search_sql(_ITEMS, 20)} SELECT query_id, doc_id, score FROM ranked WHERE rank <= 20")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries against all documents, any word."""
    return retrieval.text_search(_items(spark, d), table(spark, d, "documents"), 20).select("query_id", "doc_id", "score")


@query(f"WITH {_search_sql('SELECT doc_id AS query_id, text FROM documents WHERE length(text) <= 60', 20, True)} SELECT query_id, doc_id, score FROM ranked WHERE rank <= 20")
def keyword_variant_switch(spark: SparkSession, d: str) -> DataFrame:
    """The same with all words wanted; the short documents as queries."""
    docs = table(spark, d, "documents")
    asked = docs.where("length(text) <= 60").select(F.col("doc_id").alias("query_id"), "text")
    return retrieval.text_search(asked, docs, 20, every=True).select("query_id", "doc_id", "score")


def _legs(spark: SparkSession, d: str) -> list[DataFrame]:
    """Every hundredth document as a query: the neighbours of its vector, and the documents that share its words."""
    q, c = _vectors(spark, d)
    dense = retrieval.knn(q, c, 30).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("similarity").alias("score"), "rank")
    docs = table(spark, d, "documents")
    keyword = retrieval.text_search(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), docs, 30)
    return [dense, keyword]


_LEGS = f"""{_search_sql('SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0', 30)},
d AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
b AS (SELECT query_id, 0 AS leg, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d UNION ALL SELECT query_id, 1, doc_id, score, rank FROM ranked),
l AS (SELECT *, max(score) OVER (PARTITION BY query_id, leg) AS best FROM b)"""


@query(f"WITH {_LEGS} SELECT CASE leg WHEN 0 THEN 'dense' ELSE 'keyword' END AS leg, (SELECT count(*) FROM documents WHERE doc_id % 100 = 0) AS queries, count(DISTINCT query_id) AS answered, count(*) AS rows FROM l WHERE rank <= 30 AND query_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def hybrid_leg_health(spark: SparkSession, d: str) -> DataFrame:
    dense, keyword = _legs(spark, d)
    asked = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"))
    return retrieval.leg_health({"dense": dense.join(asked, "query_id", "left_semi"), "keyword": keyword}, asked)


@query(f"WITH {_LEGS} SELECT query_id, doc_id, round(sum(CASE WHEN best > 0 THEN score / best ELSE 0 END * CASE leg WHEN 0 THEN 0.7 ELSE 0.3 END), 6) AS score FROM l WHERE rank <= 30 GROUP BY query_id, doc_id")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    a, b = _legs(spark, d)
    return retrieval.weighted_fusion([(a, 0.7), (b, 0.3)]).select("query_id", "doc_id", rounded("score").alias("score"))


@query(f"WITH {_LEGS} SELECT query_id, doc_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM l WHERE rank <= 30 GROUP BY query_id, doc_id")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_legs(spark, d)).select("query_id", "doc_id", rounded("score").alias("score"))


@query()
def keyword_english(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries by their stems, stopwords left out (SQL has no stemmer; tested against a plain loop)."""
    return retrieval.text_search(_items(spark, d), table(spark, d, "documents"), 20, english=True).select("query_id", "doc_id", "score")


@query(f"""WITH {_LEGS}, pool AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / (60.0 + rank)), 9) DESC, doc_id) AS rank FROM l WHERE rank <= 30 GROUP BY query_id, doc_id),
judged AS (SELECT p.query_id, p.doc_id, p.rank, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM pool p LEFT JOIN embeddings q ON q.vec_id = p.query_id LEFT JOIN embeddings c ON c.vec_id = p.doc_id WHERE p.rank <= 20),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, rank, doc_id) AS rank FROM judged) SELECT * FROM r WHERE rank <= 10""")
def hybrid_then_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Twenty of the fused legs by a second scorer, the exact cosine; what it does not know comes last."""
    fused = retrieval.reciprocal_rank_fusion(_legs(spark, d)).withColumn("score", F.round("score", 9))
    pool = top_k_per(fused, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pair = pool.join(e.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("c")), "doc_id")
    return retrieval.rerank(pool, pair.select("query_id", "doc_id", rounded(cosine(F.col("q"), F.col("c"))).alias("score")), 10)


@query("WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT source, doc_id, turn FROM t ORDER BY turn, source LIMIT 100")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", F.asc("doc_id"), 100)


@query(f"""WITH {_RUN}, n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id), f AS (SELECT query_id, count(*) AS f FROM run JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id)
SELECT label AS slice, count(*) AS n_queries, round(avg(coalesce(f, 0) / n), 6) AS recall_10 FROM n JOIN embeddings ON vec_id = query_id LEFT JOIN f USING (query_id) GROUP BY label""")
def metrics_by_slice(spark: SparkSession, d: str) -> DataFrame:
    m = ranking.per_query(*_run_and_qrels(spark, d), [10])
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("slice"))
    return m.join(labels, "query_id").groupBy("slice").agg(F.count("*").alias("n_queries"), rounded(F.avg("recall_10")).alias("recall_10"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality of nearest-neighbour retrieval, pooled to documents, with its ceiling."""
    m = ranking.per_query(*_run_and_qrels(spark, d), [1, 5, 10])
    return m.agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in ("rr", "ap", "recall_1", "recall_5", "recall_10", "ndcg_10", "ceiling_10")])
