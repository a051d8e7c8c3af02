"""Vector, keyword and hybrid retrieval of a stated query set over all chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import top_k_per
from .textindex import search_index, text_index

#: Queries that are scored against the chunks at a time; bounds what is broadcast.
QUERY_BLOCK = 2048
#: Chunks that are multiplied with a block of queries at a time; bounds a task's matrices.
CHUNK_SLICE = 1024

_SCORED = "query_id long, chunk_id long, similarity double"


def knn(queries: DataFrame, chunks: DataFrame, k: int, least: float | None = None, strict: bool = False) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k chunks of highest cosine for each query, ties by chunk_id.

    queries: (query_id long, vector array<float>); chunks: (chunk_id long, vector array<float>).  Queries go over in blocks of bounded
    size; each task multiplies its chunks with a block and keeps its own k best for each query, so k rows for each query and
    task are shuffled, whatever the number of chunks.  Null and empty vectors are left out; a zero vector has similarity 0; a
    query is compared with the chunks of its own length only.  No queries or no chunks: no rows.
    ``least``: chunks below (``strict``: at) this similarity do not count.
    """
    known = queries.where("size(vector) > 0").select("query_id", "vector")
    first = known.limit(QUERY_BLOCK + 1).toPandas()  # all queries, if they fit into one block
    blocks = 1 if len(first) <= QUERY_BLOCK else 1 + (known.count() - 1) // QUERY_BLOCK
    parts = []
    for b in range(blocks):
        block = first if blocks == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        for length, same in block.groupby(block["vector"].map(len)):
            matrix = _unit(np.array(same["vector"].tolist(), np.float64))
            of = chunks.where(F.size("vector") == int(length)).select("chunk_id", "vector")
            parts.append(of.mapInArrow(_scorer(same["query_id"].to_numpy(np.int64), matrix, k, least, strict), _SCORED))
    if not parts:
        return top_k_per(queries.sparkSession.createDataFrame([], _SCORED), ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return top_k_per(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True) if matrix.size else np.ones((len(matrix), 1))
    return matrix / np.where(norm > 0, norm, 1)


def _scorer(ids: np.ndarray, matrix: np.ndarray, k: int, least: float | None, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        bars = np.full(len(ids), -np.inf if least is None else least)  # what is below is not among the k best
        for whole in batches:
            for start in range(0, whole.num_rows if len(ids) else 0, CHUNK_SLICE):
                batch = whole.slice(start, CHUNK_SLICE)
                chunk = batch.column(0).to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                similarity = matrix @ _unit(flat.reshape(len(chunk), -1)).T
                near = similarity >= (bars - 1e-12)[:, None]
                for i in np.flatnonzero(near.any(axis=1)):
                    row, ok = similarity[i], np.flatnonzero(near[i])
                    if least is not None:
                        ok = ok[row[ok] > least if strict else row[ok] >= least]
                    if len(ok) > k:
                        cut = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[row[ok] >= cut - 1e-12]
                    best[i] = sorted(best[i] + list(zip((-row[ok]).tolist(), chunk[ok].tolist())))[: k + 8]
                    if len(best[i]) >= k:
                        bars[i] = max(bars[i], -best[i][k - 1][0])
        rows = [(int(q), c, -s) for q, found in zip(ids, best) for s, c in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "chunk_id", "similarity"])

    return run


def label_separation(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(same, n, mean, least, most): cosines of all query-chunk pairs by whether their labels agree, a query itself left out.

    queries: (query_id long, vector, query_label long); chunks: (chunk_id long, vector, doc_id long).  same is null where a label
    is.  Each task returns three rows at most for a block of queries, whatever the number of pairs.
    """

    def totals(ids: np.ndarray, labels: pa.Array, slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        at = {g: [0, 0.0, np.inf, -np.inf] for g in (False, True, None)}
        of, has = labels.fill_null(0).to_numpy(zero_copy_only=False), labels.is_valid().to_numpy(zero_copy_only=False)
        for chunk, label, similarity in slices:
            other = ids[:, None] != chunk
            known = has[:, None] & label.is_valid().to_numpy(zero_copy_only=False)
            equal = of[:, None] == label.fill_null(0).to_numpy(zero_copy_only=False)
            for g, mask in ((False, known & ~equal), (True, known & equal), (None, ~known)):
                s = similarity[mask & other]
                if len(s):
                    n, total, least, most = at[g]
                    at[g] = [n + len(s), total + float(s.sum()), min(least, float(s.min())), max(most, float(s.max()))]
        rows = [(g, *v) for g, v in at.items() if v[0]]
        kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["same", "n", "total", "least", "most"])

    parts = _all_pairs(queries, chunks, totals, "same boolean, n long, total double, least double, most double")
    return parts.groupBy("same").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def document_separation(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(n_same, mean_same, sd_same, n_other, mean_other, sd_other, gap): cosines pooled to documents, relevant or not.

    As ``label_separation``, but a query's score for a document (doc_id) is its best chunk's there.  Deviations are of the whole
    population.  A task returns one score for each query and document of a slice of its chunks.
    """

    def best(ids: np.ndarray, labels: pa.Array, slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for chunk, label, similarity in slices:
            valid = np.flatnonzero(label.is_valid().to_numpy(zero_copy_only=False))
            if not len(valid):
                continue
            doc = label.fill_null(0).to_numpy(zero_copy_only=False)[valid]
            order = np.argsort(doc, kind="stable")
            doc, at = doc[order], valid[order]
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            score = np.maximum.reduceat(np.where(ids[:, None] == chunk[at], -np.inf, similarity[:, at]), start, axis=1)
            q, d = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), labels.take(pa.array(q)), pa.array(doc[start][d]), pa.array(score[q, d])], ["query_id", "query_label", "doc_id", "score"])

    parts = _all_pairs(queries, chunks, best, "query_id long, query_label long, doc_id long, score double")
    pooled = parts.where("query_label is not null").groupBy("query_id", "query_label", "doc_id").agg(F.max("score").alias("score"))
    same, other = (F.when(c, F.col("score")) for c in (F.col("query_label") == F.col("doc_id"), F.col("query_label") != F.col("doc_id")))
    figures = [f(s).alias(f"{name}_{kind}") for kind, s in (("same", same), ("other", other)) for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]
    return pooled.agg(*figures).withColumn("gap", F.col("mean_same") - F.col("mean_other"))


def _all_pairs(queries: DataFrame, chunks: DataFrame, reduce, schema: str) -> DataFrame:
    """What ``reduce`` makes, in each task and for each block of queries, of (chunk ids, labels, cosines) slice by slice."""
    known = queries.where("query_id is not null AND vector is not null").select(F.col("query_id").cast("long"), F.col("query_label").cast("long"), "vector")
    of = chunks.where("chunk_id is not null AND vector is not null").select(F.col("chunk_id").cast("long"), F.col("doc_id").cast("long"), "vector")
    blocks = max(1, -(-known.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids, labels = block["query_id"].to_numpy(), pa.array(block["query_label"].to_pylist(), pa.int64())
        matrix = _unit(np.array(block["vector"].to_pylist(), np.float64).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 0))
        parts.append(of.mapInArrow(_slice_scorer(ids, labels, matrix, reduce), schema))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _slice_scorer(ids: np.ndarray, labels: pa.Array, matrix: np.ndarray, reduce):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[tuple]:
            for whole in batches:
                for start in range(0, whole.num_rows if len(ids) else 0, CHUNK_SLICE):
                    batch = whole.slice(start, CHUNK_SLICE)
                    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), matrix @ _unit(flat.reshape(batch.num_rows, -1)).T

        yield from reduce(ids, labels, slices())

    return run


def keyword_search(docs: DataFrame, terms: list[str], every: bool, k: int) -> DataFrame:
    """(doc_id, score): documents with all (``every``) or any of the terms, best first.

    The score lies between 0 and 1 and falls with the length of the text: hits / (hits + 1) / (1 + ln(1 + words / 100)).
    No terms: no rows.
    """
    if not terms:
        return docs.select("doc_id").limit(0).withColumn("score", F.lit(0.0))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    wanted = F.array(*[F.lit(t) for t in terms])
    found = (
        docs.select("doc_id", words.alias("w"))
        .withColumn("hits", F.size(F.filter("w", lambda x: F.array_contains(wanted, x))))
        .withColumn("kinds", F.size(F.array_intersect("w", wanted)))
        .where(F.col("kinds") >= (len(set(terms)) if every else 1))
    )
    score = F.col("hits") / (F.col("hits") + 1) / (1 + F.log(1 + F.size("w") / F.lit(100.0)))
    return found.select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def text_search(queries: DataFrame, docs: DataFrame, k: int, every: bool = False, english: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query text; see ``textindex.search_index``."""
    return search_index(text_index(docs, english), queries, k, every, english)


def rerank(pool: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the pool (query_id, doc_id, rank) by what a second scorer (query_id, doc_id, score) says of it.

    What it says nothing of, or null, comes after what it knows, in the pool's order; equal scores too are in the pool's order, then by doc_id.
    """
    judged = pool.select("query_id", "doc_id", F.col("rank").alias("_was")).join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    return top_k_per(judged, ["query_id"], [F.desc_nulls_last("score"), F.asc("_was"), F.asc("doc_id")], k).drop("_was")


def leg_health(legs: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(leg, queries, answered, rows): how many queries each leg of a fusion answered; a leg that answered none is ill."""
    asked = queries.select("query_id").distinct()
    parts = []
    for name, leg in legs.items():
        found = leg.groupBy("query_id").agg(F.count("*").alias("n"))
        parts.append(asked.join(found, "query_id", "left").agg(F.lit(name).alias("leg"), F.count("*").alias("queries"), F.count("n").alias("answered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def separation_gap(relevant: tuple[Column, Column], irrelevant: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Gap of the means, pooled deviation and the gap in deviations, of (mean, deviation) pairs; NULL where one is not known."""
    gap = relevant[0] - irrelevant[0]
    pooled = F.sqrt((relevant[1] * relevant[1] + irrelevant[1] * irrelevant[1]) / 2)
    return gap, pooled, F.when(pooled > 0, gap / pooled)


def weighted_fusion(legs: list[tuple[DataFrame, float]]) -> DataFrame:
    """(query_id, doc_id, score): weighted sum of the legs, each scaled to its query's best; a missing leg adds 0."""
    parts = []
    for leg, weight in legs:
        best = leg.groupBy("query_id").agg(F.max("score").alias("best"))
        parts.append(leg.join(best, "query_id").select("query_id", "doc_id", (F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0) * weight).alias("part")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def reciprocal_rank_fusion(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): sum of 1 / (k + rank) over the legs (query_id, doc_id, rank)."""
    every = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def pool_max(chunk_scores: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank): a document's score is its best chunk's; ties by doc_id."""
    pooled = chunk_scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k_per(pooled, ["query_id"], [F.desc("score"), F.asc("doc_id")], 1 << 30)


def round_robin(df: DataFrame, stratum: str, order: Column, most: int) -> DataFrame:
    """Take turns between the strata: the first of each, then the second of each, to ``most`` rows."""
    turns = top_k_per(df, [stratum], [order], most, "turn")
    return turns.orderBy("turn", stratum).limit(most)
