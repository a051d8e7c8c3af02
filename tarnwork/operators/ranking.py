"""Quality of rankings against relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, n_relevant, rr, ap, recall_k, ndcg_k and ceiling_k of each query with relevant documents.

    run: (query_id, doc_id, rank from 1); qrels: (query_id, doc_id, grade > 0).  A query without results scores 0.
    Reciprocal rank and average precision are over the whole run; NDCG uses 2^grade - 1 over log2(rank + 1).
    """
    judged = qrels.where("grade > 0")
    ideal = judged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    gain, discount = 2 ** F.col("grade") - 1, F.log2(F.col("place") + 1)
    best = ideal.groupBy("query_id").agg(F.count("*").alias("n_relevant"), *[F.sum(F.when(F.col("place") <= k, gain / discount).otherwise(0.0)).alias(f"ideal_{k}") for k in ks])
    hits = run.join(judged, ["query_id", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = hits.groupBy("query_id").agg(
        F.max(1 / F.col("rank")).alias("rr"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    )

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    return best.join(found, "query_id", "left").select(
        "query_id", "n_relevant", zero("rr").alias("rr"), (zero("precisions") / F.col("n_relevant")).alias("ap"),
        *[(zero(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in ks],
        *[(zero(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in ks],
        *[(F.least(F.lit(k), F.col("n_relevant")) / F.col("n_relevant")).alias(f"ceiling_{k}") for k in ks],
    )


def failure_attribution(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, outcome) of each relevant document: hit, ranked_low (found after k) or not_found."""
    return qrels.where("grade > 0").join(run, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.when(F.col("rank") <= k, "hit").when(F.col("rank").isNotNull(), "ranked_low").otherwise("not_found").alias("outcome")
    )
