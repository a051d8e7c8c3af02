"""A training corpus from raw documents: each stage's output is written as Parquet and read as the next one's input."""

from __future__ import annotations

import uuid

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import decontaminate, quality, sentencepieces, simhash, suffixes
from tarnwork.llm.common import shared_folder, tidy
from tarnwork.llm.queries import PIECE_VOCABULARY, table

#: SQL does not express fingerprints of XXH64 values nor the pieces of a vocabulary file.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of all their columns, and its name: what a stage decides on a row is found again by it.

    Rows equal in every column have the same hash; what is decided on them is the same.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])), name


def chosen(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is in ``rows`` (row), as documents."""
    return docs.join(rows.select(F.col("row").alias("_of")).distinct(), F.col(row) == F.col("_of"), "left_semi").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by itself, also those that repeat a doc_id or have none."""
    rows, row = numbered(docs)
    judged = quality.quality_rules(rows, table(spark, sf_dir, "labels"), carry=row)
    return chosen(rows, row, judged.where("kept").select(F.col("carried").alias("row")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row: that with the smallest doc_id (none counts as the largest), of these the smallest hash; of rows equal in every column one."""
    rows, row = numbered(docs)
    found = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"))
    ids = rows.groupBy(F.col(row).alias("row")).agg(F.max(F.col("doc_id").cast("long")).alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))
    least = found.join(ids, "row").groupBy("component").agg(first.alias("first"))
    return chosen(rows.dropDuplicates([row]), row, least.select(F.col("first.row").alias("row")))


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has too; n_chars follows.

    Each row is cut by its own text; rows without doc_id stay as they are, rows that repeat one do not cut each other.  A null text becomes empty.
    """
    cut = suffixes.suffix_dedup(docs, carry=[c for c in docs.columns if c != "text"])
    of = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[of.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; each row is judged by itself, also those that repeat a doc_id or have none."""
    rows, row = numbered(docs)
    judged = decontaminate.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return chosen(rows, row, judged.where("not contaminated").select(F.col("doc_id").alias("row")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row's text, with the proof that they decode to it; rows that repeat a doc_id or have none are rows like any other."""
    return sentencepieces.encode(docs, vocabulary(PIECE_VOCABULARY)).select("doc_id", "n_bytes", "n_pieces", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
