"""What the corpus operators share: stored intermediate tables, text columns, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import dropped, shared_folder, stored, tidy  # noqa: F401  (the operators and the pipeline take them from here)

def rows_of(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(doc, row, doc_id, text, the carried columns as a struct): doc and row, never null, tell a row from all with another text."""
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(
        F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc"), F.xxhash64(doc_id.isNull(), doc_id, text).bitwiseAND(0xFFFFFFFF).alias("row"),
        doc_id.alias("doc_id"), text.alias("text"), rest.alias("rest"),
    )


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): whatever else the table has, under any name, does not reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most ``most_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        total, start = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        yield batch.slice(start)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: rows (node, component), component the smallest node.

    Alternating large-star and small-star steps; each step is two aggregations with map-side combine and
    two joins, whatever the size of a component.  Nodes without an edge do not appear.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (at["n"], at["h"]) == before or not at["n"]:
            break
        before = (at["n"], at["h"])
        # large star: every neighbour above u is linked to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below u are linked to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        old, now = now, stored(
            large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        dropped(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Forest:
    """Union-find over hashable items within one task; ``link`` tells whether two sets became one."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True
