"""Sentences, sections, chunks and budgets of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\r\f\u000b]+"


def sentences(text: Column) -> Column:
    """Array of trimmed sentences: cut after . ! or ? where white space follows; blank ones go."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r\f\u000b]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\n\r\f\u000b]+|[ \t\n\r\f\u000b]+$", "")), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _SPACE), lambda w: w != ""))


def chunk_sections(sections: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """(keys, chunk_index, n_words, chunk): each section's text in chunks of whole sentences, ``size`` words at most.

    A section that fits is one chunk, as it is; blank ones have none.  A chunk that is full is closed, and the next begins
    with as many of its last sentences as fit into ``overlap`` words; a single longer sentence is a chunk by itself.
    Packing goes sentence by sentence, so it is a fold over one section's sentences.
    """
    one = F.struct(F.lit(0).cast("int").alias("n"), F.array().cast("array<struct<s:string,n:int>>").alias("open"), F.array().cast("array<array<string>>").alias("closed"))

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0), lambda t, x: t + x["n"])

    def tail(rows: Column) -> Column:
        """The longest run of last sentences within the overlap."""
        starts = F.filter(F.sequence(F.lit(1), F.size(rows) + 1), lambda i: total(F.slice(rows, i, F.size(rows) - i + 1)) <= overlap)
        return F.slice(rows, F.array_min(starts), F.size(rows) - F.array_min(starts) + 1)

    def step(state: Column, sentence: Column) -> Column:
        full = (state["n"] + sentence["n"] > size) & (F.size(state["open"]) > 0)
        kept = F.when(full, tail(state["open"])).otherwise(state["open"])
        closed = F.when(full, F.array_append(state["closed"], F.transform(state["open"], lambda x: x["s"]))).otherwise(state["closed"])
        opened = F.array_append(kept, sentence)
        return F.struct(total(opened).alias("n"), opened.alias("open"), closed.alias("closed"))

    each = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))
    folded = F.aggregate(each, one, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["closed"], F.transform(s["open"], lambda x: x["s"]))).otherwise(s["closed"]))
    whole = word_count(F.col("text")) <= size
    chunks = F.when(whole, F.array("text")).otherwise(F.transform(folded, lambda c: F.array_join(c, " ")))
    told = sections.where(F.regexp_replace(F.coalesce("text", F.lit("")), _SPACE, "") != "")
    return told.select(*keys, F.posexplode(chunks).alias("chunk_index", "chunk")).select(*keys, "chunk_index", word_count(F.col("chunk")).alias("n_words"), "chunk")


def split_evenly(text: Column, parts: int) -> Column:
    """Array of ``parts`` runs of white-space words at most, with bounds at round-half-even shares of the words; empty ones go."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    bound = lambda i: F.bround(F.size(words) * i / F.lit(float(parts))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(words, bound(i) + 1, bound(i + 1) - bound(i)))
    return F.transform(F.filter(runs, lambda r: F.size(r) > 0), lambda r: F.array_join(r, " "))


def anchor_map(docs: DataFrame) -> DataFrame:
    """(doc_id, section, paragraph, n_words, sha256): every paragraph of every section that has words, numbered from 0.

    Sections are parted by blank lines, paragraphs by line breaks.
    """
    s = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n")).alias("section", "body"))
    p = s.select("doc_id", "section", F.posexplode(F.split("body", "\n")).alias("paragraph", "line")).withColumn("n_words", word_count(F.col("line")))
    return p.where("n_words > 0").select("doc_id", "section", "paragraph", "n_words", F.sha2("line", 256).alias("sha256"))


def allotted(rows: DataFrame, group: str, order: str, length: str, budget: int, floor: int) -> DataFrame:
    """Add ``allotted``: each row's share of a group's budget: a floor (its length, if shorter), and of the rest a part by what its length exceeds the floor, cut to whole numbers."""
    every = Window.partitionBy(group)
    base = F.least(F.col(length), F.lit(floor))
    over = F.col(length) - base
    left = F.greatest(F.lit(0), F.lit(budget) - F.sum(base).over(every))
    part = F.when(F.sum(over).over(every) > 0, F.floor(left * over / F.sum(over).over(every))).otherwise(0)
    return rows.withColumn("allotted", F.least(F.col(length), base + part).cast("long"))
