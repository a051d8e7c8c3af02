"""License scans by diagonal voting.

The rolling hashes of all word k-grams of all texts are joined to the positions of the k-grams of license templates.
Each match votes for a diagonal (place in the text minus place in the template); votes are counted by diagonal, and
diagonals a few words apart (inserted or missing words) are merged into bands.  A band's places are then verified
against the words themselves: the spans are its maximal runs of equal words with no more than a few others between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import slices, stored, utf8
from .license_texts import TEMPLATES

K = 5
#: Diagonals at most so many words apart are one band; so many other words may stand between the words of a span.
DRIFT = 4
#: A span needs so many words of its template; a label, this share of the template's words in spans (licenses share sentences).
LEAST_WORDS = 10
LEAST_COVERAGE = 0.5
#: Grams in a row that goes from Python to Spark, and text in a batch.
CELL_GRAMS = 8192
BATCH_BYTES = 8_000_000
#: Templates are broadcast: their text may not be larger.
MOST_TEMPLATE_BYTES = 8_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# The base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


@cache
def _word_hashes() -> WordHashes:
    return WordHashes()


def gram_hashes(found: list[bytes], k: int = K) -> np.ndarray:
    """Signed 64-bit hash of each run of k words."""
    n = len(found) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hashes().__getitem__, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def template_grams(docs: DataFrame, templates: dict[str, str], k: int = K) -> DataFrame:
    """(gram, template, place): as many rows as the templates have words."""
    if sum(map(len, templates.values())) > MOST_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to broadcast; scan with parts of them")
    rows = [(int(g), name, i) for name, text in templates.items() for i, g in enumerate(gram_hashes(words(text.encode()), k))]
    return docs.sparkSession.createDataFrame(rows, "gram long, template string, place int")


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is a hash of both; rows equal in both are found alike."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id.isNull(), doc_id, text).alias("row"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc"), doc_id.alias("doc_id"), text.alias("text"))


def bands(rows: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """(doc, row, template, pairs array<struct<pos, place>>): matched k-grams of each band of diagonals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 2):
            which, bases, cells = [], [], []
            for i, text in enumerate(utf8(batch.column(2))):
                grams = gram_hashes(words(text), k)
                for base in range(0, len(grams), CELL_GRAMS):
                    which.append(i)
                    bases.append(base)
                    cells.append(grams[base : base + CELL_GRAMS])
            of = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(bases, pa.int32()), pa.array(cells, pa.list_(pa.int64()))], ["doc", "row", "base", "grams"])

    grams = rows.select("doc", "row", "text").mapInArrow(run, "doc long, row long, base int, grams array<bigint>").select("doc", "row", "base", F.posexplode("grams").alias("at", "gram"))
    met = grams.join(F.broadcast(template_grams(rows, templates, k)), "gram")  # size checked above
    votes = (
        met.select("doc", "row", "template", (F.col("base") + F.col("at")).alias("pos"), "place")
        .groupBy("doc", "row", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("pos").alias("at"))
    )
    order = Window.partitionBy("doc", "row", "template").orderBy("diagonal")
    pairs = F.transform("at", lambda p: F.struct(p.alias("pos"), (p - F.col("diagonal")).alias("place")))
    return (
        votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(10**9)).over(order) > DRIFT).cast("int"))
        .withColumn("band", F.sum("new").over(order))
        .groupBy("doc", "row", "template", "band").agg(F.flatten(F.collect_list(pairs)).alias("pairs")).drop("band")
    )


def verified_spans(found: list[bytes], template: list[bytes], pairs: list[tuple[int, int]], k: int = K) -> list[tuple[int, int, int, set[int]]]:
    """(first word, last word, matched words, the template's words that they are) of each span of a band."""
    at: dict[int, set[int]] = {}
    for pos, place in pairs:
        if found[pos : pos + k] == template[place : place + k]:
            for j in range(k):
                at.setdefault(pos + j, set()).add(place + j)
    spans, run = [], []
    for p in [*sorted(at), None]:
        if run and (p is None or p - run[-1] > DRIFT + 1):
            if len(run) >= LEAST_WORDS:
                spans.append((run[0], run[-1], len(run), set().union(*(at[x] for x in run))))
            run = []
        run.append(p)
    return spans


def places(found: list[bytes], first: dict[bytes, list[tuple[tuple[bytes, ...], str]]]) -> list[tuple[int, str]]:
    """(word, label) of each place where a phrase's words stand consecutively."""
    return [(i, label) for i, w in enumerate(found) if w in first for phrase, label in first[w] if tuple(found[i : i + len(phrase)]) == phrase]


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases are counted at every place; labels adds the templates with LEAST_COVERAGE of their words in verified
    spans.  score is the best such coverage, 0.5 at least where a base phrase stands.  spans: array<struct<template, start, stop, n_matched, coverage>>,
    in words from 0, both ends included.  Null texts have no words.  Each row is judged by its own text, also rows that
    repeat a doc_id or have none.
    """
    first: dict[bytes, list] = {}
    for phrase, label in PHRASES.items():
        parts = tuple(phrase.encode().split())
        first.setdefault(parts[0], []).append((parts, label))
    spelt = {name: words(text.encode()) for name, text in templates.items()}
    span = pa.struct([("template", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n_matched", pa.int64()), ("coverage", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 1):
            out = []
            for text, met in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = words(text)
                hits = places(found, first)
                base = {x for _, x in hits}
                spans = sorted((m["template"], *s) for m in met or () for s in verified_spans(found, spelt[m["template"]], [(p["pos"], p["place"]) for p in m["pairs"]], k))
                covered: dict[str, set[int]] = {}
                for s in spans:
                    covered.setdefault(s[0], set()).update(s[4])
                coverage = {name: len(c) / len(spelt[name]) for name, c in covered.items()}
                more = {name for name, c in coverage.items() if c >= LEAST_COVERAGE}
                out.append((
                    len(found), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted(base)), ",".join(sorted(base | more)),
                    max([0.5 if hits else 0.0, *coverage.values()]), [dict(zip(("template", "start", "stop", "n_matched", "coverage"), (*s[:4], len(s[4]) / len(spelt[s[0]])))) for s in spans],
                ))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["doc_id", *names])

    rows = _rows(docs)
    met = stored(bands(rows, templates, k).groupBy("doc", "row").agg(F.collect_list(F.struct("template", "pairs")).alias("met")))
    joined = rows.join(met, ["doc", "row"], "left").select("doc_id", "text", "met")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, start: bigint, stop: bigint, n_matched: bigint, coverage: double>>")
