"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into blocks of documents.  For each block the index stores the positions of every word that
a benchmark item has (document-partitioned posting lists, one Parquet row for each block).  A phrase is looked up by its
rarest words first, as counted over all blocks: the posting list of the rarest, moved by the word's offset in the phrase,
is intersected with the next one's and so on, and most phrases end after one or two lists.  What is left are exact
places of the phrase.  Proximity matches need an item's rarest words within a span of words, in any order.

Benchmark items are a stated query set: they are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored, utf8

WINDOW = 13
#: Text of a block of documents, and of a block of benchmark items (the latter bounds what is broadcast).
BLOCK_BYTES = 4_000_000
ITEM_BLOCK_BYTES = 8_000_000
#: A proximity match has this many of an item's rarest words (all, if it has fewer) within so many words.
NEAR_TERMS = 4
NEAR_SPAN = 26
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_INDEX = "doc_ids array<bigint>, starts array<int>, n_words array<int>, terms array<int>, counts array<int>, positions binary"
_HITS = "doc_id bigint, n_words bigint, hit_words array<int>, items array<string>, near_items array<string>"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: bytes) -> list[bytes]:
    """Words of a text (UTF-8): A-Z lower-cased, runs of 0-9, a-z and characters from U+0080 on."""
    return _WORD.findall(text.lower())


class Numbers(dict):
    """Number of each known word; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def build_index(docs: DataFrame, numbers: dict[bytes, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The posting lists of the words in ``numbers``, one row for each block of documents.

    Positions count words over the block, with a gap of one between documents, so that nothing spans two of them.
    """
    known = docs.sparkSession.sparkContext.broadcast(numbers)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(known.value)
        for batch in slices(batches, block_bytes):
            starts, counts, ids, at = [], [], [], 0
            for text in utf8(batch.column(1)):
                found = words(text)
                ids.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                starts.append(at)
                counts.append(len(found))
                at += len(found) + 1
            term = np.full(at, -1, np.int32)
            for start, x in zip(starts, ids):
                term[start : start + len(x)] = x
            where = np.flatnonzero(term >= 0).astype(np.int32)
            order = np.argsort(term[where], kind="stable")
            kinds, sizes = np.unique(term[where], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int32())),
                    pa.array([kinds], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([where[order].astype("<i4").tobytes()], pa.binary()),
                ],
                ["doc_ids", "starts", "n_words", "terms", "counts", "positions"],
            )

    return id_and_text(docs).mapInArrow(run, _INDEX)


def phrases(items: list[tuple[str, bytes]], numbers: dict[bytes, int], window: int) -> tuple[dict[tuple, list[str]], dict[str, tuple]]:
    """The distinct windows (0: none) with the items that have them, and the distinct words of each item over all its rows, as numbers."""
    by_window, by_item = defaultdict(list), defaultdict(dict)
    for item, text in items:
        terms = tuple(numbers[w] for w in words(text))
        by_item[item].update(dict.fromkeys(terms))
        if terms and window:
            for i in range(max(1, len(terms) - window + 1)):
                by_window[terms[i : i + window]].append(item)
    return dict(by_window), {item: tuple(terms) for item, terms in by_item.items() if terms}


def search(index: DataFrame, by_window: dict[tuple, list[str]], by_item: dict[str, tuple], frequency: dict[int, int], spelt: list[bytes]) -> DataFrame:
    """One row for each document of the index: the words inside exact places, items found exactly, items only near.

    Works on one block of the index at a time, without a shuffle.
    """
    plan = [(sorted(((frequency.get(t, 0), t, k) for k, t in enumerate(ws))), len(ws), items) for ws, items in by_window.items()]
    rarest = {item: sorted((frequency[t], spelt[t], t) for t in set(ws) if t in frequency)[:NEAR_TERMS] for item, ws in by_item.items()}
    rare = {item: [t for _, _, t in found] for item, found in rarest.items() if found}
    query = index.sparkSession.sparkContext.broadcast(([p for p in plan if p[0][0][0]], rare))  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, near = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, starts, n_words, terms, counts, positions = (batch.column(k)[row] for k in range(6))
                ids, starts, n_words = ids.as_py(), np.array(starts.as_py(), np.int64), np.array(n_words.as_py(), np.int64)
                ends = np.cumsum(np.array(counts.as_py(), np.int64))
                where = np.frombuffer(positions.as_py(), "<i4")
                lists = {t: where[b - n : b] for t, b, n in zip(terms.as_py(), ends.tolist(), counts.as_py())}
                yield _search_block(ids, starts, n_words, lists, windows, near)

    return index.mapInArrow(run, _HITS)


def _near(starts: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Documents with a window of NEAR_SPAN words that has every term; places: the posting list of each, the rarest first."""
    anchor = places[0].astype(np.int64)
    ranges = []
    for p in places:
        a, b = np.searchsorted(p, anchor - NEAR_SPAN, "right"), np.searchsorted(p, anchor + NEAR_SPAN, "left")
        ok = a < b
        anchor, ranges = anchor[ok], [(x[ok], y[ok]) for x, y in [*ranges, (a, b)]]
        if not len(anchor):
            return anchor
    # the merged lists around the rarest term's places: a window ends at one of them, and each term's last place before is best
    merged = []
    for p, (a, b) in zip(places, ranges):
        n = b - a
        merged.append(p[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
    last = np.unique(np.concatenate(merged)).astype(np.int64)
    first = last
    for p in places:
        at = np.searchsorted(p, last, "right") - 1
        last, first, at = last[at >= 0], first[at >= 0], at[at >= 0]
        first = np.minimum(first, p[at])
    first, last = (x[last - first < NEAR_SPAN] for x in (first, last))
    of = np.searchsorted(starts, first, "right")
    return of[of == np.searchsorted(starts, last, "right")] - 1


def _search_block(ids, starts, n_words, lists, windows, near) -> pa.RecordBatch:
    total = int(starts[-1] + n_words[-1] + 1) if len(starts) else 0
    hit = np.zeros(total + 1, np.int32)
    exact, close = defaultdict(set), defaultdict(set)
    for terms, length, items in windows:
        found = lists.get(terms[0][1])
        if found is None:
            continue
        found = found - terms[0][2]
        for _, t, k in terms[1:]:
            other = lists.get(t)
            if other is None:
                found = found[:0]
                break
            at = np.searchsorted(other, found + k)
            found = found[other[np.minimum(at, len(other) - 1)] == found + k]
            if not len(found):
                break
        if len(found):
            np.add.at(hit, found, 1)
            np.add.at(hit, found + length, -1)
            for d in np.unique(np.searchsorted(starts, found, "right") - 1).tolist():
                exact[d].update(items)
    for item, terms in near.items():
        if all(t in lists for t in terms):
            for d in np.unique(_near(starts, [lists[t] for t in terms])).tolist():
                close[d].add(item)
    inside = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    of = np.searchsorted(starts, inside, "right") - 1
    first = np.searchsorted(of, np.arange(len(ids) + 1))
    hit_words = [inside[a:b] - starts[d] if b > a else [] for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hit_words, pa.list_(pa.int32())),
            pa.array([sorted(exact[d]) if d in exact else [] for d in range(len(ids))], pa.list_(pa.string())),
            pa.array([sorted(close[d] - exact[d]) if d in close else [] for d in range(len(ids))], pa.list_(pa.string())),
        ],
        ["doc_id", "n_words", "hit_words", "items", "near_items"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items, near_items, items_sha256, contaminated.

    A document word is hit inside any place where a window of ``window`` words of an item occurs (items of fewer
    words are one window; items without words have none).  contaminated: hits are a twentieth of the words or more.
    Null texts have no words.  near_items: items not found exactly whose NEAR_TERMS rarest words (of those that any
    document has; of equally rare ones the first by bytes) all lie within NEAR_SPAN words of the document, in any order.
    Nothing depends on doc_id: each row is judged by its own text, also rows that repeat an id or have none.  Rows that repeat an
    item_id are one item with the windows and words of all of them, in whatever order; a null item_id is the item "".
    """
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    queries = items.select(item_id, F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // item_block_bytes
    if blocks == 1:
        return _judged(_hits(docs, queries, window, block_bytes))
    # several blocks of items: each finds its own hit words of a row; a word that two blocks cover counts once
    keyed = stored(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()))
    by_row = keyed.select(F.col("row").alias("doc_id"), "text")
    parts = [_hits(by_row, queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), window, block_bytes, near=False) for b in range(blocks)]
    # what is near depends on all rows of an item: its distinct words go by themselves
    said = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    spoken = stored(queries.select("item_id", said.alias("text")).distinct())
    near_blocks = 1 + (spoken.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // item_block_bytes
    parts += [_hits(by_row, spoken.where(F.pmod(F.xxhash64("item_id"), F.lit(near_blocks)) == b), 0, block_bytes) for b in range(near_blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    united = found.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items", "near_items")],
    )
    united = united.withColumn("near_items", F.array_except("near_items", "items"))
    return _judged(keyed.select("row", "doc_id").join(united, "row").drop("row"))


def _hits(docs: DataFrame, queries: DataFrame, window: int, block_bytes: int, near: bool = True) -> DataFrame:
    block = [(r["item_id"], r["text"].encode()) for r in queries.collect()]  # distinct rows: at most item_block_bytes and a text
    numbers: dict[bytes, int] = {}
    for _, text in block:
        for w in words(text):
            numbers.setdefault(w, len(numbers))
    index = stored(build_index(docs, numbers, block_bytes))
    pairs = F.explode(F.arrays_zip("terms", "counts")).alias("p")
    frequency = {r["t"]: r["n"] for r in index.select(pairs).groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.counts").alias("n")).collect()}
    by_window, by_item = phrases(block, numbers, window)
    return search(index, by_window, by_item if near else {}, frequency, list(numbers))


def _judged(hits: DataFrame) -> DataFrame:
    hits = hits.withColumn("n_hit", F.size("hit_words").cast("long"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "near_items",
    )
