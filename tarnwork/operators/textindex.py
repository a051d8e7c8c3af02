"""Text search over a stored inverted index that prunes exactly.

The index has a row for each block of documents of similar length: for each word the documents that have it, what it adds to
their scores, and the most that it adds to any of them.  A query skips blocks whose bounds cannot reach its k-th score so
far.  The queries that look into a block are settled together: by a matrix product over the words that are frequent there and
additions for the others, or, where all words are wanted, by bit sets of the documents that have a word.  A word that all
documents have is spread over all blocks, so no word is one task's work.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.english import lexemes
from ..sources.stored import small_rows, stored
from .relational import top_k_per

BLOCK_DOCS = 512
#: Documents and letters that a task sorts by length and cuts into blocks at a time.
SORTED_DOCS, SORTED_LETTERS = 8192, 32_000_000
#: Documents with the same most frequent word that have blocks of their own, and rows of the index (blocks) that go to Python at a time.
ALIKE_DOCS, ROWS = 256, 4
#: Bytes of the index that a reader holds at a time: one of Parquet's row groups.
GROUP_BYTES = 8 << 20
#: Queries, and letters of queries, that go over the index at a time; bounds what goes to the tasks.
QUERY_BLOCK, QUERY_LETTERS = 32_768, 32_000_000
#: Queries, and words of queries, that are looked for in a block at a time; bounds a task's matrices.
LOT_QUERIES, LOT_TERMS = 2048, 1 << 20
#: A word is a column of the matrices where it saves so many additions to a product's; columns at most.
DENSE, DENSE_WORDS = 512, 4096
#: More than the relative error of a sum of DENSE_WORDS single-precision products.
NEAR = 5e-4
#: Additions, sums in double precision, and found documents that a task holds at a time.
EXPANDED, SUMMED, WAITING = 1 << 22, 4096, 1 << 16
#: What the score is scaled by: the sum of 1 / n^2, and the weight of a word.
ZETA, WEIGHT = 1.64493406685, 0.1

_WORD = re.compile("[a-z0-9]+")
_COLUMNS = ["docs", "terms", "starts", "most", "places", "weights"]
_SCHEMA = "docs binary, terms array<string>, starts binary, most binary, places binary, weights binary"


def words_of(text: str | None, english: bool) -> list[str]:
    found = _WORD.findall((text or "").lower())
    return lexemes(found) if english else found


def _block(docs: list[tuple[int, int, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Row of the index of (id, words, numbers of its words in ``names``, their counts)."""
    term, count = (np.concatenate([d[c] for d in docs]) for c in (2, 3))
    place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[2]) for d in docs])
    known, term = np.unique(term, return_inverse=True)
    sums = np.cumsum(1 / np.arange(1.0, count.max() + 1) ** 2)
    weight = sums[count - 1] / np.log2(np.array([d[1] for d in docs], float) + 1)[place]
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(known) + 1))
    most = np.maximum.reduceat(weight[order], starts[:-1])
    values = [np.array([d[0] for d in docs], np.int64), None, starts.astype(np.int64), most, place[order], weight[order]]
    return pa.RecordBatch.from_arrays([pa.array([[names[t] for t in known]], pa.list_(pa.string())) if v is None else pa.array([v.tobytes()], pa.binary()) for v in values], _COLUMNS)


def _blocks(docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Blocks of documents of similar length whose most frequent word is the same (those of one language, mostly); the first of each kind come first."""
    kinds = Counter(kind := [int(d[2][d[3].argmax()]) for d in docs])
    by: dict[int, list] = {}
    for k, d in zip(kind, docs):
        by.setdefault(k if kinds[k] >= ALIKE_DOCS else -1, []).append(d)
    cut = []
    for n, some in enumerate(by.values()):
        some.sort(key=lambda d: -d[1])  # long ones share most words with a query, so they come first
        cut += [(i, n, some[i : i + BLOCK_DOCS]) for i in range(0, len(some), BLOCK_DOCS)]
    return [c[2] for c in sorted(cut, key=lambda c: c[:2])]


def text_index(docs: DataFrame, english: bool = False) -> DataFrame:
    """The stored index of docs (doc_id, text); ``english``: stems instead of words, stopwords left out.

    Rows without doc_id are left out; null texts have no words; rows that repeat a doc_id are found each by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        number: dict[str, int] = {}
        letters = 0

        def close() -> Iterator[pa.RecordBatch]:
            names = list(number)
            for block in _blocks(held):
                yield _block(block, names)
            held.clear()
            number.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = words_of(text, english)
                if words:
                    counts = Counter(words)
                    terms = np.fromiter((number.setdefault(w, len(number)) for w in counts), np.int32, len(counts))
                    held.append((doc, len(words), terms, np.fromiter(counts.values(), np.int32, len(counts))))
                    letters += len(text)
                if len(held) >= SORTED_DOCS or letters >= SORTED_LETTERS:
                    yield from close()
                    letters = 0
        yield from close()

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    if known.rdd.getNumPartitions() < tasks:  # a file or two: deal their rows to all
        known = known.repartition(tasks)
    with small_rows(docs.sparkSession, 1024):
        return stored(known.mapInArrow(run, _SCHEMA), group_bytes=GROUP_BYTES)


class _Best:
    """The k best documents of each query so far, by score, then id."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None) -> None:
        self.k, self.bar = k, np.zeros(queries) if least is None else least.copy()
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def need(self, query: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        """What a sum of weights must reach to come in; scores are rounded, so a little under the k-th here or elsewhere."""
        bar = np.maximum(self.bar[query] - 2e-9, 0.0)
        return bar / (1 - bar) / (WEIGHT / ZETA / n_terms)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.more.append((query, score, doc))
        self.waiting += len(query)
        if self.waiting >= max(WAITING, len(self.query)):
            self.settle()

    def settle(self) -> None:
        query, score, doc = (np.concatenate(c) for c in zip((self.query, self.score, self.doc), *self.more))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.bar[query[last]] = np.maximum(self.bar[query[last]], score[last])
        self.query, self.score, self.doc = (c[rank < self.k] for c in (query, score, doc))
        self.more, self.waiting = [], 0


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n numbers, for each of the pairs in turn."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _slices(n: np.ndarray) -> list[slice]:
    """Cuts rows that become n each, in order, where they would pass EXPANDED together."""
    cut = np.flatnonzero(np.diff((np.cumsum(n) - n) // EXPANDED)) + 1
    return [slice(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(n)])] if len(n) else []


def _any(index: tuple, row: np.ndarray, term: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, sum of weights): documents of the block that reach what a query needs, and are near its k best here.

    Queries are given by their words (row, term) in the block.  Words that many of them and many documents share are columns of
    two matrices, whose product is taken in single precision; the other words are added pair by pair.  What is near the bar
    or the k-th by that sum, whose relative error is under NEAR, is summed up in double precision.
    """
    docs, starts, _, places, weights = index
    n, rows, size = len(docs), len(need), np.diff(starts)
    work = np.bincount(term, minlength=len(size)) * size
    often = np.flatnonzero(work * DENSE > rows * n)
    if len(often) > DENSE_WORDS:
        often = often[np.argpartition(-work[often], DENSE_WORDS)[:DENSE_WORDS]]
    column = np.full(len(size), -1, np.int64)
    column[often] = np.arange(len(often))
    spots = _ranges(starts[often], size[often])
    said = np.zeros((n, len(often)))
    said[places[spots], np.repeat(np.arange(len(often)), size[often])] = weights[spots]
    at = column[term]
    wants = np.zeros((rows, len(often)), np.float32)
    wants[row[at >= 0], at[at >= 0]] = 1

    row, term = row[at < 0], term[at < 0]
    rest = np.zeros(rows * n)
    for some in _slices(size[term]):
        t, many = term[some], size[term[some]]
        spots = _ranges(starts[t], many)
        rest += np.bincount(np.repeat(row[some] * n, many) + places[spots], weights[spots], rows * n)
    rest = rest.reshape(rows, n)
    total = wants @ said.astype(np.float32).T
    total += rest.astype(np.float32)

    near = (total > 0) & (total >= (need * (1 - NEAR)).astype(np.float32)[:, None])
    crowded = np.flatnonzero(near.sum(axis=1) > k)
    if len(crowded):
        cut = np.partition(total[crowded], n - k, axis=1)[:, n - k]
        near[crowded] &= total[crowded] >= (cut * np.float32(1 - NEAR))[:, None]
    i, j = np.nonzero(near)
    sums = rest[i, j]
    for s in range(0, len(i), SUMMED):
        some = slice(s, s + SUMMED)
        sums[some] += np.einsum("ij,ij->i", wants[i[some]], said[j[some]])
    return i, j, sums


def _all(index: tuple, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, sum of weights): documents of the block that have all words of a query; all its words (row, term) are in the block."""
    docs, starts, _, places, weights = index
    n, size = len(docs), np.diff(starts)
    used, word = np.unique(term, return_inverse=True)
    spots = _ranges(starts[used], size[used])
    key = np.repeat(np.arange(len(used)) * n, size[used]) + places[spots]  # ascends: places do within a word
    has = np.zeros((len(used), -(-n // 64) * 64), bool)
    has[key // n, key % n] = True
    bits = np.packbits(has, axis=1).view(np.uint64)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    common = np.bitwise_and.reduceat(bits[word], begin, axis=0)
    hit = np.flatnonzero(common.any(axis=1))
    i, j = np.nonzero(np.unpackbits(common[hit].view(np.uint8), axis=1))
    i = hit[i]
    n_terms = np.diff(begin, append=len(row))[i]
    sums = np.zeros(len(i))
    for some in _slices(n_terms):
        many = n_terms[some]
        wanted = word[_ranges(begin[i[some]], many)] * n + np.repeat(j[some], many)
        sums[some] = np.add.reduceat(weights[spots[np.searchsorted(key, wanted)]], np.cumsum(many) - many)
    return i, j, sums


def _numbered(texts: list[str | None], english: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all queries, the numbers of each query's distinct words one query after the other, and how many each has."""
    number: dict[str, int] = {}
    terms = [np.fromiter((number.setdefault(w, len(number)) for w in dict.fromkeys(words_of(t, english))), np.int32) for t in texts]
    return pa.array(list(number), pa.string()), np.concatenate([np.zeros(0, np.int32), *terms]), np.array([len(t) for t in terms], np.int64)


def _lots(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Queries that are looked for in a block together: their numbers, sizes, begins, and where their words are; one without words finds nothing."""
    asked = np.flatnonzero(sizes)
    end = np.cumsum(sizes[asked])
    lots, a = [], 0
    while a < len(asked):
        before = end[a] - sizes[asked[a]]
        b = min(a + LOT_QUERIES, max(a + 1, int(np.searchsorted(end, before + LOT_TERMS, "right"))))
        n = sizes[asked[a:b]]
        lots.append((asked[a:b], n, np.cumsum(n) - n, slice(before, end[b - 1])))
        a = b
    return lots


def _searcher(ids: np.ndarray, asked: tuple[pa.Array, np.ndarray, np.ndarray], k: int, every: bool, effort: bool = False, bars: np.ndarray | None = None, first_only: bool = False):
    words, terms, sizes = asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, lots = _Best(len(sizes), k, bars), _lots(sizes)
        scored, summed, seen = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
        for batch in batches:
            docs, named, starts, most, places, weights = (batch.column(c) for c in range(6))
            for r in range(batch.num_rows):
                index = tuple(np.frombuffer(c[r].as_buffer(), kind) for c, kind in ((docs, np.int64), (starts, np.int64), (most, np.float64), (places, np.int32), (weights, np.float64)))
                seen += len(index[0])
                if not lots:
                    continue
                number = pc.index_in(named[r].values, words).fill_null(-1).to_numpy(zero_copy_only=False)
                here = np.full(len(words), -1, np.int64)
                here[number[number >= 0]] = np.flatnonzero(number >= 0)
                bounds = np.append(index[2], 0.0)
                for query, n, begin, where in lots:
                    at = here[terms[where]]
                    # all queries are bounded at once; not all have to look into the block
                    bound, need = np.add.reduceat(bounds[at], begin), best.need(query, n)
                    look = (bound > 0) & (bound * (1 + 1e-9) >= need)
                    if every:
                        look &= np.minimum.reduceat(at, begin) >= 0
                    if not look.any():
                        continue
                    inside = np.repeat(look, n) & (at >= 0)
                    row, need = np.repeat(np.cumsum(look) - 1, n)[inside], need[look]
                    i, j, sums = _all(index, row, at[inside]) if every else _any(index, row, at[inside], need, k)
                    query, n = query[look], n[look]
                    summed[query] += len(index[0])
                    scored += np.bincount(query[i], minlength=len(scored))
                    i, j, sums = (c[sums >= need[i]] for c in (i, j, sums))
                    raw = sums * (WEIGHT / ZETA / n[i])
                    best.add(query[i], np.round(raw / (raw + 1), 9), index[0][j])
            if first_only and batch.num_rows:
                break
        if effort:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scored), pa.array(summed), pa.array([seen] * len(ids), pa.int64())], ["query_id", "scored", "summed", "documents"])
            return
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query], pa.int64()), pa.array(best.doc), pa.array(best.score)], ["query_id", "doc_id", "score"])

    return run


def _bars(index: DataFrame, asked: tuple[pa.Array, np.ndarray, np.ndarray], k: int, every: bool) -> np.ndarray:
    """The k-th best score of each query (ids in place of repeated ones count apart) over the first blocks of each task: no document under it is among the k best."""
    run = _searcher(np.arange(len(asked[2])), asked, k, every, first_only=True)
    best = top_k_per(index.mapInArrow(run, "query_id long, doc_id long, score double"), ["query_id"], [F.desc("score")], k)
    found = best.where(F.col("rank") == k).select("query_id", "score").toArrow()
    bars = np.zeros(len(asked[2]))
    bars[found["query_id"].to_numpy()] = found["score"].to_numpy()
    return bars


def _over_index(index: DataFrame, queries: DataFrame, k: int, every: bool, english: bool, effort: bool) -> DataFrame:
    known = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("letters")).first()
    blocks = max(1, -(-size["n"] // QUERY_BLOCK), -(-size["letters"] // QUERY_LETTERS))
    schema = "query_id long, scored long, summed long, documents long" if effort else "query_id long, doc_id long, score double"
    parts = []
    for b in range(blocks):
        block = (known if blocks == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        ids, asked = block.column("query_id").to_numpy(), _numbered(block.column("text").to_pylist(), english)
        with small_rows(index.sparkSession, ROWS):
            bars = _bars(index, asked, k, every)
            parts.append(stored(index.mapInArrow(_searcher(ids, asked, k, every, effort, bars), schema)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def search_index(index: DataFrame, queries: DataFrame, k: int, every: bool = False, english: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query (query_id, text), with any or with all (``every``) of its words.

    A word that occurs n times counts (1 + 1/4 + ... + 1/n^2) / 1.64493406685, a tenth of their sum is shared over the
    query's words, divided by the binary logarithm of the document's length plus one, and mapped by x / (x + 1); scores
    have nine decimals, ties go by doc_id.  A query without words, or (``english``) of stopwords only, finds nothing; queries
    without id are left out.  Each task returns its own k best of a query.
    """
    return top_k_per(_over_index(index, queries, k, every, english, False), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def search_effort(index: DataFrame, queries: DataFrame, k: int, every: bool = False, english: bool = False) -> DataFrame:
    """(query_id, scored, summed, documents): for how many of the documents a search works out a query's score to the end (in double precision).

    summed: the documents of the blocks that no bound ended, whose words are counted in single precision (``every``: in bit sets) first.
    """
    return _over_index(index, queries, k, every, english, True).groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("scored", "summed", "documents")])
