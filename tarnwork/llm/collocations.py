"""Phrase collocations from FM-indexes of shards.

Words of a shard (some texts of one language) are numbers, pieces end with number 0.  A forward and a backward index hold
the Burrows-Wheeler transform of that sequence; an order by ``LONGEST`` words is enough for phrases of at most that many.
All phrases of a length are intervals of both indexes at once; a step extends all of them by one word, to the left in the
forward index, to the right in the backward one, and yields each extension with its count.  Counts are summed across shards.

A first pass counts all words, and word pairs by their hashes.  A phrase is extended only by pairs whose hash counts
``LEAST_COUNT`` or more over all texts: they are known in the tasks as a bitmap of ``BITMAP_BITS`` bits, whatever the size of the
corpus.  Pairs that share a bit with a frequent one stay longer than they need to; nothing frequent is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import dropped, stored

LONGEST = 4
LEAST_COUNT = 30
SCALE = 2_000_000
KEEP_PERCENT = 80
TOP = 2000
#: Words of all languages that a task indexes at a time.
SHARD_WORDS = 1_000_000
#: Bytes of a text that are split into words at a time.
CHUNK_BYTES = 1_000_000
BITMAP_BITS = 1 << 26

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PER_BITMAP = 32768  # bits in a row of Spark's bitmap_construct_agg


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, b"\\n" for each end of a piece; b"" is nothing.  Chunks end between words."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = at + CHUNK_BYTES
        if end < len(folded):
            end = max(folded.rfind(b" ", at, end), folded.rfind(b"\n", at, end)) + 1
            if end <= at:
                after = [x for x in (folded.find(b" ", at), folded.find(b"\n", at)) if x >= 0]
                end = min(after) + 1 if after else len(folded)
        yield folded[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class Shard:
    """Words of one language: ``words``, their numbers from 1 on, and the sequence of numbers; 0 ends a piece."""

    def __init__(self, lang: str, carried: list[bytes] = ()) -> None:
        self.lang, self.number, self.carried = lang, {b"": -1, b"\n": 0}, len(carried)
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.add(carried)

    def add(self, tokens: list[bytes]) -> None:
        number = self.number
        ids = np.fromiter([number[t] if t in number else number.setdefault(t, len(number) - 1) for t in tokens], np.int32, len(tokens))
        self.parts.append(ids[ids >= 0])
        self.size += len(ids)

    def sequence(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(1, np.int32)])

    def words(self) -> list[bytes]:
        return [b"", *(w for w in self.number if w not in (b"", b"\n"))]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word in this language (of number 0 too)."""
        seed = xxh64_intdigest(self.lang.encode(), 42)
        return np.array([xxh64_intdigest(w, seed) for w in self.words()], np.uint64)


def shards(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Shard]:
    """Shards of record batches (lang, text).  A text may go on in the next shard, which then begins with its last ``overlap`` words."""
    open_: dict[str, Shard] = {}
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            text = text.as_py()
            if not text:
                continue
            shard = open_.setdefault(lang, None) or Shard(lang)
            open_[lang] = shard
            for tokens in chunks(text):
                shard.add(tokens)
                if sum(s.size for s in open_.values() if s) >= SHARD_WORDS:
                    names, tail = shard.words(), shard.sequence()[:-1]
                    tail = tail[max(0, len(tail) - overlap) :].tolist() if overlap else []
                    yield from open_.values()
                    shard = Shard(lang, [names[x] if x else b"\n" for x in tail])
                    open_ = {lang: shard}
            shard.add([b"\n"])
    yield from open_.values()


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * _STEP) ^ (second * _MIX)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Index:
    """FM-index of a sequence of numbers: its Burrows-Wheeler transform, from the order of all places by the next ``depth`` numbers."""

    def __init__(self, ids: np.ndarray, depth: int = LONGEST) -> None:
        n, rank, width = len(ids), ids.astype(np.int64), 1
        while width < depth:
            follow = np.zeros(n, np.int64)
            follow[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (rank.max() + 2) + follow, return_inverse=True)[1]
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.n, self.before = n, ids[order - 1].astype(np.int64)
        places = np.argsort(self.before, kind="stable")
        self._occurrences = self.before[places] * n + places

    def extended(self, symbols: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the intervals begin that backward steps by ``symbols`` from intervals that begin at ``low`` lead to."""
        return np.searchsorted(self._occurrences, symbols * self.n + low)

    def extensions(self, low: np.ndarray, size: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol before it, count, count of smaller symbols before it) for each symbol before each interval."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        key, count = np.unique(owner * symbols + self.before[rows], return_counts=True)
        owner, symbol = key // symbols, key % symbols
        below = np.cumsum(count) - count
        return owner, symbol, count, below - (np.cumsum(size) - size)[owner]


def phrases(ids: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns of words, counts) of the phrases of 2 to ``LONGEST`` words of a sequence all of whose pairs are frequent.

    frequent: a bitmap over the low bits of pair hashes.
    """

    def known(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bit = (pair_hash(hashes[a], hashes[b]) & np.uint64(8 * len(frequent) - 1)).astype(np.int64)
        return (a > 0) & (b > 0) & ((frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)

    pair = known(ids[:-1], ids[1:])
    used = np.r_[False, pair] | np.r_[pair, False]
    ids = np.where(used, ids, 0)
    ids = ids[(ids > 0) | np.r_[True, ids[:-1] > 0]]  # one 0 between what is left
    if not ids.any():
        return
    names, ids = np.unique(np.r_[0, ids, 0], return_inverse=True)
    hashes, symbols = hashes[names], len(names)
    forward, backward = Index(ids), Index(ids[::-1])
    size = np.bincount(ids, minlength=symbols)
    low = np.cumsum(size) - size
    words, size, left, right = [np.arange(1, symbols)], size[1:], low[1:], low[1:]
    for length in range(2, LONGEST + 1):
        to_left = length % 2 == 0
        index, low, other = (forward, left, right) if to_left else (backward, right, left)
        owner, symbol, count, below = index.extensions(low, size, symbols)
        ok = known(symbol, words[0][owner]) if to_left else known(words[-1][owner], symbol)
        owner, symbol, size, below = owner[ok], symbol[ok], count[ok], below[ok]
        if not len(owner):
            return
        stepped, inside = index.extended(symbol, low[owner]), other[owner] + below
        left, right = (stepped, inside) if to_left else (inside, stepped)
        words = [w[owner] for w in words]
        words = [symbol, *words] if to_left else [*words, symbol]
        yield [names[w] for w in words], size


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the hashes (h) modulo ``BITMAP_BITS``; made of rows of 32,768 bits, so of fixed size."""
    bit = F.col("h").bitwiseAND(BITMAP_BITS - 1) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(bit).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros((BITMAP_BITS // _PER_BITMAP, _PER_BITMAP // 8), np.uint8)
    for r in rows:
        bits[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def count_words_and_pairs(texts: DataFrame) -> DataFrame:
    """(lang, word, h, n): every word of each language, and each pair of words next to each other in a piece as h alone; texts: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, 1):
            ids, words, hashes = shard.sequence(), shard.words(), shard.hashes()
            n = np.bincount(ids[min(shard.carried, 1) :], minlength=len(words))
            at = np.flatnonzero(n[1:]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang] * len(at), pa.string()), pa.array([words[i].decode() for i in at.tolist()], pa.string()), pa.nulls(len(at), pa.int64()), pa.array(n[at], pa.int64())],
                ["lang", "word", "h", "n"],
            )
            a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
            both = (a > 0) & (b > 0)
            pair, n = np.unique(a[both] * len(words) + b[both], return_counts=True)
            h = pair_hash(hashes[pair // len(words)], hashes[pair % len(words)])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "h", "n"])

    return texts.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def count_phrases(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(lang, phrase, n): phrases of 2 to ``LONGEST`` words whose pairs are all in the bitmap ``frequent``; texts: (lang, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def rows(shard: Shard, columns: list[np.ndarray], n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in columns], " ")
        return pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(n), pa.string()), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, LONGEST - 1):
            ids, hashes = shard.sequence(), shard.hashes()
            words = pa.array(shard.words(), pa.binary()).cast(pa.string())
            for columns, n in phrases(ids, hashes, shared.value):
                yield rows(shard, columns, n, words)
            if shard.carried > 1:  # phrases within the carried words were counted by the shard before
                for columns, n in phrases(np.r_[ids[: shard.carried], 0], hashes, shared.value):
                    yield rows(shard, columns, -n, words)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least_count: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then a, then phrase.

    a: how often the phrase occurs; l, r: how often the parts of its lowest-scoring cut do; n: words of the language.  A
    phrase within a longer one that occurs at least ``KEEP_PERCENT`` percent as often is left out; the longest that matters has
    one word more, as what occurs within it occurs at least as often.  Null languages are ``und``, null texts empty; tables without
    phrases have no rows; rows that repeat count as often as they occur; other columns do not matter.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = stored(count_words_and_pairs(texts).where(F.col("word").isNotNull() | (F.col("n") >= least_count)))
    frequent = _bitmap(counted.where("word is null"))
    found = stored(count_phrases(texts, frequent).where(F.col("n") >= least_count))
    words = counted.where("word is not null")
    parts = found.unionByName(words.where(F.col("n") >= least_count).select("lang", F.col("word").alias("phrase"), "n"))
    split = found.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    size = F.size("w")
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest")
    )
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    whole = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"({whole('a')} * cast({SCALE} as decimal(10,0))) div ({whole('l')} + {whole('r')})")
    scored = (
        cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    longer = split.where(size > 2).select("lang", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"), F.col("a").alias("of"))
    most = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    inside = F.expr(f"coalesce({whole('of')} * 100 >= {whole('a')} * {KEEP_PERCENT}, false)")
    left = scored.join(most, ["lang", "phrase"], "left").where(~inside).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
