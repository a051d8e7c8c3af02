"""Spelling variants by PartEnum signatures.

A word is a binary vector: one dimension for each letter and how often it has occurred in the word so far.  Words that
differ by one inserted, deleted or replaced letter have vectors at a Hamming distance of at most two.  The dimensions are
dealt into ``PARTS`` parts, and a word gets one signature for each way of leaving two parts out: the hash of the rest of
its vector.  Two vectors at distance two differ in at most two parts, so they share a signature, whatever they are.
Words that meet under a signature are verified by what is left of them without one letter, so a signature costs time in
proportion to its words; a pair is reported under one signature only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_and_text, stored

PARTS = 6
LEAST_LENGTH = 6
LEAST_COUNT = 5
TYPO_MODULUS = 199
FORM_FACTOR = 5
#: Letters of the words whose signatures or keys a task holds at a time (a signature's words stay together).
BLOCK_LETTERS = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = list(combinations(range(PARTS), 2))
_OUT_OF = {pair: i for i, pair in enumerate(_OUT)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of the texts, with letters deleted where the crc32 of id and run says so.

    Null texts have no words; a row without doc_id counts as one whose id is the empty string.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("([a-z\\u00C0-\\u00FF]+)"), F.lit(1)))
    runs = id_and_text(docs).where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.where(F.length("run") >= least_length).select(F.when(h % TYPO_MODULUS == 0, without).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _part(letter: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Part of the dimension (letter, occurrence)."""
    return (letter.astype(np.int64) * 7 + occurrence * 5) % PARTS


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, matrix of their letters) for each length, in blocks; letters are single bytes (Latin-1)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, BLOCK_LETTERS // length)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer("".join([words[j] for j in part.tolist()]).encode("latin-1"), np.uint8).reshape(len(part), length)


def signatures(words: list[str]) -> np.ndarray:
    """One row for each word: its signatures, in the order of ``combinations(range(PARTS), 2)``."""
    out = np.zeros((len(words), len(_OUT)), np.uint64)
    for at, letters in _matrices(words):
        sorted_ = np.sort(letters, axis=1)
        place = np.arange(letters.shape[1])
        new = np.concatenate([np.ones((len(at), 1), bool), sorted_[:, 1:] != sorted_[:, :-1]], axis=1)
        occurrence = place - np.maximum.accumulate(np.where(new, place, 0), axis=1) + 1
        value = _mixed(sorted_.astype(np.uint64) * _BASE + occurrence.astype(np.uint64))
        part = _part(sorted_, occurrence)
        sums = np.stack([np.where(part == p, value, np.uint64(0)).sum(axis=1, dtype=np.uint64) for p in range(PARTS)], axis=1)
        total = sums.sum(axis=1, dtype=np.uint64)
        for k, (p, q) in enumerate(_OUT):
            out[at, k] = (_mixed(total - sums[:, p] - sums[:, q] + np.uint64(k)) & ~np.uint64(15)) | np.uint64(k)
    return out


def near_pairs(words: list[str], signature: np.ndarray) -> np.ndarray:
    """Pairs of places in ``words`` (two columns): same signature, one letter inserted, deleted or replaced.

    ``words`` repeat no word within a signature.  A pair is left to that of its signatures that comes first.
    """
    n = len(words)
    where, spot, keys, wholes = [], [], [], np.zeros(n, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    for at, letters in _matrices(words):
        length = letters.shape[1]
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, _BASE, np.uint64)])
        sums = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[:length], axis=1, dtype=np.uint64)], axis=1)
        whole = sums[:, -1]
        rest = sums[:, :-1] + (whole[:, None] - sums[:, 1:]) * _BASE_INVERSE
        own = signature[at]
        wholes[at] = _mixed(whole * _MIX + own)
        keys.append(_mixed(rest * _MIX + own[:, None]).ravel())
        where.append(np.repeat(at, length))
        spot.append(np.tile(np.arange(length), len(at)))
    if not keys:
        return np.zeros((0, 2), np.int64)
    key, at, spot = np.concatenate(keys), np.concatenate(where), np.concatenate(spot)
    found = []
    # insertions: what is left of the longer word is the whole of the shorter one
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    lo, hi = np.searchsorted(ordered, wholes, "left"), np.searchsorted(ordered, wholes, "right")
    short = np.repeat(np.arange(n), hi - lo)
    hit = order[np.arange(len(short)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)] if len(short) else np.zeros(0, np.int64)
    long, gap = at[hit], spot[hit]
    same = [words[a] == words[b][:g] + words[b][g + 1 :] for a, b, g in zip(short.tolist(), long.tolist(), gap.tolist())]
    same = np.array(same, bool)
    short, long, gap = short[same], long[same], gap[same]
    if len(short):
        _, once = np.unique(short * n + long, return_index=True)
        short, long, gap = short[once], long[once], gap[once]
        letter = [words[b][g] for b, g in zip(long.tolist(), gap.tolist())]
        part = _part(np.array([ord(c) for c in letter]), np.array([words[b].count(c) for b, c in zip(long.tolist(), letter)]))
        found.append((short, long, part, part))
    # replacements: the same is left without the letter at the same place
    key = _mixed(key ^ (spot.astype(np.uint64) * _BASE + lengths[at].astype(np.uint64) * _MIX))
    order = np.argsort(key, kind="stable")
    key, at, spot = key[order], at[order], spot[order]
    shift = 1
    while shift < len(key):
        equal = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(equal):
            break
        a, b, gap = at[equal], at[equal + shift], spot[equal]
        same = np.array([words[x][:g] == words[y][:g] and words[x][g + 1 :] == words[y][g + 1 :] for x, y, g in zip(a.tolist(), b.tolist(), gap.tolist())], bool)
        a, b, gap = a[same], b[same], gap[same]
        if len(a):
            sides = []
            for side in (a, b):
                letter = [words[x][g] for x, g in zip(side.tolist(), gap.tolist())]
                sides.append(_part(np.array([ord(c) for c in letter]), np.array([words[x].count(c) for x, c in zip(side.tolist(), letter)])))
            found.append((a, b, *sides))
        shift += 1
    if not found:
        return np.zeros((0, 2), np.int64)
    a, b, p, q = (np.concatenate(x) for x in zip(*found))
    p, q = np.minimum(p, q), np.maximum(p, q)
    first = np.array([[_OUT_OF[tuple(sorted((x, y)))] if x != y else _OUT_OF[(0, x) if x else (0, 1)] for y in range(PARTS)] for x in range(PARTS)])
    mine = (signature[a] & np.uint64(15)).astype(np.int64) == first[p, q]
    return np.stack([a[mine], b[mine]], axis=1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many of the other words are near, and of these the one of largest n (ties: the smallest word).

    words: (word string, n long), no word twice; letters are those of Latin-1.  Words without a near one do not appear.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = signatures(batch.column(0).to_pylist())
                rows = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], ["signature", "word", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        letters = 0

        def close(part: pa.Table) -> Iterator[pa.RecordBatch]:
            words = part.column(1).to_pylist()
            pairs = near_pairs(words, part.column(0).to_numpy().view(np.uint64))
            if not len(pairs):
                return
            a, b = np.concatenate([pairs, pairs[:, ::-1]]).T
            n = part.column(2).to_numpy()
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            counts = np.diff(np.r_[at, len(a)])
            mine, best = pa.array(a[at]), pa.array(b[at])
            yield pa.RecordBatch.from_arrays(
                [part.column(1).combine_chunks().take(mine), pa.array(counts, pa.int64()), part.column(2).combine_chunks().take(best), part.column(1).combine_chunks().take(best)],
                ["word", "n_near", "best_n", "best"],
            )

        for batch in batches:  # sorted, so only the last signature of a batch can go on in the next
            if not batch.num_rows:
                continue
            held.append(batch)
            letters += batch.column(1).nbytes
            if letters >= BLOCK_LETTERS:
                every = pa.Table.from_batches(held)
                signature = every.column(0).to_numpy()
                cut = int(np.searchsorted(signature, signature[-1], "left"))
                if cut:
                    yield from close(every.slice(0, cut))
                held = every.slice(cut).to_batches()
                letters = sum(x.column(1).nbytes * x.num_rows // max(1, every.num_rows) for x in held)
        if held:
            yield from close(pa.Table.from_batches(held))

    signed = words.select("word", "n").mapInArrow(sign, "signature long, word string, n long")
    found = signed.repartition("signature").sortWithinPartitions("signature").mapInArrow(verify, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.struct(F.col("best.word").alias("word"), (-F.col("best.less")).alias("n")).alias("best"))


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the smallest word), if it occurs at least ``factor`` times as often; else null.
    root: where forms lead to; the word itself if it has none.  Empty tables and texts without words have no rows; rows
    that repeat count as often as they occur; other columns do not matter.
    """
    words = stored(word_counts(docs, least_length, least_count))
    joined = words.join(near_words(words), "word", "left")
    is_form = F.col("best.n") >= factor * F.col("n")
    known = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    dropped(words)
    # forms occur ``factor`` times as often, so chains are short; each round doubles the steps that are known
    up = stored(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = up.join(further, "root", "left")
        if step.where("next is not null").isEmpty():
            break
        old, up = up, stored(step.select("word", F.coalesce("next", "root").alias("root")))
        dropped(old)
    return known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
