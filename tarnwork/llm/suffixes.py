"""Suffix-array dedup: bytes inside a 50-byte string that a document with a smaller id has too.

Three steps find the places where equal strings of ``length`` bytes start, without sorting all suffixes at once.

1. Each string of ``length`` bytes has a least hash among its k-grams.  Runs of neighbouring strings with the same least
   hash are segments; equal strings lie in segments of the same least hash.  Segments are dealt by that hash, as packed
   numbers: a batch of documents sends a segment it has several times once, for its smallest document.
2. Where equal segments meet, all but the smallest document's are covered at once.  Where different segments meet, some
   of their strings may still be equal: only these few send their bytes.
3. The suffixes that start in those bytes are put in order deep and shallow: multikey quicksort by the first bytes,
   then blind tries for the groups whose common prefix is longer.  Neighbours with a common prefix of ``length``
   bytes are the equal strings.  A least hash with more segments than a task should sort is dealt by a longer prefix: its
   suffixes go, once for each task and string, to the task of their first ``PREFIX`` bytes, and are sorted there.

Finally each document's covered bytes are cut out.  Both joins with the texts use one and the same shuffle of them.

Rows, not ids, are what spans belong to: a row is known by its doc_id and a hash of its id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from .common import rows_of, slices, stored, utf8

LENGTH = 50
K = 20
#: Longest run of strings in a segment.
RUN = 64
BATCH_BYTES = 2_000_000
#: Multikey quicksort goes so many bytes deep, in keys of eight, before blind tries take over.
SHALLOW = 24
KEY = 8
#: Segments of one least hash that are sorted in one place; the suffixes of larger groups are dealt by their first PREFIX bytes.
GROUP_SEGMENTS = 2_000
PREFIX = 32
#: Packed bytes of a bucket that one task sorts, on average; strings sorted together; strings a task holds before it deals them.
BUCKET_BYTES = 20_000_000
SORT_STRINGS = 200_000
HELD_STRINGS = 300_000
#: Text in a partition of the shuffled texts, on average.
TEXT_BYTES = 32_000_000

_SEGMENT = np.dtype([("least", "<u4"), ("body", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("n", "<u1"), ("flags", "<u1")])
_PLACE = "doc long, row long, start long, n int"


def _hash_grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place on (``data`` has k spare bytes at its end)."""
    n = len(data) - k
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for at in [*range(0, k - 8, 8), k - 8]:
        h = (h ^ eight[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def segments(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, strings, least hash, hash of the bytes) of each segment of a list of texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(length + k), np.uint8)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = _hash_grams(data, k)
    least, width, reach = grams, 1, length - k + 1
    while 2 * width <= reach:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    least = least[:total]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    whole = np.arange(total) + length <= ends[text]
    change = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~whole[1:]]
    starts = np.flatnonzero(change & whole)
    stops = np.searchsorted(np.flatnonzero(np.r_[change, True]), starts, "right")
    stops = np.flatnonzero(np.r_[change, True])[stops]
    n = stops - starts
    if len(n) and n.max() > RUN:  # cut long runs (periodic texts)
        pieces = -(-n // RUN)
        which = np.repeat(np.arange(len(n)), pieces)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = starts[which] + turn * RUN
        n = np.minimum(n[which] - turn * RUN, RUN)
    of = text[starts]
    # the bytes of a segment hash as a polynomial, from prefix sums; length and least hash go in too
    power = np.uint64(0x5851F42D4C957F2D)
    body = _range_hash(data, starts, n + length - 1, power)
    return of, starts - (ends - sizes)[of], n, least[starts], body ^ (n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _range_hash(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, power: np.uint64) -> np.ndarray:
    """64-bit hash of each range: its overlapping 8-byte words, mixed one by one."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = sizes.astype(np.uint64) * power
    most = int(sizes.max()) if len(sizes) else 0
    for at in range(0, most, 8):
        live = np.flatnonzero(sizes > at)
        where = starts[live] + np.minimum(at, np.maximum(sizes[live] - 8, 0))
        x = (h[live] ^ eight[where]) * np.uint64(0x9E3779B97F4A7C15)
        h[live] = x ^ (x >> np.uint64(29))
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _packed(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def dealt_segments(rows: DataFrame, buckets: int, length: int = LENGTH, k: int = K) -> DataFrame:
    """(bucket, blob): packed segments.

    flags 1: a repeat within its batch of a smaller document's segment, covered whatever the others say.  Only
    what is not flagged takes part in the comparison, so a batch adds one entry for each distinct segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 2):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            of, start, n, least, body = segments(utf8(batch.column(2)), length, k)
            rows = np.zeros(len(of), _SEGMENT)
            rows["doc"], rows["row"], rows["start"], rows["n"], rows["body"] = ids[of], keys[of], start, n, body
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            rows["least"] = (least // np.uint64(buckets)).astype(np.uint32)
            order = np.lexsort((rows["start"], rows["doc"], body, least))
            rows, bucket, least = rows[order], bucket[order], least[order]
            if len(rows):
                new = np.r_[True, (least[1:] != least[:-1]) | (rows["body"][1:] != rows["body"][:-1])]
                first = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
                rows["flags"] = rows["doc"] > first
            by = np.argsort(bucket, kind="stable")
            rows, bucket = rows[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    yield _packed(b, rows[cuts[b] : cuts[b + 1]].tobytes())

    return rows.where("doc_id is not null").select("doc", "row", "text").mapInArrow(run, "bucket int, blob binary")


def _compared(dealt: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, start, n, least): segments to cover (least null), and segments whose bytes must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(blob)
        for b in sorted(held):
            rows = np.frombuffer(b"".join(held.pop(b)), _SEGMENT)
            done = rows["flags"] > 0
            yield _places(rows[done], None)
            rows = rows[~done]
            rows = rows[np.lexsort((rows["doc"], rows["body"], rows["least"]))]
            if not len(rows):
                continue
            new_least = np.r_[True, rows["least"][1:] != rows["least"][:-1]]
            new_class = new_least | np.r_[True, rows["body"][1:] != rows["body"][:-1]]
            first = rows["doc"][np.flatnonzero(new_class)][np.cumsum(new_class) - 1]
            covered = rows["doc"] > first
            yield _places(rows[covered], None)
            # the smallest document's segments of a class stay; they are compared where classes of several documents meet
            group = np.cumsum(new_least) - 1
            low = np.minimum.reduceat(rows["doc"], np.flatnonzero(new_least))
            high = np.maximum.reduceat(np.where(covered, -(1 << 62), rows["doc"]), np.flatnonzero(new_least))
            classes = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_least))
            ask = ~covered & (classes > 1)[group] & (low < high)[group]
            chosen = rows[ask]
            yield _places(chosen, chosen["least"].astype(np.int64) * buckets + b)

    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(run, f"{_PLACE}, least long")


def _places(rows: np.ndarray, least: np.ndarray | None) -> pa.RecordBatch:
    key = pa.nulls(len(rows), pa.int64()) if least is None else pa.array(least, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"], pa.int64()), pa.array(rows["row"].astype(np.int64)), pa.array(rows["start"].astype(np.int64)), pa.array(rows["n"].astype(np.int32)), key], ["doc", "row", "start", "n", "least"])


def multikey_quicksort(data: np.ndarray, at: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings that begin at places ``at`` of ``data``, group by group, by their first ``shallow`` bytes.

    Three-way partitions by a pivot's next eight bytes, those of all groups in one pass: what is equal goes on eight
    bytes deeper.  (order, class): the order of the strings, and, in that order, a number for each run of strings
    that are equal in so many bytes.  ``group`` is ascending; ``data`` has eight spare bytes at its end.
    """
    words = np.ndarray((max(0, len(data) - KEY + 1),), ">u8", data, strides=(1,))
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]][: len(order)]
    depth = np.zeros(len(order), np.int64)
    live = np.arange(len(order))
    while True:
        part = np.cumsum(new[live]) - 1 if len(live) else live
        sizes = np.bincount(part) if len(live) else part
        keep = (sizes[part] > 1) & (depth[live] < shallow) if len(live) else live.astype(bool)
        live = live[keep]
        if not len(live):
            break
        item = order[live]
        part = np.cumsum(new[live]) - 1
        sizes = np.bincount(part)
        key = words[at[item] + depth[live]].astype(np.uint64)
        pivot = key[(np.cumsum(sizes) - sizes + sizes // 2)][part]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        by = np.argsort(part * 3 + side, kind="stable")
        order[live] = item[by]
        depth[live] = (depth[live] + KEY * (side == 1))[by]
        moved = (part * 3 + side)[by]
        new[live] = np.r_[True, moved[1:] != moved[:-1]]
    return order, np.cumsum(new) - 1


class BlindTrie:
    """Order of strings that share a long prefix, by the places where they part only.

    Nodes keep the depth of a branch and its bytes, not the text between; an insertion goes down blindly, then one
    comparison with the leaf that it reached tells the true common prefix.
    """

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth, self.top = strings, depth, None

    def insert(self, item: int) -> None:
        """A leaf is [None, equal items]; a branch is [depth, {byte: node}]."""
        text = self.strings[item]
        if self.top is None:
            self.top = [None, [item]]
            return
        node, path = self.top, []
        while node[0] is not None:
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if other == text:
            node[1].append(item)
            return
        at = self.depth
        while text[at] == other[at]:
            at += 1
        above = None
        below = self.top
        for p in path:
            if p[0] > at:
                break
            above, below = p, p[1].get(text[p[0]])
            if p[0] == at:
                p[1][text[at]] = [None, [item]]
                return
        branch = [at, {other[at]: below, text[at]: [None, [item]]}]
        if above is None:
            self.top = branch
        else:
            above[1][text[above[0]]] = branch

    def groups(self) -> Iterator[list[int]]:
        """Leaves in order: items of equal strings."""
        stack = [self.top]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[1]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def sorted_suffixes(data: bytes, at: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Groups of equal strings of ``length`` bytes, in order of the strings, group by group."""
    shallow = min(shallow, length // KEY * KEY)
    order, run = multikey_quicksort(np.frombuffer(data + bytes(KEY), np.uint8), at, group, shallow)
    cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]) if len(run) else np.zeros(1, np.int64)
    where = at.tolist()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        items = order[a:b].tolist()
        if b - a == 1:
            yield items
            continue
        strings = {i: data[where[i] : where[i] + length] for i in items}
        trie = BlindTrie(strings, shallow)
        for i in items:
            trie.insert(i)
        yield from trie.groups()


def _covered(held: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, row, start, n): runs of strings that a smaller document has too; held: (doc, row, start, least, body), by least."""
    doc, row, start = (np.array([h[c] for h in held], np.int64) for c in range(3))
    sizes = np.array([len(h[4]) for h in held], np.int64)
    count = sizes - length + 1
    which = np.repeat(np.arange(len(held)), count)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    least = np.array([h[3] for h in held], np.int64)
    group = np.cumsum(np.r_[True, least[1:] != least[:-1]]) - 1
    gone = np.zeros(len(which), bool)
    own = doc[which].tolist()
    for items in sorted_suffixes(b"".join(h[4] for h in held), (np.cumsum(sizes) - sizes)[which] + turn, group[which], length):
        if len(items) > 1:
            low = min(own[i] for i in items)
            gone[[i for i in items if own[i] > low]] = True
    at = np.flatnonzero(gone)
    begins = np.flatnonzero(np.r_[True, (which[at][1:] != which[at][:-1]) | (np.diff(at) > 1)]) if len(at) else at
    first = at[begins]
    return doc[which[first]], row[which[first]], start[which[first]] + turn[first], np.diff(np.r_[begins, len(at)])


def _found(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32))], ["doc", "row", "start", "n"])


def _met_suffixes(asked: DataFrame, texts: DataFrame, buckets: int, length: int, most: int) -> DataFrame:
    """(doc, row, start, n): runs of strings in the asked segments that a smaller document has too."""
    body = "doc long, row long, start long, least long, body binary"
    names = ["doc", "row", "start", "least", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows_as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple]] = {}
        holds = 0

        def deal() -> pa.RecordBatch:
            """Suffixes of large groups: the smallest document's go to the task of their prefix, others are covered (no body)."""
            rows = []
            for string, places in held.items():
                low, least = min(p[0] for p in places), xxh64_intdigest(string[:PREFIX]) >> 1
                rows.extend((*p, least, string if p[0] == low else None) for p in places)
            held.clear()
            return rows_as_batch(rows)

        for batch in slices(batches, BATCH_BYTES, 3):
            rows = []
            for doc, row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(3)), batch.column(5).to_pylist()):
                for w in wanted:
                    start = w["start"]
                    part = text[start : start + w["n"] + length - 1]
                    if not w["large"]:
                        rows.append((doc, row, start, w["least"], part))
                        continue
                    for i in range(w["n"]):
                        held.setdefault(part[i : i + length], []).append((doc, row, start + i))
                    holds += w["n"]
                    if holds > HELD_STRINGS:
                        yield deal()
                        holds = 0
            yield rows_as_batch(rows)
        yield deal()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        strings = 0
        for batch in batches:
            for h in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if h[4] is None:
                    continue
                if strings > SORT_STRINGS and h[3] != held[-1][3]:
                    yield _found(*_covered(held, length))
                    held, strings = [], 0
                held.append(h)
                strings += len(h[4]) - length + 1
            alone = [h for h in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))) if h[3] is None]
            yield _found(*(np.array([h[c] for h in alone], np.int64) for c in range(3)), np.ones(len(alone), np.int64))
        if held:
            yield _found(*_covered(held, length))
        pa.default_memory_pool().release_unused()

    large = stored(asked.groupBy("least").count().where(F.col("count") > most).select("least", F.lit(True).alias("large")))
    known = asked.join(large, "least", "left").select("doc", "row", F.struct("start", "n", "least", F.coalesce("large", F.lit(False)).alias("large")).alias("w"))
    wanted = known.groupBy("doc", "row").agg(F.collect_list("w").alias("wanted"))
    bodies = texts.join(wanted, ["doc", "row"]).mapInArrow(cut, body)
    return bodies.repartition(buckets, "least").sortWithinPartitions("least").mapInArrow(order, _PLACE)


def _runs(rows: DataFrame, texts: DataFrame, buckets: int, length: int, k: int, most: int) -> DataFrame:
    found = stored(_compared(dealt_segments(rows, buckets, length, k), buckets))
    covered = found.where("least is null").select("doc", "row", "start", "n")
    return covered.unionByName(_met_suffixes(found.where("least is not null"), texts, buckets, length, most))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = GROUP_SEGMENTS, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_text, spans array<struct<start, stop>>.

    kept_text is kept without the bytes that no longer form a character (a cut may lie within one).  ``carry``: columns
    of ``docs`` that come along, as the fields of a struct ``rest``.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id;
    overlaps count, all as judged on the input.  Null texts are empty.  Rows without doc_id keep everything and
    cover nothing.  Rows that repeat a doc_id are one document: they do not cover each other, and each is cut where its own text is covered.
    """
    if k < 8 or k > length:
        raise ValueError("8 <= k <= length is needed")
    rows = rows_of(docs, carry or [])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.repartition(max(least, 1 + size // TEXT_BYTES), "doc", "row")
    runs = _runs(rows, texts, max(least, 1 + int(1.7 * size) // BUCKET_BYTES), length, k, most).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 3):
            rows = []
            for doc, text, found in zip(batch.column(2).to_pylist(), utf8(batch.column(3)), batch.column(5).to_pylist()):
                spans: list[list[int]] = []
                for start, stop in sorted((r["start"], r["start"] + r["n"] + length - 1) for r in (found or () if doc is not None else ())):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([start, stop])
                kept, at = [], 0
                for start, stop in spans:
                    kept.append(text[at:start])
                    at = stop
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((doc, len(text), sum(b - a for a, b in spans), len(spans), rest, rest.decode("utf-8", "ignore"), [{"start": a, "stop": b} for a, b in spans]))
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*found, batch.column(4)], [*names, "rest"])

    joined = texts.join(runs, ["doc", "row"], "left")
    rest = joined.schema["rest"].dataType.simpleString()
    cut = joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, spans array<struct<start: bigint, stop: bigint>>, rest {rest}")
    return cut if carry else cut.drop("rest")
