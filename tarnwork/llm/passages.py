"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are content-defined, so that a passage copied into the middle of other text falls into the same paragraphs
there: a paragraph ends with each sentence (or line) of ``LONG_SENTENCE`` words or more and takes the short ones before
it along; a text's last short ones join the paragraph before them.  Every paragraph takes part.  The MinHash bands of its
five-word shingles are tuned for recall; paragraphs that collide in a band are joined into candidate groups, the exact
Jaccard similarity is verified within each (within each band key, where a group is large), and the components of the verified links are the classes.  Of a class the
smallest document's paragraphs stay; those in other documents are removed where they make up a passage: a run of such
paragraphs of ``LEAST_SPAN_WORDS`` words or more.  Shorter runs, the single lines that many documents share, stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, id_and_text, rows_of, slices, stored, utf8

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
ROWS = 2
LONG_SENTENCE = 6
LEAST_SPAN_WORDS = 20
BATCH_BYTES = 4_000_000
#: Candidate groups with more paragraphs are verified by their band keys.
BLOCK = 1500
#: Pairs, or shingles of pairs, that a task looks at a time.
PAIRS = 1_000_000

_POWER, _INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_ENDS = np.array([chr(c) in ".!?\n" for c in range(256)])
_ENTRY = np.dtype([("key", "<u4"), ("unit", "<u8")])


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` values that find a pair of that similarity with that probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each range of ``values``, whatever its place: polynomial prefix sums, moved to the start."""
    sums = np.r_[np.uint64(0), np.cumsum(values * _powers(len(values), _POWER))]
    return _mixed((sums[stops] - sums[starts]) * _powers(len(values) + 1, _INVERSE)[starts] + (stops - starts).astype(np.uint64) * _MIX)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined by line breaks, in lower case; where their words begin and end; the hash of each word."""
    low = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.diff(np.r_[0, _IN_WORD[low].astype(np.int8), 0])
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # in pieces, so that the power tables stay small
    words = [_ranges(low[a:b].astype(np.uint64) + np.uint64(1), w0[i:j] - a, w1[i:j] - a) for i in range(0, len(w0), 65536) for j in [min(i + 65536, len(w0))] for a, b in [(w0[i], w1[j - 1])]]
    return low, w0, w1, np.concatenate(words) if words else np.zeros(0, np.uint64)


def whole(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """Each body as one paragraph: first and last (words), unit, and ``words``, as in ``paragraphs``."""
    _, w0, _, words = _words(bodies)
    last = np.searchsorted(w0, np.cumsum([len(b) + 1 for b in bodies]))
    first = np.r_[0, last[:-1]].astype(np.int64)
    return {"first": first, "last": last, "unit": _ranges(words, first, last), "words": words}


def paragraphs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Paragraphs of a list of texts: text, start and stop (bytes), first and last (words), unit (hash of the words).

    Also ``words``: the hash of each word, over all texts.
    """
    low, w0, w1, words = _words(texts)
    none = np.zeros(0, np.int64)
    if not len(w0):
        return {"text": none, "start": none, "stop": none, "first": none, "last": none, "unit": none.view(np.uint64), "words": none.view(np.uint64)}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_end = np.cumsum(sizes)
    ends = np.unique(np.searchsorted(w0, np.flatnonzero(_ENDS[low])))  # words before each sentence end
    ends = ends[ends > 0]
    length = np.diff(np.r_[0, ends])
    last_of_text = np.isin(ends, np.searchsorted(w0, text_end))
    closes = (length >= LONG_SENTENCE) | last_of_text
    cut, final = ends[closes], last_of_text[closes]
    rest = final & (np.diff(np.r_[0, cut]) < LONG_SENTENCE)
    cut = cut[final | ~np.r_[rest[1:], False]]
    first, last = np.r_[0, cut[:-1]], cut
    text = np.searchsorted(text_end, w0[first], "right")
    offset = (text_end - sizes)[text]
    return {"text": text, "start": w0[first] - offset, "stop": w1[last - 1] - offset, "first": first, "last": last, "unit": _ranges(words, first, last), "words": words}


def shingles(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of the n words from each place on (the last places have fewer)."""
    padded = np.r_[words, np.zeros(n - 1, np.uint64)]
    h = np.zeros(len(words), np.uint64)
    for j in range(n):
        h = _mixed(h ^ padded[j : j + len(words)])
    return h


def band_keys(p: dict[str, np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """Key of each paragraph in each band, of MinHash values over its shingles (fewer words: one shorter shingle)."""
    first = p["first"]
    count = np.maximum(p["last"] - first - SHINGLE_WORDS + 1, 1)
    h = shingles(p["words"])
    at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    h = h[at]
    short = np.repeat(p["last"] - first < SHINGLE_WORDS, count)
    h[short] = np.repeat(p["unit"], count)[short]
    begin = np.r_[0, np.cumsum(count)[:-1]]
    keys = np.zeros((bands, len(first)), np.uint64)
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            salt = np.uint64(((b * rows + r) * 2 + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
            value = (h ^ salt) * _MIX
            value ^= value >> np.uint64(31)
            key = _mixed(key ^ np.minimum.reduceat(value * salt, begin)) if len(begin) else key
        keys[b] = key
    return keys


def candidate_links(docs: DataFrame, buckets: int, bands: int) -> DataFrame:
    """(a, b): paragraphs that collide in a band, each linked to the least of its key; (a, a): a paragraph there twice.

    Keys are dealt as packed numbers; a batch sends a paragraph at most twice, however often it has it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES):
            p = paragraphs(utf8(batch.column(1)))
            unit = p["unit"]
            if not len(unit):
                continue
            order = np.argsort(unit, kind="stable")
            same = np.r_[False, unit[order][1:] == unit[order][:-1]]
            third = same & np.r_[False, same[:-1]]
            once, twice = np.sort(order[~same]), np.sort(order[~third])
            keys = band_keys(p, bands)
            entries, bucket = [], []
            for b in range(bands):
                take = twice if b == 0 else once
                e = np.zeros(len(take), _ENTRY)
                e["unit"] = unit[take]
                e["key"] = (keys[b][take] // np.uint64(buckets)).astype(np.uint32)
                entries.append(e)
                bucket.append((keys[b][take] % np.uint64(buckets)).astype(np.int64))
            entries, bucket = np.concatenate(entries), np.concatenate(bucket)
            by = np.argsort(bucket, kind="stable")
            entries, cuts = entries[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([entries[cuts[b] : cuts[b + 1]].tobytes()], pa.binary())], ["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(blob)
        for b in sorted(held):
            e = np.frombuffer(b"".join(held.pop(b)), _ENTRY)
            e = e[np.lexsort((e["unit"], e["key"]))]
            unit, start = e["unit"], np.r_[True, e["key"][1:] != e["key"][:-1]]
            least = unit[np.flatnonzero(start)][np.cumsum(start) - 1]
            repeated = np.r_[False, (unit[1:] == unit[:-1]) & ~start[1:]]
            links = (unit != least) & ~repeated
            a, c = np.r_[unit[links], unit[repeated]], np.r_[least[links], unit[repeated]]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])

    return id_and_text(docs).mapInArrow(deal, "bucket int, blob binary").repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "a long, b long").distinct()


def places(rows: DataFrame) -> DataFrame:
    """(doc, row, unit, start, stop, n_words, body): every paragraph; body is its bytes.  rows: (doc, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 2):
            texts = utf8(batch.column(2))
            p = paragraphs(texts)
            text, start, stop = p["text"], p["start"], p["stop"]
            of = pa.array(text.astype(np.int64))
            body = [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(p["unit"].view(np.int64)), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array((p["last"] - p["first"]).astype(np.int32)), pa.array(body, pa.binary())],
                ["doc", "row", "unit", "start", "stop", "n_words", "body"],
            )

    return rows.select("doc", "row", "text").mapInArrow(run, "doc long, row long, unit long, start long, stop long, n_words int, body binary")


def shingle_sets(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, body): the set of shingles of each body, one after the other; those of a body in order."""
    p = whole(bodies)
    length = p["last"] - p["first"]
    count = np.where(length > 0, np.maximum(length - SHINGLE_WORDS + 1, 1), 0)
    body = np.repeat(np.arange(len(bodies)), count)
    h = shingles(p["words"])[np.arange(len(body)) + np.repeat(p["first"] - (np.cumsum(count) - count), count)]
    short = length[body] < SHINGLE_WORDS
    h[short] = p["unit"][body[short]]
    order = np.lexsort((h, body))
    h, body = h[order], body[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (body[1:] != body[:-1])][: len(h)]
    return h[once], body[once]


def similar(units: list[int], bodies: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that join what chains of pairs with an exact Jaccard similarity of at least ``similarity`` join."""
    return [(units[i], units[j]) for i, j in similar_in_groups(np.zeros(len(bodies), np.int64), *shingle_sets(bodies), similarity)]


def similar_in_groups(group: np.ndarray, shingle: np.ndarray, of: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j): links within groups that join what chains of similar pairs join; group: of each body, in order; shingle and of: their sets.

    The body that shares most shingles with its group is compared with all of it; those similar to it are joined.  Any other is compared
    with the bodies that have one of its rarest shingles among their own rarest (of n shingles the n - ceil(similarity * n) + 1 rarest must hold a
    common one), unless chains of links join the two already.  So a group of near copies costs time in proportion to its bodies.
    """
    bodies = len(group)
    n = np.bincount(of, minlength=bodies)
    order = np.lexsort((shingle, group[of]))
    h, of = shingle[order], of[order]
    g = group[of]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)])
    size = np.diff(np.r_[starts, len(h)])
    common = np.repeat(size > 1, size)
    alone = n - np.bincount(of[common], minlength=bodies)  # shingles that no other body of the group has
    of, size = of[common], size[size > 1]
    if not len(of):
        return []
    run, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    met = np.bincount(of, weights=size[run], minlength=bodies)
    of_group = np.r_[0, np.cumsum(group[1:] != group[:-1])]
    by_met = np.lexsort((-met, of_group))
    hub = by_met[np.r_[True, of_group[by_met][1:] != of_group[by_met][:-1]]][of_group]  # of each body's group
    with_hub = np.logical_or.reduceat(of == hub[of], starts)
    shared = np.bincount(of, weights=with_hub[run], minlength=bodies)
    each = np.arange(bodies)
    joined = (shared >= similarity * (n[hub] + n - shared) - 1e-9) & (each != hub) & (n > 0)
    root = np.where(joined, hub, each)
    links = list(zip(hub[joined].tolist(), each[joined].tolist()))
    # the rarest shingles of each body, those that nobody shares first
    rarest = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1 - alone
    by_body = np.lexsort((run, size[run], of))
    begin = np.searchsorted(of[by_body], each)
    rare = by_body[np.arange(len(of)) - begin[of[by_body]] < rarest[of[by_body]]]
    rare = rare[np.lexsort((of[rare], run[rare]))]
    r_of, r_run = of[rare], run[rare]
    asks = np.flatnonzero((~joined & (each != hub))[r_of])
    if not len(asks):
        return links
    asks = asks[np.argsort(r_of[asks], kind="stable")]
    r_begin, r_end = np.searchsorted(r_run, r_run[asks], "left"), np.searchsorted(r_run, r_run[asks], "right")
    spot = np.sort(of * len(size) + run)  # which body has which shingle
    mine, held = np.sort(of), run[np.lexsort((run, of))]
    body_at = np.searchsorted(mine, np.arange(bodies + 1))
    for low, high in _pieces(r_end - r_begin, PAIRS):
        # a shingle whose bodies are all joined already links no more
        runs = np.flatnonzero(np.r_[True, r_run[1:] != r_run[:-1]])
        open_ = np.repeat(np.minimum.reduceat(root[r_of], runs) != np.maximum.reduceat(root[r_of], runs), np.diff(np.r_[runs, len(r_run)]))
        some = np.arange(low, high)[open_[asks[low:high]]]
        k = r_end[some] - r_begin[some]
        i, j = np.repeat(r_of[asks[some]], k), r_of[np.repeat(r_begin[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        pairs = np.unique((i * bodies + j)[(root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)])
        i, j = pairs // bodies, pairs % bodies
        for a, b in _pieces(np.diff(body_at)[j], PAIRS):
            x, y = i[a:b], j[a:b]
            k = body_at[y + 1] - body_at[y]
            wanted = np.repeat(x, k) * len(size) + held[np.repeat(body_at[y] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            at = np.minimum(np.searchsorted(spot, wanted), len(spot) - 1)
            both = np.bincount(np.repeat(np.arange(len(x)), k), weights=spot[at] == wanted, minlength=len(x))
            near = both >= similarity * (n[x] + n[y] - both) - 1e-9
            forest, new = Forest(), []
            for p, q in zip(x[near].tolist(), y[near].tolist()):
                if forest.link(int(root[p]), int(root[q])):
                    new.append((p, q))
            if new:
                links += new
                old = np.array(sorted(forest.up), np.int64)
                to = np.arange(bodies)
                to[old] = [forest.root(v) for v in old.tolist()]
                root = to[root]
    return links


def _pieces(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose costs are ``most`` in all at most, or one place."""
    total, start = np.cumsum(costs), 0
    while start < len(costs):
        stop = max(start + 1, int(np.searchsorted(total, most + (total[start - 1] if start else 0), "right")))
        yield start, stop
        start = stop


def _links_in_groups(rows: DataFrame, group: str, similarity: float) -> DataFrame:
    """(a, b): links within each group of rows (group, unit, body), sorted by group within their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # group, unit, shingle, body, of groups that may go on

        def closed() -> pa.RecordBatch:
            sizes = np.cumsum([0, *(len(x[0]) for x in held)])
            groups, units, shingle = (np.concatenate([x[k] for x in held]) for k in range(3))
            links = similar_in_groups(groups, shingle, np.concatenate([x[3] + n for x, n in zip(held, sizes)]), similarity)
            i, j = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(units[i]), pa.array(units[j])], ["a", "b"])

        for batch in slices(batches, BATCH_BYTES, 2):
            groups, units = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            shingle, body = shingle_sets(batch.column(2).to_pylist())
            last = int(np.argmax(groups == groups[-1]))
            for part, (a, b) in enumerate(((0, last), (last, len(groups)))):
                inside = (body >= a) & (body < b)
                if part and held and held[-1][0][-1] != groups[-1]:
                    yield closed()
                    held.clear()
                if b > a:
                    held.append((groups[a:b], units[a:b], shingle[inside], body[inside] - a))
        if held:
            yield closed()

    return rows.select(group, "unit", "body").sortWithinPartitions(group).mapInArrow(run, "a long, b long")


def verified_links(candidates: DataFrame, bands: int, similarity: float = SIMILARITY, block: int = BLOCK, tasks: int = 8) -> DataFrame:
    """(a, b) of units in the same group whose exact similarity is high enough; candidates: (group, unit, body), units distinct.

    Groups are closures of collisions and may be long chains, so those of more than ``block`` paragraphs are not verified as a whole
    but by the band keys they collided in: a paragraph goes to as many tasks as there are bands.  Such a group is dealt by its paragraphs first.
    """
    large = candidates.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > block).select("group")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES, 2):
            keys = band_keys(whole(batch.column(2).to_pylist()), bands)
            at = pa.array(np.tile(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], ["key", "unit", "body"])

    small = _links_in_groups(candidates.join(large, "group", "left_anti").repartition(tasks, "group"), "group", similarity)
    chains = candidates.join(large, "group", "left_semi").repartition(tasks, "unit").select("group", "unit", "body").mapInArrow(keyed, "key long, unit long, body binary")
    return small.unionByName(_links_in_groups(chains.repartition(tasks, "key"), "key", similarity))


def paragraph_dedup(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least_words: int = LEAST_SPAN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_paragraphs_removed, n_removed, n_spans, kept (binary), classes, spans.

    A paragraph is removed if a document with a smaller doc_id has one of its class and the run of such paragraphs that it
    lies in has ``least_words`` words; classes has the classes of the removed ones.  Removed paragraphs next to each other
    make one span, with what separates them.  Null texts are empty; rows without doc_id keep everything and take part in
    nothing; rows that repeat a doc_id are one document, each cut by its own text.
    """
    rows = rows_of(docs, [])
    keyed = rows.where("doc_id is not null")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, 1 + size // 64_000_000)
    bands = tune_bands(similarity, recall)
    links = stored(candidate_links(keyed, buckets, bands))
    near = components(links.where("a <> b")).select(F.col("node").alias("unit"), F.col("component").alias("group"))
    groups = stored(near.unionByName(links.where("a = b").select(F.col("a").alias("unit"), F.col("a").alias("group")).join(near, "unit", "left_anti")))
    found = stored(places(keyed).join(groups.hint("shuffle_hash"), "unit"))
    candidates = found.join(near.select("unit"), "unit", "left_semi").groupBy("group", "unit").agg(F.first("body").alias("body"))
    candidates = stored(candidates)  # read by group and by band key
    classes = components(stored(verified_links(candidates, bands, similarity, tasks=max(tasks, 1 + size // 8_000_000))))
    of = found.select("doc", "row", "unit", "start", "stop", "n_words").join(classes.withColumnRenamed("node", "unit"), "unit", "left").withColumn("class", F.coalesce("component", "unit"))
    keeper = of.groupBy("class").agg(F.min("doc").alias("keeper"))
    gone = of.join(keeper, "class").where("doc > keeper").groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop", "class", "n_words")).alias("gone"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES):
            rows = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                spans: list[list] = []  # start, stop, words, classes
                for a, b, c, n in sorted({(w["start"], w["stop"], w["class"], w["n_words"]) for w in (wanted or () if doc is not None else ())}):
                    if spans and not any(_IN_WORD[_LOWER[x]] for x in text[spans[-1][1] : a]):
                        spans[-1] = [spans[-1][0], max(b, spans[-1][1]), spans[-1][2] + n, [*spans[-1][3], c]]
                    else:
                        spans.append([a, b, n, [c]])
                spans = [x for x in spans if x[2] >= least_words]
                kept, at = [], 0
                for a, b, _, _ in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                removed = [c for x in spans for c in x[3]]
                rows.append((doc, len(text), len(removed), sum(x[1] - x[0] for x in spans), len(spans), b"".join(kept), sorted(set(removed)), [{"start": x[0], "stop": x[1]} for x in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), span]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_paragraphs_removed", "n_removed", "n_spans", "kept", "classes", "spans"])

    joined = rows.join(gone, ["doc", "row"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_paragraphs_removed long, n_removed long, n_spans long, kept binary, classes array<bigint>, spans array<struct<start: bigint, stop: bigint>>")
