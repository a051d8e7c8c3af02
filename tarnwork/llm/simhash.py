"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits.  Partition i gets its own threshold t_i, where the
thresholds sum to d - m + 1 (d: distance, m: partitions; -1 skips a partition): two fingerprints at most d bits
apart then differ by at most t_i bits in some partition i.  The thresholds come from dynamic programming over
candidate counts estimated on a bounded sample.  Every distinct fingerprint is put under its own value in each
used partition and under each value within t_i of it; rows that meet under a value are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Forest, components, id_and_text, stored, utf8

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
#: Fingerprints from which bit correlations and candidate counts are estimated.
SAMPLE = 4096
#: A compared pair costs this share of a row that is dealt to a bucket.
PAIR_COST = 0.02
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of one text (UTF-8) over its word shingles, repeats included; no words: 0."""
    words = text.lower().split()  # for bytes: A-Z only, and 0x20 and 0x09-0x0D only
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    byte = hashes.astype("<u8").view(np.uint8).reshape(n, 8).astype(np.int64) + np.arange(0, 2048, 256)
    ones = np.bincount(byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones.ravel() > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words, seed) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Group the 64 bits: each group grows by the bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(sample) < 2:
        return [list(map(int, g)) for g in np.array_split(np.arange(64), parts)]
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    like = np.abs(centred.T @ centred / len(sample))
    left, groups = set(range(64)), []
    for size in (len(x) for x in np.array_split(np.arange(64), parts)):
        rest = sorted(left)
        group = [max(rest, key=lambda b: (like[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (like[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds, one for each partition, of least total cost that sum to ``budget``; costs[i][t + 1] is for t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                key, value = used + t, (cost + c, [*chosen, t])
                if key not in nxt or value[0] < nxt[key][0]:
                    nxt[key] = value
        best = nxt
    return best[budget][1]


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each used partition: of all partition counts, the cheapest by estimate."""
    cheapest = None
    pairs = max(1.0, total * total / 2)
    for parts in range(2, distance + 2):
        groups, costs = partition_bits(sample, parts), []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            seen = np.zeros(len(group) + 1)
            for i in range(0, len(sample), 256):
                apart = np.bitwise_count((sample[i : i + 256, None] ^ sample[None, :]) & mask)
                seen += np.bincount(apart.ravel(), minlength=len(group) + 1)[: len(group) + 1]
            seen[0] -= len(sample)
            row = [0.0]
            for t in range(min(distance, len(group)) + 1):
                ball = sum(comb(len(group), k) for k in range(t + 1))
                share = max(seen[: t + 1].sum() / max(1, len(sample) * (len(sample) - 1)), ball / 2.0 ** len(group))
                row.append(total * ball + PAIR_COST * pairs * share)
            costs.append(row)
        thresholds = allocate(costs, distance - parts + 1)
        cost = sum(row[t + 1] for row, t in zip(costs, thresholds))
        if cheapest is None or cost < cheapest[0]:
            cheapest = (cost, [(sum(1 << b for b in g), g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return cheapest[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = DISTANCE, sample_rows: int = SAMPLE) -> DataFrame:
    """Links (a, b) of distinct fingerprints that join all whose chains of steps of at most ``distance`` bits meet.

    ``fps`` has a column fp without repeats.  Every pair that shares a bucket is compared in full, in numpy; of
    the pairs that are close each task returns a spanning forest only, so the rows grow with the fingerprints
    and not with the square of a group.
    """
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    used = plan(sample, fps.count(), distance)
    entries = F.array(*[
        F.struct(F.lit(i).alias("part"), F.lit(_signed(mask)).alias("mask"), F.lit(_signed(flip)).alias("flip"))
        for i, (mask, group, t) in enumerate(used)
        for flip in (sum(1 << b for b in c) for k in range(t + 1) for c in combinations(group, k))
    ])
    rows = (
        fps.select("fp", F.explode(entries).alias("e"))
        .select(F.col("e.part").alias("part"), F.expr("(fp & e.mask) ^ e.flip").alias("key"), "fp", F.expr("e.flip = 0").alias("home"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), []

        def emit(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.link(x, y)]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], ["a", "b"])

        def compare(part: np.ndarray, key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = len(fp)
            starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, n])
            group = np.repeat(np.arange(len(starts)), sizes)
            small = (sizes <= 64)[group]
            for shift in range(1, 64):
                at = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:] & (home[shift:] | home[:-shift])) if shift < n else []
                if not len(at):
                    break
                near = at[np.bitwise_count((fp[at] ^ fp[at + shift]).view(np.uint64)) <= distance]
                yield from emit(fp[near], fp[near + shift])
            for g in np.flatnonzero(sizes > 64):
                mine = slice(starts[g], starts[g] + sizes[g])
                every, homes = fp[mine], fp[mine][home[mine]]
                for i in range(0, len(homes), 256):
                    for j in range(0, len(every), 65536):
                        x, y = np.nonzero(np.bitwise_count((homes[i : i + 256, None] ^ every[None, j : j + 65536]).view(np.uint64)) <= distance)
                        yield from emit(homes[i + x], every[j + y])

        for batch in batches:  # sorted, so only the last bucket of a batch can go on in the next
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            changes = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
            cut = changes[-1] + 1 if len(changes) else 0
            if cut:
                yield from compare(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held and len(held[0]):
            yield from compare(*held)

    dealt = rows.repartition(F.col("part"), F.col("key")).sortWithinPartitions("part", "key")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id reachable over links of ``distance`` bits.

    One row for each row of ``docs``, repeated rows included.  Null or empty texts have fingerprint 0 and are
    linked like any other; a row without doc_id gets its component's least doc_id (null if there is none).
    Equal fingerprints are one node from the start, however many documents have it.
    """
    fps = stored(fingerprints(docs, shingle_words, seed))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    linked = components(links(nodes.select("fp"), distance))
    tops = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = tops.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_fp = tops.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")
