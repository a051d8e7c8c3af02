import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnwork.llm import collocations as C

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counts(rows):
    """(lang, words of a phrase) and how often it occurs, for one to four words."""
    f = collections.Counter()
    for lang, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^ \t]+", piece)
            f.update((lang or "und" if lang is None else lang, tuple(words[i : i + m])) for m in (1, 2, 3, 4) for i in range(len(words) - m + 1))
    return f


def brute(rows, least, top):
    f = counts(rows)
    total = collections.Counter()
    for (lang, g), a in f.items():
        total[lang] += a * (len(g) == 1)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    best = collections.defaultdict(list)
    for (lang, g), a in candidates.items():
        if any(other == lang and len(x) > len(g) and 100 * b >= 80 * a and any(x[i : i + len(g)] == g for i in range(len(x))) for (other, x), b in candidates.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        best[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in best.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def some_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "état", "a b", "x", "y", "z"] + [f"rare{i}" for i in range(40)]
    odds = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(n):
        picked = rng.choice(words, rng.integers(0, 30), p=odds / odds.sum()).tolist()
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n"], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in picked)
        rows.append(([None, "en", "fr"][rng.integers(0, 3)], text))
    return rows


@pytest.mark.parametrize("size,chunk", [(2_000_000, 1_000_000), (7, 9), (40, 5)])
def test_shards_sum_to_all_phrases(size, chunk, monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", size)
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    rows = [("en" if lang is None else lang, text) for lang, text in some_rows(60, 3)]
    everything = np.full(1 << 10, 255, np.uint8)
    for overlap, least, most in ((1, 1, 1), (3, 2, 4)):
        got = collections.Counter()
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
        for shard in C.shards(iter([batch]), overlap):
            ids, words = shard.sequence(), [w.decode() for w in shard.words()]
            if most == 1:
                got.update((shard.lang, (words[i],)) for i in ids[min(shard.carried, 1) :].tolist() if i)
                continue
            for sign, part in ((1, ids), (-1, np.r_[ids[: shard.carried], 0])):
                for columns, n in C.phrases(part, shard.hashes(), everything):
                    for g, a in zip(zip(*(c.tolist() for c in columns)), n.tolist()):
                        got[shard.lang, tuple(words[i] for i in g)] += sign * a
        want = {k: v for k, v in counts(rows).items() if least <= len(k[1]) <= most}
        assert {k: v for k, v in got.items() if v} == want


def result(spark, rows, schema="lang string, text string", **options):
    return {tuple(r) for r in C.collocations(spark.createDataFrame(rows, schema), **options).select(FIELDS).collect()}


def test_equals_brute_force(spark):
    rows = some_rows(700, 8)
    got = result(spark, rows, least_count=12, top=25)
    assert got == brute(rows, 12, 25)
    assert {x[0] for x in got} == {"und", "en", "fr"}


def test_arithmetic_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    whole = lambda c: f"cast({c} as decimal(20,0))"
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(big - 1, big, big)], "a long, l long, r long")
    got = df.select(F.expr(f"({whole('a')} * cast({C.SCALE} as decimal(10,0))) div ({whole('l')} + {whole('r')})").alias("s")).first()["s"]
    assert got == (big - 1) * 2_000_000 // (2 * big)


def test_bitmap_has_the_bits_of_its_hashes(spark):
    hashes = [0, 1, 32767, 32768, (1 << 26) - 1, -1, -(1 << 40) + 12345]
    bits = C._bitmap(spark.createDataFrame([(h,) for h in hashes], "h long"))
    on = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    assert set(on.tolist()) == {h & (C.BITMAP_BITS - 1) for h in hashes}


def test_nulls_empty_repeats_and_clashing_columns(spark):
    assert result(spark, []) == set()
    plain = [(None, "Big deal"), ("und", "big\tdeal. big"), ("de", None), ("de", ""), ("fr", "...,,;")] * 20
    rows = [(9, lang, text, 5, 5, "x") for lang, text in plain]
    assert result(spark, rows, "n long, lang string, text string, a int, h int, word string") == brute(plain, 30, 2000) == {("und", 1, "big deal", 40, 60, 40, 100, 800000)}


def test_very_long_text(spark):
    rows = [("en", "alpha beta gamma " * 200_000), ("en", "x" * 2_000_000 + " alpha beta")]
    got = {r[2]: r[3] for r in result(spark, rows)}
    assert got["alpha beta gamma alpha"] == 199_999
