import collections
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from tarnwork.llm import variants

FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(rows):
    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def result(spark, rows, schema="doc_id long, text string"):
    return {tuple(r) for r in variants.spelling_variants(spark.createDataFrame(rows, schema)).select(FIELDS).collect()}


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeéÿ"), rng.integers(5, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = base[min(int(rng.exponential(8)), 59)]
            if rng.random() < 0.3:
                p = rng.integers(0, len(w))
                w = [w[:p] + w[p + 1 :], w[:p] + "e" + w[p:], w[:p] + "a" + w[p + 1 :]][rng.integers(0, 3)]
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        rows.append((i, " ".join(words)))
    rows += [(1000, "xyxaaa " * 6 + "xyxaab " * 40 + "xyxabb " * 300)]  # a chain of two steps
    got = result(spark, rows)
    assert got == brute(rows)
    assert any(x[1] for x in got) and any(x[2] not in (x[0], x[1]) for x in got)


def test_words_at_distance_two_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = "".join(rng.choice(list("abcdefÿ"), rng.integers(6, 14)))
        p = rng.integers(0, len(w))
        for v in (w[:p] + "z" + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + "b" + w[p:]):
            a, b = variants.signatures([w, v])
            assert len(set(a.tolist()) & set(b.tolist())) >= 1
    assert len(variants._OUT) == len(list(combinations(range(variants.PARTS), 2)))


def test_each_pair_once_over_all_signatures():
    words = ["abcdef", "abcdefg", "abcdeg", "abbdef", "aabcdef", "fedcba", "abcdefabcdefabcdef"]
    signed = variants.signatures(words)
    found = collections.Counter()
    by = collections.defaultdict(list)
    for i, row in enumerate(signed.tolist()):
        for s in row:
            by[s].append(i)
    for s, members in by.items():
        pairs = variants.near_pairs([words[m] for m in members], np.full(len(members), s, np.uint64))
        found.update(tuple(sorted((words[members[a]], words[members[b]]))) for a, b in pairs.tolist())
    assert found == collections.Counter([("abcdef", "abcdefg"), ("abcdef", "abcdeg"), ("abcdefg", "abcdeg"), ("abbdef", "abcdef"), ("aabcdef", "abcdef")])


def test_nulls_repeats_clashing_columns_and_long_words(spark):
    long = "ab" * 3000
    texts = ["banana " * 6, None, "", "banane banane banane banane banane", f"{long} " * 5, f"{long}c " * 5, "bananas " * 30]
    plain = [(i, t) for i, t in enumerate(texts)] + [(None, "banana"), (None, "banana"), (3, texts[3])]
    rows = [(9, i, 1, t, t) for i, t in plain]
    got = result(spark, rows, "n long, doc_id long, signature int, text string, word string")
    assert got == brute(plain)
    assert any(x[0] == long and x[4] == 1 for x in got)
    assert result(spark, []) == set()


@pytest.mark.parametrize("block", [1, 50, 2_000_000])
def test_blocks_do_not_change_pairs(block, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_LETTERS", block)
    words = ["abcdef", "abcdeg", "abcdefg", "xyzxyz"]
    same = np.zeros(4, np.uint64)
    assert {tuple(x) for x in variants.near_pairs(words, same).tolist()} <= {(0, 1), (0, 2), (1, 2)}
