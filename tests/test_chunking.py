"""Sentences, chunks, wording and clusters against plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np

from tarnwork.operators import chunking


def test_sentences_and_chunks(spark):
    """Whole sentences, the overlap of last sentences, sections that fit, blank ones, single long sentences."""
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma"], k=n))
    texts = {i: " ".join(words(rng.randint(1, 30)) + rng.choice([".", "!", "?"]) for _ in range(rng.randint(1, 30))) for i in range(30)}
    texts |= {100: None, 101: " \n ", 102: words(200), 103: "Short. One!"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got: dict = {}
    for r in chunking.chunk_sections(df, ["id"], 60, 15).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["chunk"], r["n_words"]))
    for i, t in texts.items():
        if not (t or "").strip():
            assert i not in got
            continue
        if len(t.split()) <= 60:
            want = [t]
        else:
            said, want, now = [s for s in __import__("re").split(r"(?<=[.!?])\s+", t) if s], [], []
            size = lambda x: sum(len(s.split()) for s in x)
            for s in said:
                if now and size(now) + len(s.split()) > 60:
                    want.append(" ".join(now))
                    while now and size(now) > 15:
                        now = now[1:]
                now = [*now, s]
            want.append(" ".join(now))
        assert [c for c, _ in got[i]] == want and all(n == len(c.split()) for c, n in got[i]), i


def test_split_evenly(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(chunking.split_evenly(df.t, 4)).collect()] == [["a b", "c d", "e", "f g"], ["a", "b"], [], []]
