"""Pooled corpora, review units, held-out checks and methods in small cases."""

import hashlib

from tarnwork.operators import corpora


def test_pooled_corpus(spark):
    files = [("b", "1", "x"), ("a", "9", "x"), ("a", "2", "x"), ("a", "3", "y"), (None, "4", "z"), ("a", "5", None), ("a", "6", "")]
    got = {r["doc_id"]: (r["topic"], r["filename"], r["size"], r["topics"]) for r in corpora.pooled_corpus(spark.createDataFrame(files, "topic string, filename string, content string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert got == {sha("x"): ("a", "2", 1, ["a", "b"]), sha("y"): ("a", "3", 1, ["a"]), sha(""): ("a", "6", 0, ["a"])}


def test_review_units(spark):
    units = [(" One. ", "Weakness"), ("", "question"), ("Why?", "remark"), ("Two", None), (None, None), ("Three", "QUESTION ")] + [("x", None)] * 5
    rows = [(1, None, units), (2, "r", []), (3, "r", None)]
    got = corpora.review_units(spark.createDataFrame(rows, "paper_id int, reviewer string, units array<struct<text: string, kind: string>>")).collect()
    assert [(r["unit_id"], r["text"], r["kind"]) for r in got][:4] == [("1::anon::01", "One.", "weakness"), ("1::anon::03", "Why?", "question"), ("1::anon::04", "Two", "weakness"), ("1::anon::06", "Three", "question")]
    assert got[-1]["unit_id"] == "1::anon::11" and len(got) == 9


def test_heldout_failures(spark):
    manifest = spark.createDataFrame([(1,), (2,), (2,), (3,)], "paper_id int")
    results = spark.createDataFrame([(1, 0, 0.9), (2, 3, None), (9, 5, 0.0)], "paper_id int, hallucinations int, anchor double")
    base = spark.createDataFrame([(0.6,)], "anchor double")
    assert {tuple(r) for r in corpora.heldout_failures(manifest, results, base).collect()} == {("missing", "3", None), ("hallucinated", "2", 3.0), ("anchor_drop", None, 0.45)}
    assert {r["failure"] for r in corpora.heldout_failures(manifest, results.limit(0), base).collect()} == {"missing"}


def test_methods_of_papers(spark):
    papers = spark.createDataFrame([(1, " Deep Learning "), (2, "learning"), (3, ""), (4, None), (5, "survey"), (6, "a deep learning survey")], "paper_id int, approach string")
    patterns = spark.createDataFrame([(1, "Survey"), (2, "deep learning"), (3, ""), (4, None), (5, "Machine learning")], "pattern_id int, pattern string")
    assert {tuple(r) for r in corpora.methods_of_papers(papers, patterns).collect()} == {(1, 2), (2, 2), (5, 1), (6, 1)}
