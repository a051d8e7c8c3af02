"""Boards, pools, timelines and wording on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import wording
from tarnwork.operators import boards


def test_severity_weight_is_clamped_and_has_defaults(spark):
    df = spark.createDataFrame([(None, None, False), (0.0, 5.0, True), (10.0, 5.0, True), (3.0, 4.0, True), (-2.0, 9.0, False)], "r double, c double, m boolean")
    got = [x[0] for x in df.select(F.round(boards.severity_weight(F.col("r"), F.col("c"), F.col("m")), 4)).collect()]
    assert got == [0.3, 1.0, 0.1, 0.84, 1.0]


def test_pool_makes_room_for_the_next_batch(spark):
    pool = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, t int")
    assert sorted(map(tuple, boards.over_cap(pool, ["k"], ["t"], 2, 4).collect())) == [("a", 0), ("a", 1), ("a", 2)]


def test_contexts_leave_dismissed_rows_out(spark):
    rows = spark.createDataFrame([(i, "dismissed" if i == 2 else None, ["g"], None if i % 2 else ["t"]) for i in range(1, 8)], "id int, s string, g array<string>, t array<string>")
    got = {}
    for r in boards.grouped_by_context(rows, "id", "s", {"gap": "g", "topic": "t"}).orderBy("context", "name", "position").collect():
        got.setdefault(r["context"], []).append(r["id"])
    assert got == {"gap": [1, 3, 4], "topic": [4, 6], "summary": [1, 3, 4, 5, 6]}
    assert boards.grouped_by_context(rows.where("id < 0"), "id", "s", {"gap": "g"}).count() == 0


def test_staleness_reasons(spark):
    df = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 5, 5), (1, 1, 5, 6), (None, 2, 5, 6), (1, 1, None, 6)], "a int, b int, w int, l int")
    got = [r[0] for r in df.select(boards.staleness(F.col("a"), F.col("b"), F.col("w"), F.col("l"))).collect()]
    assert got == [None, "document_count_changed", "documents_changed", "documents_changed_and_count_changed", None]


def test_failures_count_from_the_last_success(spark):
    calls = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, False, None), ("a", 3, True, "y"), ("a", 4, True, "z"), ("b", 1, True, "q"), ("c", 1, True, "q"), ("c", 2, False, None)], "k string, t int, f boolean, e string")
    got = {r[0]: (r[1], r[2]) for r in boards.failures_since_success(calls, "k", ["t"], F.col("f"), "e").collect()}
    assert got == {"a": (2, "z"), "b": (1, "q"), "c": (0, None)}


def test_recurring_patterns_need_three_versions_and_two_findings(spark):
    rows = spark.createDataFrame([("a", 1, " Missing X"), ("a", 2, "missing x"), ("a", 3, "other"), ("a", 3, None), ("b", 1, "same"), ("b", 2, "same")], "o string, v int, t string")
    assert [(r["pattern"], r["n"], r["versions"]) for r in boards.recurring_patterns(rows, "o", "v", "t").collect()] == [("missing x", 2, [1, 2])]


def test_first_and_last_and_effective_sample(spark):
    rows = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("b", 1, 1.0)], "k string, t int, v double")
    assert [tuple(r) for r in boards.first_and_last(rows, "k", ["t"], "v").collect()] == [("a", 2, 3.0, 5.0, 2.0)]
    got = {r[0]: (r[1], r[2]) for r in boards.effective_sample(rows.unionByName(spark.createDataFrame([("c", 1, 0.0)], rows.schema)), "k", "v").collect()}
    assert got["b"] == (1, 1.0) and got["c"] == (1, None) and got["a"][1] == pytest.approx(64 / 34)


def test_keyset_page_filters_at_the_scan(spark):
    ids = spark.range(10).toDF("id")
    assert [r[0] for r in boards.keyset_page(ids, "id", 5, 2).collect()] == [4, 3]
    assert [r[0] for r in boards.keyset_page(ids, "id", None, 1).collect()] == [9]


def test_wording(spark):
    df = spark.createDataFrame([("The  Draft's claim-2", "one\n two three", "one two three four", "1, 2020;3-5;x;12"), (None, None, "abc", None), ("", "two words", "x", " ")], "a string, q string, t string, n string")
    got = df.select(wording.normal_finding(F.col("a")), wording.is_verbatim(F.col("q"), F.col("t")), wording.numeric_group(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("s claim 2", True, ["1", "3-5", "12"]), ("", False, []), ("", True, [])]


def test_text_cosine_is_zero_without_words(spark):
    df = spark.createDataFrame([(1, "aaa bbb", "AAA ccc"), (2, None, "aaa"), (3, "ab", ""), (4, "aaa aaa", "aaa")], "id int, l string, r string")
    got = {r[0]: r[1] for r in wording.text_cosine(df, ["id"], "l", "r").collect()}
    assert got == {1: pytest.approx(0.5), 2: 0.0, 3: 0.0, 4: pytest.approx(1.0)}
