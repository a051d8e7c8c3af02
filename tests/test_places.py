"""Citations, anchors, contained strings, histories, nested values and expiring state in small cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import documents
from tarnwork.operators import anchors, histories
from tarnwork.streaming import sessions


def test_citations(spark):
    text = "As (Smith, 2020) and Jones et al. (1999a) say [3], [3]; (Lee & Kim, 2001). (Smith 2020) and (smith, 2020) [x]"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text)]
    got = {r["citation"]: r for r in anchors.citations(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {"(Smith, 2020)", "Jones et al. (1999a)", "[3]", "(Lee & Kim, 2001)"}
    assert (got["[3]"]["start"], got["[3]"]["authors"], got["[3]"]["year"]) == (text.index("[3]"), None, None)
    assert got["Jones et al. (1999a)"]["authors"] == ["Jones"] and got["(Lee & Kim, 2001)"]["authors"] == ["Lee", "Kim"]
    r = got["(Smith, 2020)"]
    assert text[r["start"] : r["stop"]] == "(Smith, 2020)" and r["context"] == f"As **(Smith, 2020)**{text[r['stop'] : r['stop'] + 100]}"


def test_nearest_intervals_equal_all_pairs(spark):
    rng = random.Random(6)
    claims = [(d, i, a, a + rng.randint(1, 20)) for d in range(4) for i, a in enumerate(rng.sample(range(300), 12))]
    marks = [(d, i, a, a + 2) for d in range(3) for i, a in enumerate(sorted(rng.sample(range(0, 300, 3), 9)))]
    got = {(r["doc_id"], r["claim_id"]): (r["mark_id"], r["distance"]) for r in anchors.nearest_intervals(spark.createDataFrame(claims, "doc_id int, claim_id int, start int, stop int"), spark.createDataFrame(marks, "doc_id int, mark_id int, start int, stop int"), 15).collect()}
    for d, c, a, b in claims:
        near = [(max(0, a - y), 0, -x, m) if x <= a else (max(0, x - b), 1, x, m) for e, m, x, y in marks if e == d]
        best = min(near, default=None)
        assert got[d, c] == ((best[3], best[0]) if best and best[0] <= 15 else (None, None))


def test_locate_snippets(spark):
    text = "First line here.\nThe “quick”  brown fox jumps over the lazy dog near the river bank today. Another — sentence stands alone, and it is long enough."
    cases = {
        1: ("quick”  brown", "exact", "quick”  brown"), 2: ('the "QUICK" brown\nfox', "normalized", "The “quick”  brown fox"),
        3: ("Nothing of it. Another - sentence stands alone, and it is long enough.", "sentence", "Another — sentence stands alone, and it is long enough."),
    4: ("xx lazy dog near the river bank today. yy", "window", "lazy dog near the river bank today."), 5: ("not there", "not_found", None), 6: ("  ", "empty", None), 7: (None, "empty", None),
    }
    s = spark.createDataFrame([(i, 1, c[0]) for i, c in cases.items()] + [(8, 2, "x"), (9, 99, "x"), (10, None, "x")], "snippet_id long, doc_id long, snippet string")
    got = {r["snippet_id"]: r for r in anchors.locate_snippets(s, spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert {i: (r["way"], r["matched"]) for i, r in got.items()} == {i: c[1:] for i, c in cases.items()} | {8: ("empty", None), 9: ("empty", None), 10: ("empty", None)}
    for i, r in got.items():
        assert r["matched"] is None or text[r["start"] : r["stop"]] == r["matched"]
    assert got[2]["line"] == 2 and got[5]["start"] is None


@pytest.mark.parametrize("gram", [1, 3, 8])
def test_contained_in_equals_all_pairs(spark, gram):
    rng = random.Random(gram)
    texts = [(i, "".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    strings = [(i, (rng.choice(texts[:60])[1] or "x")[: rng.randint(0, 14)]) for i in range(50)] + [(200, None), (201, ""), (202, "zzzzzzzzzzzz"), (203, "abz"), (0, "abc")]
    got = {tuple(r) for r in anchors.contained_in(spark.createDataFrame(strings, "string_id long, string string"), spark.createDataFrame(texts, "text_id long, text string"), gram).collect()}
    assert got == {(s, t) for s, x in strings for t, y in texts if x and y and x in y}


def test_histories(spark):
    schema = "file string, line long, text string"
    base = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("b", 0, "x"), ("c", 0, "x"), ("c", 1, "y"), ("d", 0, "x"), ("d", 1, "y")], schema)
    now = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "z"), ("c", 0, "x"), ("d", 0, "x"), ("d", 1, "other"), ("d", 2, "y"), ("e", 0, "new")], schema)
    got = {r["file"]: tuple(r)[1:] for r in histories.append_only(base, now).collect()}
    assert got == {"a": ("appended", None, 2, 3), "b": ("deleted", None, 1, 0), "c": ("shrank", None, 2, 1), "d": ("rewritten", 1, 2, 3)}
    assert {tuple(r) for r in histories.appended(base, now).collect()} == {("a", 2, "z"), ("d", 2, "y"), ("e", 0, "new")}
    assert histories.append_only(base.limit(0), now).count() == 0
    lines = spark.createDataFrame([("f", 0, '{"id": "a"}'), ("f", 1, ""), ("f", 2, "[1]"), ("f", 3, '{"x": 1}'), ("f", 4, '{"id": 5}'), ("f", 5, '{"id'), ("f", 6, None)], schema)
    assert {tuple(r) for r in histories.history(lines, "id").collect()} == {("f", 0, "a"), ("f", 4, "5")}


def test_nested_values(spark):
    value = {"b": [1, {"z": None, "y": "é"}], "a": {"d": True, "c": "x\\u0000"}}
    turned = {"a": {"c": "x\\u0000", "d": True}, "b": [1, {"y": "é", "z": None}]}
    rows = [(0, json.dumps(value)), (1, json.dumps(turned, indent=1)), (2, "no json"), (3, None), (4, json.dumps({"k\0": ["a\0\0b", "c\\u0000"]}))]
    df = spark.createDataFrame(rows, "i int, t string")
    t = F.col("t")
    got = {r["i"]: r for r in df.select("i", documents.canonical_json(t).alias("c"), documents.config_hash(t).alias("h"), documents.dig(t, "a", "d").alias("d"), documents.json_without_nul(t).alias("n")).collect()}
    assert got[0]["c"] == got[1]["c"] == json.dumps(turned, separators=(",", ":"), ensure_ascii=False) and got[0]["h"] == got[1]["h"]
    assert (got[0]["d"], got[4]["d"], got[2]["c"], got[3]["h"]) == ("true", None, None, None)
    assert json.loads(got[4]["n"]) == {"k": ["ab", "c\\u0000"]} and got[0]["n"] == rows[0][1]


def batches(spark, tmp_path, parts):
    """A stream of one file a batch, of (key, event_id, seconds, step, percent)."""
    begin, schema = datetime(2024, 1, 1), "key long, event_id long, ts timestamp, step string, percent double"
    for n, rows in enumerate(parts):
        spark.createDataFrame([(k, i, begin + timedelta(seconds=s), step, p) for k, i, s, step, p in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_progress_never_falls_and_expires(spark, tmp_path):
    parts = [[(1, 1, 0, "a", 10.0), (1, 2, 5, "b", 5.0), (2, 3, 0, "a", 50.0), (None, 9, 0, "x", 1.0), (3, 4, 0, "a", None)], [(1, 5, 60, "c", 7.0), (3, 6, 500, "b", 2.0)], [(3, 7, 1000, "c", 1.0)], []]
    changes = sessions.progress_snapshots(batches(spark, tmp_path, parts), 100, "1 second")
    got = {r["key"]: (r["percent"], r["step"], r["expired"]) for r in sessions.gathered(changes, f"{tmp_path}/s", ["key"]).collect()}
    assert got == {1: (10.0, "c", True), 2: (50.0, "a", True), 3: (1.0, "c", False)}


def test_limits_hold_across_batches_and_windows(spark, tmp_path):
    parts = [[(1, 1, 0, "", 0.0), (1, 2, 1, "", 0.0), (2, 3, 1, "", 0.0)], [(1, 4, 2, "", 0.0), (1, 5, 61, "", 0.0), (2, 6, 3, "", 0.0)], [(2, 7, 4, "", 0.0), (1, 8, 62, "", 0.0), (1, 9, 63, "", 0.0)]]
    passed = sessions.gathered(sessions.limited(batches(spark, tmp_path, parts), 2, 60), f"{tmp_path}/s", mode="append")
    assert sorted(r["event_id"] for r in passed.collect()) == [1, 2, 3, 5, 6, 8]


def test_empty_stream(spark, tmp_path):
    assert sessions.gathered(sessions.progress_snapshots(batches(spark, tmp_path, [[]]), 100), f"{tmp_path}/s", ["key"]).count() == 0
