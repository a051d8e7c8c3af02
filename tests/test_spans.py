"""Span trees, damaged lines, ranks from counts, gates and checks at their edges."""

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import gates, relational, spans, texts, usage
from tarnwork.sources import stored, tables


def test_links_and_nearest_values_with_cycles(spark):
    """Repeated ids (first wins), missing parents, chains, cycles and other traces."""
    rows = [("t", i, i - 1 if i else None, "root" if i == 0 else None, i) for i in range(40)] + [("t", 5, None, "late", 99), ("t", 50, 51, None, 0), ("t", 51, 50, None, 0), ("t", 60, 999, None, 0), ("u", 1, 0, None, 0), ("t", 70, 39, "own", 0)]
    linked = spans.link(spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, value string, seen int"), ["seen"])
    got = {(r["trace_id"], r["span_id"]): r["value"] for r in spans.nearest_known(linked, F.col("value")).collect()}
    assert all(got["t", i] == "root" for i in range(40)) and got["t", 70] == "own"
    assert got["t", 50] is None and got["t", 51] is None and got["t", 60] is None and got["u", 1] is None
    facts = {(r["trace_id"], r["span_id"]): (r["is_root"], r["missing_parent"]) for r in linked.collect()}
    assert facts["t", 60] == (True, 999) and facts["u", 1] == (True, 0) and facts["t", 0] == (True, None) and facts["t", 5] == (False, None) and len(facts) == 45
    assert spans.nearest_known(linked.limit(0), F.col("value")).count() == 0


def test_damaged_span_lines(spark):
    lines = ['{"span_id": "a", "trace_id": "t", "start_time": "x", "duration_ms": 5}', '{"span_id": "", "trace_id": "t"}', '{"span_id": "a"}', "", None, "{", '{"span_id": "b", "trace_id": "t", "name": " ", "status": "ERROR"}']
    got = [tuple(r) for r in spans.parse_lines(spark.createDataFrame([(x,) for x in lines], "raw string")).select("reason", "name", "status", "start", "duration_ms").collect()]
    assert got[0] == (None, "<unnamed>", "OK", None, 5.0) and got[6] == (None, "<unnamed>", "ERROR", None, None)
    assert [g[0] for g in got[1:6]] == ["missing:span_id", "missing:trace_id", "blank", "blank", "not_json"]


def test_cost_needs_the_rates_it_uses(spark):
    rows = spark.createDataFrame([("m", 100, 10, 0), ("m", 100, 10, 50), ("n", 100, 10, 50), ("?", 1, 1, 0), (None, 1, 1, 0), ("n", None, None, None)], "model string, p int, c int, k int")
    got = [r[0] for r in rows.select(spans.cost(rows.model, rows.p, rows.c, rows.k, {"m": (1.0, None, 2.0), "n": (1.0, 0.5, 2.0)})).collect()]
    assert got == [pytest.approx(0.12), None, pytest.approx(0.095), None, None, 0.0]


def test_running_counts_and_quantiles(spark):
    values = [3.0, 1.0, 3.0, None, -2.0, 7.0, 7.0, 7.0]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int")
    got = {r["value"]: (r["rows"], r["before"]) for r in relational.running_counts(df, "v", 3).collect()}
    assert got == {-2.0: (1, 0), 1.0: (1, 1), 3.0: (2, 2), 7.0: (3, 4)}
    q = relational.index_quantiles(df, [], "v", {"low": 0.0, "half": 0.5, "top": 1.0}).first()
    assert (q["low"], q["half"], q["top"]) == (-2.0, 3.0, 7.0)


def test_similar_titles_either_side_smaller(spark):
    left = [(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, []), (4, ["a", "b", "q", "r", "s"])]
    right = [(1, ["a", "b"]), (2, ["x", "y", "z"]), (3, ["a", "b", "c", "d", "e", "f"])]
    l, r = spark.createDataFrame(left, "left_id long, words array<string>"), spark.createDataFrame(right, "right_id long, words array<string>")
    got = {(x["left_id"], x["right_id"]): x["similarity"] for x in texts.similar_titles(l, r, 0.6, "containment").collect()}
    assert got == {(1, 1): 1.0, (1, 3): 1.0, (2, 2): 1.0, (4, 1): 1.0}
    assert {(x["left_id"], x["right_id"]) for x in texts.similar_titles(l, r, 0.6).collect()} == {(1, 3)}


def test_metric_regression_and_best(spark):
    rows = [("s", 1, "a", "m", 10.0), ("s", 2, "a", "m", 9.0), ("s", 3, "a", "m", 12.0), ("s", 3, "b", "m", 1.0), ("s", 3, "a", "k", 1.0), ("s", 3, "a", "free", 5.0)]
    df = spark.createDataFrame(rows, "sink string, at int, identity string, metric string, value double")
    got = {(r["identity"], r["metric"]): r["verdict"] for r in gates.metric_regression(df, {"m": ("up", 0.2, True), "k": ("down", 0.0, False)}).collect()}
    assert got == {("a", "m"): "violation", ("b", "m"): "new", ("a", "k"): "no_baseline"}


def test_isolation_stops(spark):
    rows = spark.createDataFrame([(1, True), (1, True)], "run int, published boolean")
    assert usage.isolated(rows, "run", F.lit(1), "published").count() == 2
    for bad in ((2, True), (1, False), (1, None)):
        with pytest.raises(Exception, match="isolation violation"):
            usage.isolated(rows.unionByName(spark.createDataFrame([bad], rows.schema)), "run", F.lit(1), "published").collect()


def test_stored_tables_and_sinks(spark, tmp_path):
    held = stored.stored(spark.range(5).withColumn("k", F.col("id") % 2))
    assert held.count() == 5
    stored.dropped(held)
    path = str(tmp_path / "chunks")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "doc int, text string"), path, "doc")
    tables.replace_partitions(spark.createDataFrame([(2, "c")], "doc int, text string"), path, "doc")
    assert sorted((r["doc"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    log = str(tmp_path / "log")
    for n in (1, 2):
        tables.append_json(spark.createDataFrame([(n,)], "n int"), log)
    assert sorted(r["n"] for r in spark.read.json(log).collect()) == [1, 2]
