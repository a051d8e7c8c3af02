"""Hand-computed cases of gates, merges, reference lists, critical paths and resampled intervals."""

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import calibration, records, traces
from tarnwork.sources import citations

SPANS = "span_id string, parent_id string, start double, stop double"


def shares(df):
    return {r["span_id"]: r["critical"] for r in traces.critical_path(df).collect()}


def test_critical_path_of_a_tree(spark):
    """The last of three parallel children blocks; the time inside it goes to its own child first."""
    spans = [("run", None, 0.0, 100.0), ("a", "run", 10.0, 50.0), ("b", "run", 10.0, 80.0), ("c", "run", 20.0, 60.0), ("b1", "b", 30.0, 70.0), ("none", "run", 90.0, 90.0)]
    assert shares(spark.createDataFrame(spans, SPANS)) == {"run": 30.0, "b": 30.0, "b1": 40.0}


def test_critical_path_goes_on_before_a_blocking_child(spark):
    """Children beyond their parent are clipped; an earlier child blocks up to where the later one began."""
    spans = [("run", None, 0.0, 100.0), ("late", "run", 60.0, 130.0), ("early", "run", -5.0, 70.0), ("lost", "absent", 0.0, 9.0)]
    assert shares(spark.createDataFrame(spans, SPANS)) == {"late": 40.0, "early": 60.0}
    assert shares(spark.createDataFrame([], SPANS)) == {}


def test_span_walls(spark):
    spans = [("t", None, "run", None, None, 7.0), ("t", "x", "node", 0.0, 50.0, None), ("u", None, "node", 1.0, 3.0, None), ("u", None, "node", 2.0, 9.0, None), ("v", "x", "node", 0.0, 1.0, None)]
    got = traces.span_walls(spark.createDataFrame(spans, "trace_id string, parent_id string, kind string, start double, stop double, duration double"))
    assert {r[0]: r[1] for r in got.collect()} == {"t": 7.0, "u": 8.0, "v": None}


def test_average_precision_and_curve_across_slices(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.0)], "y int, score double")
    assert calibration.average_precision(rows).first()[0] == pytest.approx(1 / 3 + 2 / 3 / 3 + 3 / 5 / 3)
    for slices in (1, 3, 1024):
        curve = {r["score"]: (r["tp"], r["fp"]) for r in calibration.pr_curve(rows, slices).collect()}
        assert curve == {0.9: (1, 0), 0.8: (2, 1), 0.1: (2, 2), 0.0: (3, 2)}
    assert calibration.average_precision(rows.where("y = 0")).first()[0] is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("v"))
    one = calibration.bootstrap_interval(rows.repartition(1), "id", "v").first()
    assert one == calibration.bootstrap_interval(rows.repartition(7), "id", "v").first()
    assert one["low"] < one["point"] == 4.5 < one["high"] and one["resamples"] == 200
    assert 0.4 < one["high"] - one["low"] < 0.75  # 2 * 1.96 * 2.87 / 20 = 0.56
    assert calibration.bootstrap_interval(rows.where("id < 0"), "id", "v").first() == (None, None, None, 0)


def test_bibtex_fields(spark):
    text = "% note\n@comment{x, y}\n@Article{ one ,\n  title = {A {Nested}\n Title},\n year=1999, doi = \"10.1/x\"}\n  @book{two, author={B and C}, booktitle={no title}}"
    got = citations.bibtex_entries(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "file_id int, text string")).collect()
    assert [tuple(r)[2:] for r in sorted(got, key=lambda r: r["place"])] == [("article", "one", "A Nested Title", None, 1999, "10.1/x"), ("book", "two", None, "B and C", None, None)]


def test_gates_with_unknown_figures(spark):
    df = spark.createDataFrame([(None, None, True, 3, None, None), (0.54, False, True, 3, 0.1, True), (0.9, False, True, 1, 0.74, True), (0.9, False, True, 0, 0.1, True), (0.58, True, False, 0, 0.69, False)], "p double, b boolean, pdf boolean, t int, c double, x boolean")
    p, b, pdf, t, c, x = (F.col(n) for n in df.columns)
    got = df.select(records.publish_gate(p, b, pdf, t, c, x), records.halt_reasons(p, b, c)).collect()
    assert [r[0] for r in got] == ["ok", "needs_parser_review", "needs_retry", "ok_sources_pruned", "needs_parser_review"]
    assert [r[1] for r in got] == [[], ["parser", "coverage"], [], ["coverage"], ["blocked", "parser", "coverage"]]


def test_first_source_wins_and_fill(spark):
    a = spark.createDataFrame([("k", 5), ("k", 3)], "key string, id int")
    b = spark.createDataFrame([("k", 1), ("m", 9)], "key string, id int")
    assert sorted(map(tuple, records.first_source_wins([a, b], "key", ["id"]).select("key", "source", "id").collect())) == [("k", 0, 3), ("m", 1, 9)]
    children = spark.createDataFrame([("k", None), ("k", 7), ("z", None), (None, None)], "key string, run int")
    filled = records.fill_from_parent(children, spark.createDataFrame([("k", 4)], "key string, run int"), "key", "run").collect()
    assert sorted(map(str, map(tuple, filled))) == ["('k', 4)", "('k', 7)", "('z', None)", "(None, None)"]


def test_markers(spark):
    refs = spark.createDataFrame([("d", 1, "Smith J", 2020), ("d", 2, "Ann Lee", None), ("d", 3, "J. Smith", 2021), ("d", 4, None, 1999)], "scope string, position int, author string, year int")
    want = {"[4]": 4, " 2 ": 2, "Smith et al. (2020)": 1, "(Smith, 2021a)": 3, "Smith (1990)": 3, "Lee 2001": 2, "[9]": None, "smith 2020": None, "": None, None: None}
    got = records.resolve_markers(spark.createDataFrame([("d", m) for m in want] + [("other", "[1]")], "scope string, marker string"), refs).collect()
    assert {r["marker"]: r["position"] for r in got if r["scope"] == "d"} == want
    assert [r["position"] for r in got if r["scope"] == "other"] == [None]


def test_upsert_and_publication(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, t int")
    assert {tuple(r) for r in records.upsert(now, new, ["k"], ["t"]).select("k", "v").collect()} == {(1, "a"), (None, "n"), (2, "y"), (3, "z")}
    rows = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "draft string, run int")
    shown = records.published(rows, spark.createDataFrame([("d", 2)], "draft string, active int"), "draft", "run")
    assert {(r["draft"], r["run"]): r["is_published"] for r in shown.collect()} == {("d", 1): False, ("d", 2): True, ("e", 1): False}


def test_tei_files_are_parsed_once(spark):
    head = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><titleStmt><title>  A <hi>b</hi> </title><title>second</title></titleStmt><abstract> a <abstract>in</abstract></abstract>"
    body = "<body><div><head>one<!-- c -->two<b>three</b></head><head>x&amp;<![CDATA[y]]></head><div><head>nested</head></div></div></body>"
    back = "<listBibl><biblStruct/><x><biblStruct/></x><biblStruct><title>no</title></biblStruct></listBibl></TEI>"
    files = spark.createDataFrame([("f", head + body + back), ("g", "<p:TEI xmlns:p='u'><p:titleStmt><p:title>t</p:title></p:titleStmt></p:TEI>"), ("h", ""), ("i", None)], "file_id string, xml string")
    found = citations.tei_fields(files)
    assert found.dtypes == [("file_id", "string"), ("title", "string"), ("abstract", "string"), ("headings", "array<string>"), ("n_references", "int")]
    assert [tuple(r) for r in found.orderBy("file_id").collect()] == [
        ("f", "A b", "a in", ["one", "two", "x&y"], 2), ("g", "t", "", [], 0), ("h", None, None, None, None), ("i", None, None, None, None)]
    assert "xpath" not in found._jdf.queryExecution().toString()
