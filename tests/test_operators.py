"""Hand-computed cases of the operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import columns
from tarnwork.operators import calibration, ranking, relational, retrieval, texts, traces
from tarnwork.sources.tables import json_lines


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_ranking_of_three(spark):
    run = spark.createDataFrame([("q", "d1", 1), ("q", "d3", 2), ("q", "d2", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 1), ("none", "d9", 1)], "query_id string, doc_id string, grade int")
    m = {r["query_id"]: r for r in ranking.per_query(run, qrels, [2, 3]).collect()}
    assert m["q"]["ndcg_3"] == pytest.approx(0.9197208, abs=1e-6)
    assert (m["q"]["recall_2"], m["q"]["recall_3"], m["q"]["rr"]) == (0.5, 1.0, 1.0)
    assert m["q"]["ap"] == pytest.approx(0.83333, abs=1e-4)
    assert m["none"]["recall_3"] == 0 and m["none"]["rr"] == 0


def test_nearest_rank_and_floor_index(spark):
    df = spark.createDataFrame([(float(x),) for x in (100, 200, 300, 400, 500)], "v double")
    got = df.agg(*[columns.nearest_rank("v", q).alias(f"p{i}") for i, q in enumerate((0.5, 0.9, 0.99))]).first()
    assert tuple(got) == (300, 500, 500)
    assert relational.index_quantiles(df, [], "v", {"f": 0.8}).first()["f"] == 500
    twenty = spark.range(1, 21).select(F.col("id").cast("double").alias("v"))
    assert twenty.agg(columns.nearest_rank("v", 0.95)).first()[0] == 19


def test_self_time_and_union(spark):
    p = spark.createDataFrame([(1, 0.0, 1000.0)], "parent int, start double, stop double")
    c = spark.createDataFrame([(1, 200.0, 800.0), (1, 700.0, 800.0), (1, 900.0, 900.0)], "parent int, start double, stop double")
    assert rows(traces.self_time(p, c)) == [(1, 1000.0, 600.0, 400.0)]


def test_touching_intervals_merge_but_do_not_overlap(spark):
    s = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 0.0, 5.0), (2, 1.0, 2.0), (2, 3.0, 6.0)], "k int, start double, stop double")
    assert sorted(rows(traces.interval_union(s, ["k"]))) == [(1, 2.0, 2.0, 1), (2, 6.0, 9.0, 1)]
    assert [r[0] for r in rows(traces.overlap_groups(s, ["k"]))] == [2]
    assert sorted(rows(traces.in_flight(s, ["k"]))) == [(1, 1), (2, 2)]


def test_latest_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    assert sorted(rows(relational.latest_wins(df, ["k"], ["at"]))) == [("a", 2, "y"), ("b", 1, None)]
    assert sorted(rows(relational.first_wins(df, ["k"], ["at"]))) == [("a", 1, "x"), ("b", 1, None)]


def test_null_counts_as_new(spark):
    df = spark.createDataFrame([("new",), (None,), ("done",)], "s string")
    assert df.where(relational.status_filter(F.col("s"), "new")).count() == 2
    assert df.where(relational.status_filter(F.col("s"), "done")).count() == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_knn_ties_zero_and_null_vectors(spark, parts):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "chunk_id long, vector array<float>").repartition(parts)
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query_id long, vector array<float>")
    got = rows(retrieval.knn(q, c, 3).orderBy("rank"))
    assert [(r[1], round(r[2], 6)) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_fusions(spark):
    a = spark.createDataFrame([(1, 7, 4.0, 1), (1, 8, 2.0, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 8, 0.5, 1)], "query_id int, doc_id int, score double, rank int")
    assert {r["doc_id"]: r["score"] for r in retrieval.weighted_fusion([(a, 0.5), (b, 0.5)]).collect()} == {7: 0.5, 8: 0.75}
    fused = {r["doc_id"]: r["score"] for r in retrieval.reciprocal_rank_fusion([a, b]).collect()}
    assert fused[8] == pytest.approx(1 / 62 + 1 / 61) and fused[7] == pytest.approx(1 / 61)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None), (4, "a b")], "doc_id long, text string")
    got = sorted(rows(texts.chunk_windows(docs, 4, 1)))
    assert [(d, i, n) for d, i, n, _ in got] == [(1, 0, 4), (1, 1, 4), (1, 2, 4), (4, 0, 2)]
    sized = spark.createDataFrame([(5000,), (1200,)], "n int").select(texts.chunk_estimate(F.col("n"), 1200, 200).alias("c"))
    assert rows(sized) == [(5,), (1,)]
    assert rows(spark.createDataFrame([(20000,)], "n int").select(texts.chunk_estimate(F.col("n"), 1600, 250))) == [(15,)]


def test_similar_titles_equal_all_pairs(spark):
    titles = [(i, " ".join(w for j, w in enumerate(("alpha", "beta", "gamma", "delta", "omega")) if i >> j & 1)) for i in range(1, 32)]
    left, right = spark.createDataFrame(titles, "left_id int, title string"), spark.createDataFrame(titles, "right_id int, title string")
    sets = {i: set(t.split()) for i, t in titles}
    jaccard = {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    contain = {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.6}
    largest = {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) >= 0.6}
    words = [df.withColumn("words", columns.title_words(F.col("title"), 2)).drop("title") for df in (left, right)]
    for measure, want in (("jaccard", jaccard), ("containment", contain), ("largest", largest)):
        assert {r[:2] for r in rows(texts.similar_titles(*words, 0.6, measure))} == want
        assert {r[:2] for r in rows(texts.similar_to_sets(*words, 0.6, measure))} == want
        assert rows(texts.similar_to_sets(words[0].limit(0), words[1], 0.6, measure)) == []


def test_normalisers(spark):
    df = spark.createDataFrame([("See HTTPS://doi.org/10.1234/AbC.5).", "<p>a</p><script>x < y</script> b&nbsp;", "The  Title: 2!")], "d string, h string, t string")
    got = df.select(texts.normal_doi(F.col("d")), texts.html_text(F.col("h")), texts.normal_title(F.col("t"))).first()
    assert tuple(got) == ("10.1234/abc.5", "a b&nbsp;", "the title 2")


def test_calibration(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.3), (0, 0.6), (0, 0.1), (1, 1.0)], "y int, score double")
    sweep = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in calibration.threshold_sweep(df, [0.0, 0.3, 0.95]).collect()}
    assert sweep == {0.0: (3, 2, 0, 0), 0.3: (3, 1, 0, 1), 0.95: (1, 0, 2, 2)}
    bins = {r["bin"]: r["n"] for r in calibration.reliability(df).collect()}
    assert bins == {1: 1, 3: 1, 6: 1, 9: 2}


def test_longest_prefix(spark):
    df = spark.createDataFrame([("m-large-2",), ("m-1",), ("x",)], "model string")
    assert [r["price"] for r in traces.longest_prefix_price(df, "model", {"m": 1.0, "m-large": 5.0}).collect()] == [5.0, 1.0, None]


def test_damaged_json_lines(spark, tmp_path):
    good = json.dumps({"span_id": "s", "trace_id": "t"})
    (tmp_path / "x.jsonl").write_text("\n".join([good, "", "[1]", '{"span_id": "s"', json.dumps({"span_id": "s"})]))
    schema = spark.createDataFrame([], "span_id string, trace_id string").schema
    got = [r["reason"] for r in json_lines(spark, str(tmp_path), schema, ["span_id", "trace_id"]).collect()]
    assert got[0] is None and got[1] == "blank" and got[3] == "not_json" and got[4] == "missing:trace_id" and got[2] is not None


def test_separation_takes_all_pairs(spark, monkeypatch):
    """Blocks, slices, null labels and the query itself; no nearest-neighbour search with its bound on k stands before it."""
    import __spark_entry__ as registered

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "CHUNK_SLICE", 2)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(12, 4))
    labels = [0, 1, 2, None, 1, 0, 2, 1, 0, 1, 2, 0]
    chunks = spark.createDataFrame([(i, [float(x) for x in v], labels[i]) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>, doc_id long").repartition(3)
    queries = chunks.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.col("doc_id").alias("query_label"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs, pooled = {}, {}
    for q in range(0, 12, 3):
        for c in range(12):
            if q != c:
                s = float(unit[q] @ unit[c])
                known = labels[q] is not None and labels[c] is not None
                pairs.setdefault(labels[q] == labels[c] if known else None, []).append(s)
                if known:
                    pooled[q, labels[c]] = max(s, pooled.get((q, labels[c]), -2))
    got = {r["same"]: tuple(r)[1:] for r in retrieval.label_separation(queries, chunks).collect()}
    assert got == {k: pytest.approx((len(v), np.mean(v), min(v), max(v))) for k, v in pairs.items()}
    same, other = ([s for (q, d), s in pooled.items() if (labels[q] == d) == t] for t in (True, False))
    want = (len(same), np.mean(same), np.std(same), len(other), np.mean(other), np.std(other), np.mean(same) - np.mean(other))
    assert tuple(retrieval.document_separation(queries, chunks).first()) == pytest.approx(want)
    assert retrieval.label_separation(queries.limit(0), chunks).count() == 0
    monkeypatch.setattr(retrieval, "knn", None)
    assert registered.queries()["separation"](spark, "/root/testdata/sf0.001").count() == 2
