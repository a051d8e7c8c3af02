"""Nulls, empty tables and ties of decision lists, usage summaries, joins of labels and quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import gates, matching, relational, usage


def rows(df):
    return [tuple(r) for r in df.collect()]


def interpolated(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_values_at_places(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([rng.random(), 0.5, 2.0]), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = relational.values_at(df, "v", {"median": lambda k: (k - 1) / 2, "third": lambda k: (k - 1) / 3, "last": lambda k: k - 1}).first()
    assert got["median"] == pytest.approx(interpolated(values, 0.5)) and got["third"] == pytest.approx(interpolated(values, 1 / 3)) and got["last"] == max(values)
    assert relational.index_quantiles(df, [], "v", {"p": 0.9}).first()["p"] == sorted(values)[min(int(n * 0.9), n - 1)]


def test_values_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert rows(relational.values_at(none, "v", {"m": lambda k: (k - 1) / 2})) == [(None,)]
    assert rows(relational.index_quantiles(none.limit(0), [], "v", {"p": 0.5})) == [(None,)]


def test_cost_summary(spark):
    costs = spark.createDataFrame([(i, float(c)) for i, c in enumerate([4, 1, 3, 2, 10])], "user_id long, cost double")
    r = usage.cost_summary(costs).first()
    assert (r["users"], r["total"], r["mean"], r["median"], r["p90"], r["p95"]) == (5, 20.0, 4.0, 3.0, 10.0, 10.0)
    r = usage.cost_summary(costs.limit(0)).first()
    assert (r["users"], r["total"], r["median"]) == (0, None, None)


def test_load_summary(spark):
    data = [(0.0, 1.0, 1.0, None, True), (1.0, 2.0, 1.0, None, False), (2.0, 5.0, 3.0, None, False), (3.0, 4.0, 1.0, "timeout: x", False), (None, None, None, "io", False)]
    r = usage.load_summary(spark.createDataFrame(data, "scheduled double, finished double, response double, error string, warmup boolean"), 2.0).first()
    assert (r["offered"], r["warmup"], r["measured"], r["ok"], r["within_slo"], r["window"], r["p50"], r["p95"]) == (5, 1, 4, 2, 1, 4.0, 1.0, 3.0)
    kinds = usage.error_kinds(spark.createDataFrame(data, "scheduled double, finished double, response double, error string, warmup boolean"))
    assert set(rows(kinds)) == {("timeout", 1), ("io", 1)}


@pytest.mark.parametrize("most", [3, 10])
def test_grid(spark, most):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 9, 20)], "v double")
    got = sorted(r["t"] for r in gates.grid(df, "v", most).collect())
    assert got == ([1.0, 2.0, 5.0, 9.0, 20.0] if most == 10 else [1.0, 5.0, 20.0])
    assert gates.grid(df.limit(0), "v", most).count() == 0


def test_superseded_and_weighted_recall(spark):
    runs = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 2), ("b", "r3", 1), (None, "r4", 1)], "cell string, run string, at int")
    got = {r["run"]: (r["current"], r["superseded_by"]) for r in usage.superseded(runs, ["cell"], "run", ["at"]).collect()}
    assert got["r1"] == (False, "r2") and got["r2"] == (True, None) and got["r3"] == (True, None)
    units = spark.createDataFrame([("p", 2.0, True), ("p", 1.0, False), ("q", 0.0, True), ("q", None, None)], "paper string, weight double, matched boolean")
    got = {r["paper"]: (r["units"], r["recall"], r["plain"]) for r in usage.weighted_recall(units, ["paper"]).collect()}
    assert got == {"p": (2, pytest.approx(2 / 3), 0.5), "q": (2, None, 1.0)}


def test_topic_terms_ties_and_nulls(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta alpha gamma"), (2, None), (3, ""), (4, "the with")], "doc_id long, text string")
    got = rows(matching.topic_terms(docs, ["with"], 2).orderBy("doc_id", "rank"))
    assert got == [(1, "beta", 2, 1), (1, "alpha", 2, 2)]


def test_titled_takes_the_name_of_its_kind(spark):
    results = spark.createDataFrame([("doc", 1), ("web", 1), ("doc", 9), (None, 1)], "source_type string, source_id long")
    docs, web = (spark.createDataFrame([(1, t)], "id long, title string") for t in ("paper", "page"))
    got = {(r["source_type"], r["source_id"]): r["title"] for r in matching.titled(results, {"doc": docs, "web": web}).collect()}
    assert got == {("doc", 1): "paper", ("web", 1): "page", ("doc", 9): None, (None, 1): None}
    assert matching.titled(results.limit(0), {"doc": docs}).select(F.col("title")).count() == 0
