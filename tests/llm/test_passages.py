"""Verification of many candidate groups at a time."""

import random
import time

import numpy as np
import pytest

from tarnwork.llm import common, passages


def some_groups(seed, groups, words=40):
    """(group, unit, body): a few families of near copies and unlike ones in each."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        bases = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.choice([3, 5, 12, 25]))) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(1, 9)):
            w = rng.choice(bases).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
            rows.append((g, len(rows), " ".join(w).encode()))
    return rows


def joined(rows, links):
    forest = common.Forest()
    for a, b in links:
        forest.link(a, b)
    return [forest.root(u) for _, u, _ in rows]


def every_link(rows):
    sets, last = {}, {}
    for g, u, body in rows:
        w = body.split()
        sets[u] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        last.setdefault(g, []).append(u)
    return [(a, b) for units in last.values() for a in units for b in units if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("seed,most", [(1, 1_000_000), (2, 1_000_000), (3, 5)])
def test_groups_verified_together_equal_all_pairs(seed, most, monkeypatch):
    monkeypatch.setattr(passages, "PAIRS", most)
    rows = some_groups(seed, 300)
    found = passages.similar_in_groups(np.array([g for g, _, _ in rows]), *passages.shingle_sets([b for _, _, b in rows]), 0.8)
    assert joined(rows, found) == joined(rows, every_link(rows)) and len(set(joined(rows, found))) < len(rows)


def test_groups_over_several_batches_equal_all_pairs(spark):
    rows = some_groups(4, 60)
    df = spark.createDataFrame(rows, "group long, unit long, body binary").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = [tuple(r) for r in passages._links_in_groups(df, "group", 0.8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert joined(rows, found) == joined(rows, every_link(rows))


def test_verification_takes_little_time_a_paragraph():
    rows = some_groups(5, 8000, 400)
    began = time.process_time()
    passages.similar_in_groups(np.array([g for g, _, _ in rows]), *passages.shingle_sets([b for _, _, b in rows]), 0.8)
    assert len(rows) > 35_000 and time.process_time() - began < 10  # one by one, 44,999 of check_l took 29.8 s


def test_keys_of_a_large_group_are_made_in_many_tasks(spark, monkeypatch):
    rows = [(1, i, f"the same words of all and the one more w{i}".encode()) for i in range(400)]
    assert (passages.whole([r[2] for r in rows])["last"] == np.arange(1, 401) * 10).all()
    # one partition holds the group, as after a join by it
    df = spark.createDataFrame(rows, "group long, unit long, body binary").repartition(1)
    plans = []
    real = passages._links_in_groups
    monkeypatch.setattr(passages, "_links_in_groups", lambda d, g, s: plans.append((g, d)) or real(d, g, s))
    passages.verified_links(df, 3, block=100, tasks=4)
    keyed = dict(plans)["key"]
    text = keyed._jdf.queryExecution().toString()
    assert "hashpartitioning(unit" in text and keyed.count() == 1200
