"""Small cases of what a review found: queries over tables made for them, and steps whose work grew faster than their input."""

import random
from collections import defaultdict
from datetime import datetime
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as registered
from tarnwork.operators import anchors, consolidation, retrieval, spans, textindex
from tarnwork.streaming import sessions


def of(spark, folder, name, **tables):
    """A query's rows over these tables, and its SQL's."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.to_parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = {tuple(r) for r in registered.queries()[name](spark, str(folder)).collect()}
    return got, set(con.sql(registered.oracle_sql()[name]).fetchall())


def test_scores_round_as_in_sql(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": range(6), "n_chars": [2300, 1140, 2320, 20, 4100, 580]})
    labels = pd.DataFrame({"doc_id": range(6), "quality": [1, 0, 1, 0, 1, 0], "toxic": 0})
    got, want = of(spark, tmp_path, "pr_curve", documents=docs, labels=labels)
    assert got == want and 0.57 in {r[0] for r in got}


def test_every_tenth_vector_meets_its_group(spark, tmp_path):
    vectors = pd.DataFrame({"vec_id": range(12), "label": [1] * 12, "embedding": [[1.0, 0.1 * i] for i in range(12)]})
    got, want = of(spark, tmp_path, "within_group_cross_join", embeddings=vectors)
    assert got == want and {r[1] for r in got} == {0, 10}


def parts(names, every=1):
    n = len(names)
    return pd.DataFrame({"p_partkey": [100 * i if i % every == 0 else 100 * i + 1 for i in range(n)], "p_name": names, "p_brand": ["b1"] * n, "p_type": ["T"] * n, "p_size": [3] * n, "p_retailprice": [1.0] * n})


def test_copies_of_titles_are_members_not_pairs(spark, tmp_path):
    names = ["red old ring", "old ring red"] * 40 + ["red old ring of", "blue bolt", None, ""]
    for name in ("title_jaccard", "title_max_similarity"):
        got, want = of(spark, tmp_path, name, part=parts(names))
        assert got == want and len([r for r in got if r[0] == "member"]) == 82 and len(got) < 90  # 80 copies are 6,320 pairs


def test_wording_classes_say_all_pairs(spark):
    texts = {i: t for i, t in enumerate(["a large red ring", "a large red rings", "blue bolt", None, ""] * 12)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = {(r["left_id"], r["right_id"]) for r in consolidation.similar_wordings(df.where("id % 10 = 0"), df, 0.82).collect()}
    rows = consolidation.wording_classes(df.where("id % 10 = 0"), df, 0.82).collect()
    of_class, links = defaultdict(set), {(r["left_id"], r["right_id"]) for r in rows if r["kind"] == "link"}
    for r in rows:
        if r["kind"] == "member":
            of_class[r["left_id"]].add(r["right_id"])
    said = {(i, j) for a, ids in of_class.items() for b, others in of_class.items() if a == b or (a, b) in links for i in ids if i % 10 == 0 for j in others if i != j}
    assert said == pairs and len(links) == 1 and len(rows) == 37


def some_tasks(n):
    rng = random.Random(4)
    return [("d", i, rng.choice(["large red ring", "red large rings", "blue bolt", "", None]), "x", rng.choice(["1", "2"]), "k", None, i % 11 == 5) for i in range(n)]


def compared(monkeypatch, name):
    """The numbers of rows that go into the comparison of pairs from now on."""
    seen, whole = [], getattr(consolidation, name)
    monkeypatch.setattr(consolidation, name, lambda rows, *a, **k: seen.append(rows.count()) or whole(rows, *a, **k))
    return seen


def fitted(rows, same):
    leader, leaders = {}, []
    for t in rows:
        t = dict(zip(("draft", "id", "text", "anchor", "section", "kind", "family", "pinned"), t))
        found = next((x["id"] for x in leaders if t["text"] and x["text"] and same(t, x)), None)
        leader[t["id"]] = t["id"] if t["pinned"] or found is None else found
        if leader[t["id"]] == t["id"]:
            leaders.append(t)
    return leader


def test_tasks_that_say_the_same_are_compared_once(spark, monkeypatch):
    rows, seen = some_tasks(300), compared(monkeypatch, "task_links")
    df = spark.createDataFrame(rows, "draft string, id long, text string, anchor string, section string, kind string, family string, pinned boolean")
    for merge, same in ((consolidation.consolidate, consolidation.should_merge), (consolidation.last_pass, consolidation.still_the_same)):
        assert {r["id"]: r["leader"] for r in merge(df, "draft").collect()} == fitted(rows, same)
    texts = sum(not t[2] for t in rows)
    assert seen[0] <= 12 + texts and seen[1] <= 6 + texts


def test_critiques_that_say_the_same_are_compared_once(spark, monkeypatch):
    rng = random.Random(8)
    words = ["report the missing sample size of it", "report the missing sample size of them", "size missing", None]
    rows = [("p", i, rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", None]), rng.choice(words)) for i in range(200)]
    seen = compared(monkeypatch, "critique_links")
    kept = {r["id"] for r in consolidation.own_critiques(spark.createDataFrame(rows, "paper string, id long, reviewer string, lane string, text string"), "paper").collect()}

    def goes(i, who, lane, text):
        like = [x[2] for x in rows if text and x[4] and x[2] and who and x[2] != who and (SequenceMatcher(None, text, x[4]) if x[1] < i else SequenceMatcher(None, x[4], text)).ratio() > 0.85]
        return any(w > who for w in like) if lane is None else who != lane and lane in like

    assert kept == {i for _, i, who, lane, text in rows if not goes(i, who, lane, text)} and len(kept) < 200 and seen == [3]


def test_limits_have_a_group_a_bucket_and_window(spark, tmp_path):
    rows = [(k, 10 * k + i, datetime(2024, 1, 1 + k % 2, 0, i % 3)) for k in range(400) for i in range(5)]
    for n, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(part, "key long, event_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("key long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    passed = sessions.gathered(sessions.limited(stream, 3, 86_400, buckets=4), f"{tmp_path}/s", mode="append").collect()
    taken = defaultdict(list)
    for part in (rows[::2], rows[1::2]):
        for k, i, ts in sorted(part, key=lambda r: (r[2], r[1])):
            if len(taken[k]) < 3:
                taken[k].append(i)
    got = defaultdict(set)
    for r in passed:
        got[r["key"]].add(r["event_id"])
    assert len(passed) == 1200 and got == {k: set(v) for k, v in taken.items()}


def test_index_and_its_readers_hold_few_rows(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40000)}" for _ in range(900))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    seen = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = textindex.text_index(docs)
    for file in {f.replace("file://", "") for f in index.inputFiles()}:
        meta = pq.ParquetFile(file).metadata
        seen += [meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)]
    assert max(seen) < 3 * textindex.GROUP_BYTES and sum(seen) > 2 * textindex.GROUP_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_neighbours_slice_by_slice(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (3000, 3)).astype(float)  # many ties
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>").coalesce(1)
    q = c.where("chunk_id % 500 = 0").withColumnRenamed("chunk_id", "query_id")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    for least in (None, 0.9):
        got = {(r["query_id"], r["rank"]): round(r["similarity"], 9) for r in retrieval.knn(q, c, 5, least).collect()}
        want = {}
        for i in range(0, 3000, 500):
            s = sorted((s for s in np.round(unit @ unit[i], 9).tolist() if least is None or s >= least), reverse=True)[:5]
            want |= {(i, n + 1): s[n] for n in range(len(s))}
        assert got == want


def test_values_of_ancestors_are_found_together(spark):
    rows = [("t", i, i - 1 if i else None, "p" if i == 0 else None, f"d{i}" if i % 7 == 3 else None) for i in range(40)] + [("u", 1, 2, None, "x"), ("u", 2, 1, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, paper string, draft string")
    got = {(r["trace_id"], r["span_id"]): (r["parent_id"], r["paper"], r["draft"]) for r in spans.nearest_values(df, {"paper": F.col("paper"), "draft": F.col("draft")}, ["parent_id"]).collect()}
    want = {("t", i): (i - 1 if i else None, "p", next((f"d{j}" for j in range(i, -1, -1) if j % 7 == 3), None)) for i in range(40)}
    assert got == want | {("u", 1): (2, None, "x"), ("u", 2): (1, None, "x")}


def test_citations_go_out_in_bounded_batches_and_once_a_text():
    text = "".join(f"[{i}] [{i % 5}] Smith ({1900 + i % 90}) " for i in range(20_000))
    out = list(anchors.citation_rows(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
    assert max(b.num_rows for b in out) <= anchors.CITATION_ROWS and sum(b.num_rows for b in out) == 20_090


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_grouped_where_their_text_is(spark):
    for name in ("abstract_rebuild", "topic_terms"):
        assert plan_of(registered.queries()[name](spark, "/root/testdata/sf0.001")).count("Exchange") == 1


def test_texts_are_made_normal_once(spark):
    titles = plan_of(registered.queries()["section_detect"](spark, "/root/testdata/sf0.001"))
    assert titles.count("regexp_replace") <= 2
    assert "regexp_replace" not in plan_of(registered.queries()["merge_anchor_collisions"](spark, "/root/testdata/sf0.001"))


def final_dedup(rows):
    """The loop over survivors, which change when a stronger task joins: (leader, first) of each task, (duplicate_count, related_anchors) of each survivor."""
    survivors = []
    for t in rows:
        for i, keep in enumerate(survivors):
            if t["draft"] == keep["draft"] and t["text"] and keep["text"] and consolidation.still_the_same(t, keep):
                rank = lambda x: (x["severity"] or 0, x["page"] is not None, len(x["action"] or ""))
                stronger, weaker = (t, keep) if rank(t) > rank(keep) else (keep, t)
                anchors = list(stronger.get("anchors", []))
                anchors += [weaker["anchor"]] if weaker["anchor"] and weaker["anchor"] not in anchors else []
                survivors[i] = dict(stronger) | {"anchors": anchors, "ids": [*keep.get("ids", [keep["id"]]), t["id"]]}
                break
        else:
            survivors.append(t)
    of = {i: (s["id"], s.get("ids", [s["id"]])[0]) for s in survivors for i in s.get("ids", [s["id"]])}
    return of, {s["id"]: (len(s.get("ids", [0])) - 1, s.get("anchors", [])) for s in survivors}


def test_last_pass_keeps_the_stronger_task(spark):
    rng = random.Random(6)
    schema = "draft string, id long, text string, anchor string, section string, kind string, family string, pinned boolean, severity double, page int, action string"
    names = [x.split()[0] for x in schema.split(", ")]
    texts = ["report the old size", "report the cold size", "report the gold sizes", "report a bold size", "retort the cold size", "size", "", None, "add a missing control to it", "add the missing control to it"]
    some = lambda *values: rng.choice(values)
    rows = [(some("d", "e", None), 1 << 60 | i, some(*texts), some("", None, "p", "q", "r"), some("1", "2", None), some("a", "b", None), some("f", None, None), some(None, False, False, False, True) if i % 3 else False, some(None, 0.0, 1.0, 2.0), some(3, None), some("x", "longer", None)) for i in range(400)]
    got = consolidation.strongest_pass(spark.createDataFrame(rows, schema).repartition(5), "draft", 3).collect()
    of, survivors = final_dedup([dict(zip(names, r)) for r in rows])
    assert {r["id"]: (r["leader"], r["first"]) for r in got} == of and len(got) == 400
    assert {r["id"]: (r["duplicate_count"], r["related_anchors"]) for r in got if r["id"] == r["leader"]} == survivors
    still = consolidation.last_pass(spark.createDataFrame(rows, schema).select(*names[:8]), "draft").collect()
    assert sum(i != first for i, first in of.values()) > 5 and {r["id"]: r["leader"] for r in still} != {i: first for i, (_, first) in of.items()}
    assert all(r["duplicate_count"] is None for r in got if r["id"] != r["leader"])


def test_final_pairwise_dedup_equals_the_loop(spark, tmp_path):
    rng = random.Random(2)
    n = 600
    part = pd.DataFrame({"p_partkey": range(n), "p_name": [rng.choice(["old", "cold", "hot"]) + " " + rng.choice(["ring", "gear"]) for _ in range(n)], "p_brand": [rng.choice("xy") for _ in range(n)], "p_type": [rng.choice(["LARGE", "SMALL", "ECONOMY"]) for _ in range(n)], "p_size": np.array([rng.randrange(1, 30) for _ in range(n)], np.int32), "p_retailprice": [900 + rng.randrange(1000) / 10 for _ in range(n)]})
    part.to_parquet(f"{tmp_path}/part.parquet")
    got = registered.queries()["final_pairwise_dedup"](spark, str(tmp_path)).collect()
    rows = [{"draft": p.p_brand, "id": p.p_partkey, "text": p.p_name, "anchor": p.p_type, "section": str(p.p_size), "kind": p.p_type, "family": f"{p.p_type}/{p.p_size}" if p.p_size % 10 == 0 else None, "pinned": p.p_partkey % 50 == 0,
             "severity": (p.p_retailprice // 25) % 4, "page": p.p_size if p.p_size % 3 else None, "action": p.p_type} for p in part.itertuples()]
    of, survivors = final_dedup(rows)
    assert {r["id"]: (r["leader"], r["first"]) for r in got} == of and len(got) == n
    assert {r["id"]: (r["duplicate_count"], r["related_anchors"]) for r in got if r["id"] == r["leader"]} == survivors


def test_every_vector_meets_its_group(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = pd.DataFrame({"vec_id": range(40), "label": [i % 3 if i else None for i in range(40)], "embedding": list(rng.normal(size=(40, 4)).round(3))})
    got, want = of(spark, tmp_path, "within_group_cross_join", embeddings=vectors)
    assert got == want and len({r[1] for r in got}) > 35 and {r[1] for r in got} == {r[2] for r in got}


def pairs_sql(name):
    """The SQL of all pairs of an asked title and any title, that the queries had before copies became members."""
    classes, least = registered.oracle_sql()[name].split("c AS MATERIALIZED")[0].rstrip(", \n"), {"title_jaccard": 0.6, "title_max_similarity": 0.72}[name]
    whole = {"title_jaccard": "len(list_distinct(list_concat(a.w, b.w)))", "title_max_similarity": "greatest(len(a.w), len(b.w))"}[name]
    score = f"len(list_intersect(a.w, b.w)) / {whole}"
    return f"{classes} SELECT a.id AS left_id, b.id AS right_id, round({score}, 6) AS similarity FROM t a, t b WHERE a.id % 100 = 0 AND len(a.w) > 0 AND len(b.w) > 0 AND {score} >= {least}"


def test_links_and_members_of_titles_say_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    names = [None if rng.random() < 0.05 else " ".join(rng.sample(["red", "old", "ring", "gear", "Steel", "the", "of", "x"], rng.randint(0, 6))) for _ in range(300)]
    ids = [100 * i if i % 3 == 0 else 100 * i + 7 for i in range(300)]
    for name in ("title_jaccard", "title_max_similarity"):
        got, want = of(spark, tmp_path, name, part=parts(names).assign(p_partkey=ids))
        members, links = defaultdict(set), {(a, b): s for kind, a, b, s in got if kind == "link"}
        for kind, a, b, _ in got:
            if kind == "member":
                members[a].add(b)
        said = {(i, j, s) for (a, b), s in [*links.items(), *(((a, a), 1.0) for a in members)] for i in members[a] if i % 100 == 0 for j in members[b]}
        pairs = set(duckdb.sql(pairs_sql(name).replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall())
        assert got == want and said == pairs and len(links) > 50 and len({i for i, _, _ in said}) > 70 and len(pairs) > 1000
