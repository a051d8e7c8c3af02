"""Queries of decision lists, suggestions, readiness and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import decisions as D
from ..operators import retrieval
from ..operators.relational import top_k_per
from ..sources.tables import table
from .registry import query
from .retrieval import _vectors

STOPWORDS = ["that", "this", "with", "from", "nicht", "wird", "dans", "pour", "para", "como"]
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_EVERY = "list_filter(list_transform(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z0-9-]{{3,}}'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: length(t) >= 4 AND t NOT IN " + _STOP + ")"
_ONCE = "list_filter(every, lambda x, i: list_position(every, x) = i)"
_TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z0-9-]{{3,}}'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: length(t) >= 4 AND t NOT IN " + _STOP + "))"


@query("""WITH c AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0 AS s, o_custkey % 4 AS n, o_totalprice / 500000 AS i FROM orders)
SELECT o_orderkey, CASE WHEN n >= CASE WHEN i > 0.7 THEN 2 ELSE 1 END AND s >= CASE WHEN i > 0.7 THEN 0.7 WHEN i > 0.4 THEN 0.6 ELSE 0.5 END THEN 'strong' WHEN n >= 1 OR s >= 0.6 THEN 'moderate' WHEN s >= 0.4 THEN 'weak' ELSE 'missing' END AS strength FROM c""")
def strength_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.citation_strength((F.col("o_orderkey") % 101) / 100, F.col("o_custkey") % 4, F.col("o_totalprice") / 500000).alias("strength"))


_SUGGEST = """p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.vec_id // 5 AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM p), top AS (SELECT query_id, doc_id, s FROM k WHERE r <= 20 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r) = 1),
y AS (SELECT *, CASE WHEN doc_id % 7 > 0 THEN 2005 + doc_id % 20 END AS year, (query_id // 100) % 3 AS cited FROM top),
b AS (SELECT *, least(1.0, s + CASE WHEN 2024 - year <= 5 THEN 0.1 * (5 - (2024 - year)) / 5 ELSE 0 END) AS conf FROM y),
t AS (SELECT *, CASE WHEN cited = 0 THEN 'missing_citation' WHEN cited = 1 AND s > 0.8 THEN 'alternative_source' WHEN 2024 - year <= 5 THEN 'recent_work' WHEN 2024 - year > 10 AND s > 0.7 THEN 'foundational_work' ELSE 'alternative_source' END AS kind FROM b),
i AS (SELECT *, CASE WHEN kind = 'missing_citation' THEN CASE WHEN conf > 0.7 THEN 'critical' ELSE 'high' END WHEN kind = 'recent_work' AND conf > 0.8 THEN 'high' WHEN kind = 'foundational_work' AND conf > 0.75 THEN 'high' WHEN conf > 0.8 THEN 'high' WHEN conf > 0.6 THEN 'medium' ELSE 'low' END AS impact FROM t),
f AS (SELECT *, least(1.0, conf + CASE kind WHEN 'missing_citation' THEN 0.3 WHEN 'recent_work' THEN 0.15 WHEN 'foundational_work' THEN 0.1 ELSE 0.05 END + CASE impact WHEN 'critical' THEN 0.2 WHEN 'high' THEN 0.1 WHEN 'medium' THEN 0.05 ELSE 0 END) AS priority FROM i)"""


@query(f"WITH {_SUGGEST} SELECT query_id, doc_id, kind, impact, round(conf, 6) AS confidence, round(priority, 6) AS priority FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(priority, 9) DESC, doc_id) <= 10")
def citation_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Twenty nearest chunks of each query, the best of each document, with recency, type, impact and priority; the ten best."""
    q, c = _vectors(spark, d)
    near = retrieval.knn(q, c, 20).select("query_id", F.floor(F.col("chunk_id") / 5).alias("doc_id"), F.col("similarity").alias("s"), "rank")
    first = near.groupBy("query_id", "doc_id").agg(F.min_by("s", "rank").alias("s"))
    year, now, cited = F.when(F.col("doc_id") % 7 > 0, 2005 + F.col("doc_id") % 20), F.lit(2024), F.floor(F.col("query_id") / 100) % 3
    rows = first.withColumn("confidence", F.least(F.lit(1.0), F.col("s") + D.recency_bonus(year, now))).withColumn("kind", D.suggestion_type(cited, year, F.col("s"), now))
    rows = rows.withColumn("impact", D.impact_level(F.col("confidence"), F.col("kind"))).withColumn("priority", F.round(D.priority_score(F.col("confidence"), F.col("kind"), F.col("impact")), 9))
    best = top_k_per(rows, ["query_id"], [F.desc("priority"), F.asc("doc_id")], 10)
    return best.select("query_id", "doc_id", "kind", "impact", rounded("confidence").alias("confidence"), rounded("priority").alias("priority"))


@query(f"WITH {_SUGGEST} SELECT query_id, doc_id, round(max(s), 6) AS similarity FROM k WHERE r <= 20 GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, doc_id) <= 3")
def gap_suggest(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of each gap by their best chunk among the twenty nearest."""
    q, c = _vectors(spark, d)
    near = retrieval.knn(q, c, 20).groupBy("query_id", F.floor(F.col("chunk_id") / 5).alias("doc_id")).agg(F.max("similarity").alias("similarity"))
    return top_k_per(near, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], 3).select("query_id", "doc_id", rounded("similarity").alias("similarity"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END * CASE o_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END + CASE WHEN o_custkey % 3 > 0 THEN 0.5 ELSE 0.0 END AS score FROM orders""")
def gap_priority(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "5-LOW", "low")
    kind = F.element_at(F.array(F.lit("missing_seminal"), F.lit("theoretical_gap"), F.lit("methodology_gap"), F.lit("other")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.gap_priority(priority, kind, F.col("o_custkey") % 3).alias("score"))


@query("""WITH t AS (SELECT l_orderkey AS draft, CASE WHEN l_linenumber = 1 AND l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'major' ELSE 'minor' END AS severity, l_returnflag = 'R' AND l_discount = 0 AS unsourced FROM lineitem),
c AS (SELECT draft, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (unsourced) AS unsourced FROM t GROUP BY draft),
s AS (SELECT *, greatest(0, least(100, CAST(round_even(100 - (critical * 8 + major * 3.5 + minor + unsourced * 3), 0) AS INT))) AS raw, CASE WHEN critical >= 3 OR major >= 8 THEN 'critical_or_major_volume' WHEN critical > 0 THEN 'critical_issue_present' END AS guardrail FROM c),
f AS (SELECT *, CASE WHEN guardrail = 'critical_or_major_volume' THEN least(raw, 69) WHEN guardrail IS NOT NULL THEN least(raw, 84) ELSE raw END AS score FROM s)
SELECT draft, score, guardrail, CASE WHEN score >= 85 THEN 'Strong Submission' WHEN score >= 70 THEN 'Minor Revisions' WHEN score >= 50 THEN 'Needs Work' ELSE 'Major Revisions' END AS verdict FROM f""")
def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    """Orders as drafts, their items as tasks."""
    severity = F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 45), "critical").when(F.col("l_quantity") > 35, "major").otherwise("minor")
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft"), severity.alias("severity"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)).alias("unsourced"))
    counts = tasks.groupBy("draft").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")], F.count_if("unsourced").alias("unsourced"))
    score, guard, verdict = D.readiness(F.col("critical"), F.col("major"), F.col("minor"), F.col("unsourced"), "scientific_empirical")
    return counts.select("draft", score.alias("score"), guard.alias("guardrail"), verdict.alias("verdict"))


def _section_sql() -> str:
    scores = []
    for i, (kind, words) in enumerate(D.SECTION_WORDS.items()):
        points = " + ".join(f"CASE WHEN clean = '{w}' THEN 10 WHEN contains(clean, '{w}') THEN 5 WHEN hint <> '' AND contains(hint, '{w}') THEN 3 ELSE 0 END" for w in words)
        scores.append(f"SELECT id, {i} AS place, '{kind}' AS kind, {points} AS points FROM titles")
    direct = " ".join(f"WHEN '{h}' THEN '{k}'" for h, k in D.SECTION_HINTS.items())
    return f"""WITH titles AS (SELECT p_partkey AS id, regexp_replace(trim(lower({_TITLE})), '^[\\d.\\s]+', '') AS clean, CASE WHEN p_partkey % 4 = 0 THEN lower({_HINT}) ELSE '' END AS hint FROM part),
scores AS ({' UNION ALL '.join(scores)}), best AS (SELECT id, arg_max(kind, points * 100 - place) AS kind, max(points) AS points FROM scores GROUP BY id)
SELECT id, coalesce(CASE hint {direct} END, CASE WHEN points >= 3 THEN kind END, 'introduction') AS section FROM titles JOIN best USING (id)"""


_HEADINGS = ["3. Methods and Materials", "Related Work", "Results", "2.1 Background", "Discussion of findings", "Conclusion", "Bibliography", "Acknowledgements", "Experimental setup", "Summary"]
_HINTS = ["methods", "conclusions", "body text", "data analysis"]
_TITLE = "list_extract([" + ", ".join(f"'{h}'" for h in _HEADINGS) + "], CAST(p_size % 10 + 1 AS INT)) || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE '' END"
_HINT = "list_extract([" + ", ".join(f"'{h}'" for h in _HINTS) + "], CAST(p_partkey % 16 // 4 + 1 AS INT))"


@query(_section_sql())
def section_detect(spark: SparkSession, d: str) -> DataFrame:
    """Parts' sizes choose a heading, every fourth has a hint."""
    number = F.col("p_partkey")
    title = F.concat(F.element_at(F.array(*[F.lit(h) for h in _HEADINGS]), (F.col("p_size") % 10 + 1).cast("int")), F.when(number % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    hint = F.when(number % 4 == 0, F.element_at(F.array(*[F.lit(h) for h in _HINTS]), (F.floor(number % 16 / 4) + 1).cast("int")))
    return table(spark, d, "part").select(number.alias("id"), D.section_type(title, hint).alias("section"))


@query(f"""WITH q AS (SELECT conv_id, {_ONCE} AS qt FROM (SELECT conv_id, {_EVERY.format(t='text')} AS every FROM conversations WHERE turn = 0)), r AS (SELECT conv_id, turn, {_TERMS.format(t='text')} AS rt, ((conv_id * 7 + turn * 13) % 50 + 50) / 100.0 AS s FROM conversations WHERE turn > 0),
j AS (SELECT conv_id, turn, s, len(list_intersect(rt, qt)) AS nq, len(list_intersect(rt, list_slice(qt, 1, 3))) AS np, len(qt) AS q, len(list_slice(qt, 1, 3)) AS p FROM r JOIN q USING (conv_id))
SELECT conv_id, turn, (q = 0 AND p = 0) OR NOT ((s < 0.72 AND nq = 0) OR (p > 0 AND s < 0.82 AND np = 0 AND nq < 2)) AS kept FROM j""")
def domain_contamination_filter(spark: SparkSession, d: str) -> DataFrame:
    """Later turns as results of the first turn; its first three terms are the manuscript's profile."""
    c = table(spark, d, "conversations").withColumn("terms", D.meaningful_terms(F.col("text"), STOPWORDS))
    asked = c.where("turn = 0").select("conv_id", F.col("terms").alias("asked"), F.slice("terms", 1, 3).alias("profile"))
    found = c.where("turn > 0").join(asked, "conv_id")
    similarity = ((F.col("conv_id") * 7 + F.col("turn") * 13) % 50 + 50) / 100
    return found.select("conv_id", "turn", D.passes_domain(similarity, F.col("asked"), F.col("profile"), F.col("terms")).alias("kept"))


@query(f"""WITH t AS (SELECT doc_id, {_ONCE} AS w FROM (SELECT doc_id, {_EVERY.format(t='text')} AS every FROM documents)) SELECT doc_id, len(w) AS n_terms, sha256(array_to_string(w, ' ')) AS terms_sha256, len(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 5), lambda x: x[1:5]))) AS n_stems FROM t""")
def meaningful_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", D.meaningful_terms(F.col("text"), STOPWORDS).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_terms"), F.sha2(F.array_join("w", " "), 256).alias("terms_sha256"), F.size(D.prefix_stems(F.col("w"))).alias("n_stems"))


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS anchor, b.text AS critique FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, anchor, list_distinct(list_transform(list_filter({_TERMS.format(t='critique')}, lambda x: length(x) >= 5), lambda x: x[1:5])) AS w, list_distinct(list_transform(list_filter({_TERMS.format(t='anchor')}, lambda x: length(x) >= 5), lambda x: x[1:5])) AS h FROM p)
SELECT conv_id, turn, trim(coalesce(anchor, '')) <> '' AND len(w) > 0 AND (len(list_intersect(w, h)) >= len(w) * 0.5 OR len(list_intersect(w, h)) >= 3) AS contradicts FROM s""")
def self_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """A turn as the quotation of a task, the next as its critique."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("anchor"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("anchor").alias("critique"))
    return turns.join(later, ["conv_id", "turn"]).select("conv_id", "turn", D.self_contradicts(F.col("anchor"), F.col("critique"), STOPWORDS).alias("contradicts"))


_EDGE = "regexp_replace(lower(w), '^[.,;:?!()\\[\\]{}]+|[.,;:?!()\\[\\]{}]+$', '', 'g')"


@query(f"""WITH e AS (SELECT doc_id, list_transform(list_filter(list_concat(regexp_split_to_array(source, '\\s+'), regexp_split_to_array(coalesce(text, ''), '\\s+')), lambda w: length(w) > 3), lambda w: {_EDGE}) AS every FROM documents), k AS (SELECT doc_id, {_ONCE} AS w FROM e)
SELECT doc_id, len(w) AS n, array_to_string(w[1:5], ',') AS first_group, CASE WHEN len(w) > 5 THEN array_to_string(w[6:10], ',') END AS second_group, CASE WHEN len(w) > 10 THEN array_to_string(w[11:15], ',') END AS third_group FROM k""")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of source and text, and their first groups of five."""
    k = table(spark, d, "documents").select("doc_id", D.keywords(F.array("source", "text")).alias("w")).withColumn("g", D.keyword_groups(F.col("w")))
    group = lambda i: F.array_join(F.get("g", F.lit(i)), ",")
    return k.select("doc_id", F.size("w").alias("n"), group(0).alias("first_group"), group(1).alias("second_group"), group(2).alias("third_group"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 5 OR coalesce(value / 100, 0) >= 0.65 THEN true ELSE false END AS claim_kept, event_type <> 'view' AS feedback_kept,
CASE WHEN event_type = 'error' THEN 'desk_reject' WHEN value < 5 THEN 'halt' ELSE 'methods,clarity,novelty' END AS route FROM events""")
def claim_routing(spark: SparkSession, d: str) -> DataFrame:
    """Events as claims and feedback: what is actionable, and where a run goes next."""
    needs = F.when(F.col("event_type") == "purchase", F.col("value") > 5)
    kind = F.when(F.col("event_type") == "view", "strength").otherwise(F.col("event_type"))
    steps = D.route(F.col("event_type") == "error", F.col("value") < 5, ["methods", "clarity", "novelty"])
    return table(spark, d, "events").select(
        "event_id", D.actionable_claim(needs, F.col("value") / 100).alias("claim_kept"), D.actionable_feedback(kind).alias("feedback_kept"), F.array_join(steps, ",").alias("route"))


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS used, max(ts) AS last FROM events GROUP BY ALL)
SELECT user_id, event_type, used, CASE WHEN user_id % 25 = 0 OR event_type = 'view' THEN 'allowed' WHEN last <= TIMESTAMP '2024-01-29 00:00:00' THEN 'reset' WHEN used >= CASE event_type WHEN 'click' THEN 12 WHEN 'purchase' THEN 15 ELSE 14 END THEN 'exceeded' ELSE 'allowed' END AS state,
CASE WHEN event_type <> 'view' THEN greatest(0, CASE event_type WHEN 'click' THEN 12 WHEN 'purchase' THEN 15 ELSE 14 END - used) END AS remaining FROM u""")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    """Events used by user and kind against the plan's limits; a last use before the 29th begins a new period."""
    limits = spark.createDataFrame([("click", 12), ("purchase", 15), ("signup", 14), ("error", 14)], "kind string, most int")
    used = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("used"), F.max("ts").alias("last"))
    j = used.join(F.broadcast(limits), F.col("event_type") == F.col("kind"), "left")  # four rows
    state = D.quota_state(F.col("used"), F.col("most"), F.col("last"), F.to_timestamp(F.lit("2024-01-29 00:00:00")), F.col("user_id") % 25 == 0)
    return j.select("user_id", "event_type", "used", state.alias("state"), F.when(F.col("most").isNotNull(), F.greatest(F.lit(0), F.col("most") - F.col("used"))).alias("remaining"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) WHEN o_orderkey % 3 = 1 THEN 1900 + o_custkey % 100 END AS year, sha256(coalesce(o_orderstatus, '') || chr(0) || o_custkey || chr(0) || chr(0)) AS hash,
CAST(o_custkey % 90 AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END AS number, CAST(ceil((o_custkey % 90) / 10) AS INT) AS band, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_custkey AS DOUBLE) END AS metric FROM orders""")
def value_rules(spark: SparkSession, d: str) -> DataFrame:
    """Years, hashes, leading numbers, bands and metrics of JSON text, from the orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year = D.first_year(F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 3 == 1, F.concat(F.lit("in print "), (1900 + c % 100).cast("string"), F.lit("; 17"))))
    said = F.concat((c % 90).cast("string"), F.when(k % 2 == 0, ".5 of ten").otherwise(" points"))
    metric = F.when(k % 5 == 0, "true").when(k % 5 == 1, "NaN").otherwise(c.cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", year.alias("year"), D.stable_hash(F.col("o_orderstatus"), c, F.lit(None)).alias("hash"), D.first_number(said, 0.0).alias("number"), D.tolerance_band(c % 90).alias("band"), D.metric_number(metric).alias("metric"))


@query("""WITH n AS (SELECT c_nationkey, list(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE '  ' || c_mktsegment END ORDER BY c_custkey) AS l FROM customer GROUP BY c_nationkey),
p AS (SELECT c_nationkey, trim(unnest(l)) AS name, generate_subscripts(l, 1) AS i FROM n), f AS (SELECT c_nationkey, arg_min(name, i) AS name, min(i) AS i FROM p GROUP BY c_nationkey, lower(name))
SELECT c_nationkey, string_agg(name, ',' ORDER BY i) AS names FROM f GROUP BY c_nationkey""")
def normalise_authors(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers' segments as author names, some in capitals, some with spaces."""
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("  "), "c_mktsegment"))
    first = c.groupBy("c_nationkey", F.lower(F.trim(name)).alias("k")).agg(F.min(F.struct("c_custkey", name.alias("name"))).alias("first"))  # repeats go before any list is made
    names = first.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["name"]).alias("names"))
    return names.select("c_nationkey", F.array_join(D.distinct_names(F.col("names")), ",").alias("names"))


@query("""SELECT a.conv_id, CASE WHEN trim(coalesce(a.text, '')) <> '' THEN sha256(a.text) WHEN trim(coalesce(b.text, '')) <> '' THEN sha256(b.text) END AS text_sha256, CASE WHEN trim(coalesce(b.role, '')) <> '' THEN b.role ELSE a.role END AS status
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0""")
def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first turn filled from its second; the status is always the newer one's."""
    c = table(spark, d, "conversations")
    later = c.where("turn = 1").select("conv_id", F.col("role").alias("role_b"), F.col("text").alias("text_b"))
    j = c.where("turn = 0").join(later, "conv_id", "left")
    text = D.filled(F.col("text"), F.col("text_b"))
    return j.select("conv_id", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.sha2(text, 256)).alias("text_sha256"), D.filled(F.col("role"), F.col("role_b"), overwrite=True).alias("status"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT source, doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '...' END AS excerpt FROM s WHERE place = 1""")
def excerpt_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each source, as an excerpt of 300 characters."""
    first = table(spark, d, "documents").groupBy("source").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    text = F.col("f.text")
    return first.select("source", "f.doc_id", F.when(F.length(text) <= 300, text).otherwise(F.concat(F.substring(text, 1, 300), F.lit("..."))).alias("excerpt"))


@query(f"""WITH q AS (SELECT item_id, {_TERMS.format(t='text')} AS qt FROM benchmark), p AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS para FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, pos, {_TERMS.format(t='para')} AS pt FROM p), s AS (SELECT item_id, doc_id, pos, len(list_intersect(qt, pt)) / len(qt) AS score FROM q JOIN t ON len(qt) > 0 AND len(list_intersect(qt, pt)) / len(qt) >= 0.5)
SELECT item_id, doc_id, arg_min(pos, pos) FILTER (score = best) AS paragraph, round(max(score), 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item_id, doc_id) AS best FROM s) GROUP BY item_id, doc_id""")
def bm25_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph of a document that has most of an item's terms, half of them at least; of equal ones the first."""
    items = table(spark, d, "benchmark").select("item_id", D.meaningful_terms(F.col("text"), STOPWORDS).alias("t")).where("size(t) > 0").select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    paragraphs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "para"))
    said = paragraphs.select("doc_id", (F.col("pos") + 1).alias("pos"), F.explode(D.meaningful_terms(F.col("para"), STOPWORDS)).alias("term"))
    met = said.join(items, "term").groupBy("item_id", "doc_id", "pos", "n").agg((F.count("*") / F.col("n")).alias("score")).where("score >= 0.5")
    best = met.groupBy("item_id", "doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("before"))).alias("b"))
    return best.select("item_id", "doc_id", (-F.col("b.before")).alias("paragraph"), rounded("b.score").alias("score"))
