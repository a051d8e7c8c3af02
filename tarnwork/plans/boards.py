"""Queries of boards, pools, timelines and wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wording
from ..functions.columns import rounded
from ..operators import boards, records
from ..operators.relational import top_k_per
from ..sources.tables import table
from .registry import query


@query("""SELECT event_id, round(greatest(0.1, least(1.0, (1 - greatest(0.0, least(10.0, coalesce(value, 5.0))) / 10) * (greatest(1.0, least(5.0, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 3.0))) / 5) * CASE WHEN event_type = 'purchase' THEN 1.5 ELSE 1.0 END)), 4) AS weight FROM events""")
def severity_weight(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", rounded(boards.severity_weight(F.col("value"), k, F.col("event_type") == "purchase"), 4).alias("weight"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= n + 4 - 12""")
def pool_cap(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer's pool of 12: those to delete so that 4 new ones fit."""
    return boards.over_cap(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4, 12).select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS gap, CAST(o_custkey % 7 AS VARCHAR) AS topic FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT 'gap' AS context, gap AS name, id FROM s UNION ALL SELECT 'topic', topic, id FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY context, name ORDER BY id) AS position FROM e)
SELECT context, name, CAST(position AS INT) AS position, id FROM r WHERE position <= 3
UNION ALL SELECT 'summary', '', CAST(row_number() OVER (ORDER BY id) AS INT), id FROM (SELECT id FROM s ORDER BY id LIMIT 5)""")
def group_by_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "dismissed").otherwise("new").alias("status"), F.array("o_orderpriority").alias("gaps"),
        F.array((F.col("o_custkey") % 7).cast("string")).alias("topics"))
    return boards.grouped_by_context(rows, "o_orderkey", "status", {"gap": "gaps", "topic": "topics"})


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'P') AS b, max(o_orderdate) FILTER (o_orderstatus = 'F') AS w, max(o_orderdate) AS l FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN a <> b AND coalesce(l > w, false) THEN 'documents_changed_and_count_changed' WHEN a <> b THEN 'document_count_changed' WHEN l > w THEN 'documents_changed' END AS stale_reason FROM c""")
def insights_staleness(spark: SparkSession, d: str) -> DataFrame:
    status, done = F.col("o_orderstatus"), F.col("o_orderstatus") == "F"
    c = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(done).alias("a"), F.count_if(status != "P").alias("b"), F.max(F.when(done, F.col("o_orderdate"))).alias("w"), F.max("o_orderdate").alias("l"))
    return c.select("o_custkey", boards.staleness(F.col("a"), F.col("b"), F.col("w"), F.col("l")).alias("stale_reason"))


@query("""WITH s AS (SELECT user_id, max({'a': ts, 'b': event_id}) FILTER (event_type <> 'error') AS s FROM events GROUP BY user_id),
f AS (SELECT e.user_id, count(*) AS failures, max_by(props, {'a': ts, 'b': event_id}) AS last_error FROM events e JOIN s ON s.user_id = e.user_id WHERE event_type = 'error' AND (s.s IS NULL OR {'a': ts, 'b': event_id} > s.s) GROUP BY e.user_id)
SELECT user_id, coalesce(failures, 0) AS failures, last_error FROM s LEFT JOIN f USING (user_id)""")
def degradation_flag(spark: SparkSession, d: str) -> DataFrame:
    return boards.failures_since_success(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "props")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, lower(trim(left(p_type, 80))) AS pattern FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
m AS (SELECT o_custkey FROM f GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 3),
c AS (SELECT o_custkey, pattern, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS versions FROM f SEMI JOIN m USING (o_custkey) GROUP BY o_custkey, pattern HAVING count(*) >= 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, pattern) AS INT) AS rank FROM c) WHERE rank <= 8""")
def recurring_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Customers as owners, orders as versions, the types of the ordered parts as findings."""
    found = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    found = found.join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    return boards.recurring_patterns(found, "o_custkey", "o_orderkey", "p_type").withColumn("versions", F.array_join("versions", ","))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, any_value(o_orderdate) AS made, CAST(greatest(0, 100 - 15 * count(*) FILTER (l_returnflag = 'R') - 8 * count(*) FILTER (l_returnflag = 'A') - 5 * count(*) FILTER (l_quantity > 45)) AS INT) AS health FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey)
SELECT o_custkey, o_orderkey, health, health - lag(health) OVER (PARTITION BY o_custkey ORDER BY made, o_orderkey) AS delta FROM v""")
def draft_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer's versions, returned items as critical, accepted ones as major, large ones as gaps; the change since the version before."""
    flag = F.col("l_returnflag")
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(boards.draft_health(F.count_if(flag == "R"), F.count_if(flag == "A"), F.count_if(F.col("l_quantity") > 45)).alias("health"))
    versions = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(counts, F.col("l_orderkey") == F.col("o_orderkey"))
    before = F.lag("health").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return versions.select("o_custkey", "o_orderkey", "health", (F.col("health") - before).alias("delta"))


@query("""SELECT o_custkey, count(*) AS runs, round(arg_min(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}), 2) AS first, round(arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}), 2) AS last,
round(arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) - arg_min(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}), 2) AS delta FROM orders GROUP BY o_custkey HAVING count(*) >= 2""")
def node_deltas(spark: SparkSession, d: str) -> DataFrame:
    ends = boards.first_and_last(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return ends.select("o_custkey", "runs", *[rounded(c, 2).alias(c) for c in ("first", "last", "delta")])


@query("SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS n_eff FROM lineitem GROUP BY l_returnflag")
def kish_neff(spark: SparkSession, d: str) -> DataFrame:
    return boards.effective_sample(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").withColumn("n_eff", rounded("n_eff", 4))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 20")
def checkpoint_keyset(spark: SparkSession, d: str) -> DataFrame:
    return boards.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 500, 20)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id, event_type)
SELECT user_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, CAST(min(a) AS BIGINT) AS first_us, CAST(max(b) AS BIGINT) AS last_us FROM c GROUP BY user_id""")
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b"))
    spoken = F.array_sort(F.collect_list(F.concat("event_type", F.lit(":"), F.col("n").cast("string"))))
    return c.groupBy("user_id").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.array_join(spoken, ",").alias("counts"), F.min("a").alias("first_us"), F.max("b").alias("last_us"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS work, l_orderkey AS by FROM lineitem), g AS (SELECT work, count(*) AS cited FROM e GROUP BY work),
t AS (SELECT work, cited, CAST(row_number() OVER (ORDER BY cited DESC, work) AS INT) AS rank FROM g)
SELECT work, cited, rank, (SELECT round(avg(cited), 6) FROM g) AS mean_cited, (SELECT CAST(sum(cited) AS BIGINT) FROM g) AS total_citations, (SELECT count(*) FROM g) AS total_papers FROM t WHERE rank <= 5""")
def citation_graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite suppliers: the five most cited ones, with the mean and the totals of the graph."""
    cited = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("work"), F.col("l_orderkey").alias("by")).distinct().groupBy("work").agg(F.count("*").alias("cited"))
    mean = cited.agg(rounded(F.avg("cited")).alias("mean_cited"), F.sum("cited").alias("total_citations"), F.count("*").alias("total_papers"))
    best = cited.orderBy(F.desc("cited"), "work").limit(5).withColumn("all", F.lit(1))
    return top_k_per(best, ["all"], [F.desc("cited"), F.asc("work")], 5).drop("all").join(F.broadcast(mean))  # one row


_FINDING = "array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in wording.FINDING_STOPWORDS) + ")), ' ')"


@query(f"SELECT doc_id, sha256({_FINDING}) AS normal_sha256 FROM documents")
def normalise_task(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(wording.normal_finding(F.col("text")), 256).alias("normal_sha256"))


_TASKS = f"""tasks AS (SELECT doc_id, sha256({_FINDING}) AS key, len(string_split({_FINDING}, ' ')) >= 4 AND doc_id % 10 > 0 AS meets, ['critical', 'major', 'minor', 'suggestion'][doc_id % 4 + 1] AS severity, CASE WHEN doc_id % 3 > 0 THEN doc_id % 30 END AS page,
  lang || ' ' || source AS action, CASE WHEN doc_id % 5 > 0 THEN source || '-' || (doc_id % 6) ELSE lang END AS problem FROM documents),
ranked AS (SELECT *, CASE WHEN meets THEN key ELSE '#' || doc_id END AS k, 5 - list_position(['critical', 'major', 'minor', 'suggestion'], severity) AS rank FROM tasks),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank DESC, page IS NOT NULL DESC, length(coalesce(action, '')) DESC, doc_id) AS place, count(*) OVER (PARTITION BY k) AS n FROM ranked)"""


@query(f"""WITH {_TASKS}, kept AS (SELECT * FROM placed WHERE place = 1),
points AS (SELECT k, string_agg(problem, ',' ORDER BY first) AS points FROM (SELECT p.k, p.problem, min(p.doc_id) AS first FROM placed p JOIN kept USING (k) WHERE p.place > 1 AND p.problem <> '' AND NOT contains(coalesce(kept.action, ''), p.problem) GROUP BY ALL) GROUP BY k)
SELECT doc_id, severity, n - 1 AS duplicates, coalesce(points, '') AS points FROM kept LEFT JOIN points USING (k)""")
def merge_anchor_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tasks whose anchor is the whole text; every tenth is protected."""
    i = F.col("doc_id")
    tasks = table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("anchor"), F.element_at(F.array(*[F.lit(s) for s in records.SEVERITY_RANK]), (i % 4 + 1).cast("int")).alias("severity"), F.when(i % 3 > 0, i % 30).alias("page"),
        F.concat("lang", F.lit(" "), "source").alias("action"), F.when(i % 5 > 0, F.concat("source", F.lit("-"), (i % 6).cast("string"))).otherwise(F.col("lang")).alias("problem"), (i % 10 == 0).alias("protected"))
    return records.merge_anchor_collisions(tasks, "doc_id").select("doc_id", "severity", "duplicates", F.array_join("points", ",").alias("points"))


@query(f"SELECT doc_id, CAST(4 - doc_id % 4 AS INT) AS rank, CASE WHEN lag(4 - doc_id % 4) OVER o > 4 - doc_id % 4 OR (lag(4 - doc_id % 4) OVER o = 4 - doc_id % 4 AND length(lag(text) OVER o) >= length(text)) THEN 'before' WHEN lag(doc_id) OVER o IS NOT NULL THEN 'this' END AS stronger FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id)")
def pick_stronger(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one before it of its source, by severity and length."""
    i, o = F.col("doc_id"), Window.partitionBy("source").orderBy("doc_id")
    severity = F.element_at(F.array(*[F.lit(s) for s in records.SEVERITY_RANK]), (i % 4 + 1).cast("int"))
    power = records.strength(severity, F.lit(None), F.col("text"), i)
    rows = table(spark, d, "documents").withColumns({"power": power, "rank": records.severity_rank(severity)}).withColumn("before", F.lag("power").over(o))
    length = F.col("text").isNotNull() & F.lag("text").over(o).isNotNull()
    rows = rows.withColumn("known", length | (F.col("before.severity") != F.col("power.severity")))
    return rows.select("doc_id", "rank", F.when(F.col("before").isNull(), None).when(F.col("known") & (F.col("before") > F.col("power")), "before").otherwise("this").alias("stronger"))


@query("""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') WHEN doc_id % 3 = 1 THEN upper(left(coalesce(text, ''), 60)) ELSE substr(coalesce(text, ''), 11, 20) END, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS q FROM documents)
SELECT doc_id, CASE WHEN q = '' OR t = '' THEN false ELSE (len(regexp_split_to_array(q, '[ \\t\\n\\r\\f\\v]+')) < 3 AND length(q) < 24) OR contains(t, q) OR contains(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), regexp_replace(q, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) END AS verbatim FROM a""")
def is_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """A quotation of each document: the whole text, its start in capitals, or twenty characters."""
    text, turn = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    quoted = F.when(turn == 0, text).when(turn == 1, F.upper(F.substring(text, 1, 60))).otherwise(F.substring(text, 11, 20))
    return table(spark, d, "documents").select("doc_id", wording.is_verbatim(quoted, F.col("text")).alias("verbatim"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || ',' || p_size || '-' || (p_size + 3) ELSE CAST(p_size AS VARCHAR) END AS groups FROM part")
def numeric_group(spark: SparkSession, d: str) -> DataFrame:
    """Citations such as "7, 2007; 7 - 10" made of the parts' sizes: years go, numbers and ranges stay."""
    size = F.col("p_size")
    marker = F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit(", "), size + 2000, F.lit("; "), size, F.lit(" - "), size + 3)).otherwise(F.concat(size, F.lit(",;x"), size))
    return table(spark, d, "part").select("p_partkey", F.array_join(wording.numeric_group(marker), ",").alias("groups"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.text AS l, b.text AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, 1 AS l, 0 AS r, unnest(regexp_extract_all(lower(coalesce(l, '')), '[a-z0-9]{3,}')) AS w FROM p UNION ALL SELECT conv_id, turn, 0, 1, unnest(regexp_extract_all(lower(coalesce(r, '')), '[a-z0-9]{3,}')) FROM p),
c AS (SELECT conv_id, turn, w, sum(l) AS l, sum(r) AS r FROM w GROUP BY ALL), s AS (SELECT conv_id, turn, CAST(sum(l * r) AS DOUBLE) AS lr, CAST(sum(l * l) AS DOUBLE) AS ll, CAST(sum(r * r) AS DOUBLE) AS rr FROM c GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN ll > 0 AND rr > 0 THEN lr / (sqrt(ll) * sqrt(rr)) ELSE 0 END, 6) AS cosine FROM p LEFT JOIN s USING (conv_id, turn)""")
def cosine_text(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next of its conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("l"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("l").alias("r"))
    return wording.text_cosine(turns.join(following, ["conv_id", "turn"]), ["conv_id", "turn"], "l", "r").withColumn("cosine", rounded("cosine"))
