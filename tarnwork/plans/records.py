"""Queries of gates, merges, reference lists, critical paths and resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.wording import FINDING_STOPWORDS
from ..operators import calibration, records, traces
from ..sources import citations
from ..sources.tables import dealt, table
from .analytics import _SCORED, _scored
from .registry import query

DAY = 86400.0

_PATH = """p AS (SELECT o_orderkey AS parent, epoch_us(o_orderdate) / 1e6 AS lo, epoch_us(o_orderdate) / 1e6 + 60 * 86400.0 AS hi FROM orders),
c AS (SELECT l_orderkey AS parent, l_linenumber, epoch_us(l_shipdate) / 1e6 AS start, epoch_us(l_shipdate) / 1e6 + l_quantity * 86400 AS stop, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 0)"""


@query(f"""WITH {_PATH},
w AS (SELECT parent, lo, hi, start, stop, least(hi, coalesce(min(start) OVER (PARTITION BY parent ORDER BY stop DESC, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi)) AS cursor FROM c JOIN p USING (parent)),
b AS (SELECT parent, sum(least(stop, cursor) - greatest(start, lo)) AS blocked FROM w WHERE least(stop, cursor) > greatest(start, lo) GROUP BY parent)
SELECT parent AS order_key, round(coalesce(blocked, 0), 3) AS blocked_by_items, round(hi - lo - coalesce(blocked, 0), 3) AS own FROM p LEFT JOIN b USING (parent)""")
def critical_path(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of 60 days, their items as the spans below them: what the items and what the order itself keeps waiting."""
    a, s = F.unix_micros("o_orderdate") / 1e6, F.unix_micros("l_shipdate") / 1e6
    order_id = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    runs = table(spark, d, "orders").select(order_id.alias("span_id"), F.lit(None).cast("string").alias("parent_id"), a.alias("start"), (a + 60 * DAY).alias("stop"))
    item_id = F.concat_ws("-", F.lit("i"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string"), "l_quantity")
    items = table(spark, d, "lineitem").select(
        item_id.alias("span_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_id"), s.alias("start"), (s + F.col("l_quantity") * DAY).alias("stop"))
    own = traces.critical_path(runs.unionByName(items)).where("span_id like 'o%'")
    return runs.join(own, "span_id", "left").select(
        F.substring("span_id", 2, 20).cast("long").alias("order_key"), rounded(60 * DAY - F.coalesce("critical", F.lit(0.0)), 3).alias("blocked_by_items"),
        rounded(F.coalesce("critical", F.lit(0.0)), 3).alias("own"))


@query("""SELECT user_id, round(coalesce(max(value) FILTER (event_type = 'signup'), max(epoch_us(ts) / 1e6 + coalesce(value, 0)) FILTER (event_type = 'purchase') - min(epoch_us(ts) / 1e6) FILTER (event_type = 'purchase')), 3) AS wall
FROM events GROUP BY user_id""")
def trace_wall(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros("ts") / 1e6
    spans = table(spark, d, "events").select(
        F.col("user_id").alias("trace_id"), F.when(F.col("event_type") != "purchase", F.lit("p")).alias("parent_id"), F.when(F.col("event_type") == "signup", "run").otherwise("node").alias("kind"),
        at.alias("start"), F.when(F.col("event_type") != "signup", at + F.coalesce("value", F.lit(0.0))).alias("stop"), F.col("value").alias("duration"))
    return traces.span_walls(spans).select(F.col("trace_id").alias("user_id"), rounded("wall", 3).alias("wall"))


@query(f"""WITH {_SCORED}, b AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score),
r AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS p FROM b)
SELECT round(sum(p * pos) / sum(pos), 6) AS auc_pr FROM r""")
def auc_pr(spark: SparkSession, d: str) -> DataFrame:
    return calibration.average_precision(_scored(spark, d)).select(rounded("auc_pr").alias("auc_pr"))


@query("""WITH e AS (SELECT doc_id, (least(1.0, n_chars / 4000.0) - quality) * (least(1.0, n_chars / 4000.0) - quality) AS v FROM labels JOIN documents USING (doc_id)),
u AS (SELECT v, r, CAST('0x' || substr(md5(doc_id || ':' || r), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM e, range(200) t(r)),
w AS (SELECT r, v, len(list_filter([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975], lambda x: u >= x)) AS w FROM u),
m AS (SELECT r, sum(w * v) / sum(w) AS mean FROM w GROUP BY r HAVING sum(w) > 0)
SELECT (SELECT round(avg(v), 6) FROM e) AS point, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS resamples FROM m""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The Brier score of the length score, with its bootstrap interval."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    rows = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", ((F.col("score") - F.col("quality")) ** 2).alias("loss"))
    return calibration.bootstrap_interval(rows, "doc_id", "loss").select(*[rounded(c).alias(c) for c in ("point", "low", "high")], "resamples")


@query("""WITH r AS (SELECT o_orderkey AS run, o_totalprice / 200000 AS parser, o_orderstatus = 'P' AS blocked, o_orderpriority LIKE '1%' AS pdf, o_custkey % 4 AS tasks, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 100) / 100 END AS cov, o_orderkey % 5 = 0 AS pruned FROM orders)
SELECT run, CASE WHEN coalesce(blocked, false) OR parser < 0.55 THEN 'needs_parser_review' WHEN pdf AND tasks > 0 AND cov < 0.75 THEN 'needs_retry' WHEN pruned THEN 'ok_sources_pruned' ELSE 'ok' END AS verdict,
concat_ws(',', CASE WHEN blocked THEN 'blocked' END, CASE WHEN parser < 0.6 THEN 'parser' END, CASE WHEN cov < 0.7 THEN 'coverage' END) AS halt FROM r""")
def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    parser, blocked = F.col("o_totalprice") / 200000, F.col("o_orderstatus") == "P"
    coverage = F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 100) / 100)
    verdict = records.publish_gate(parser, blocked, F.col("o_orderpriority").like("1%"), F.col("o_custkey") % 4, coverage, F.col("o_orderkey") % 5 == 0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), verdict.alias("verdict"), F.array_join(records.halt_reasons(parser, blocked, coverage), ",").alias("halt"))


@query("""SELECT l_orderkey, count(*) AS n, CAST(sum(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END, o_custkey)) AS BIGINT) AS runs
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    children = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("run"))
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run"))
    return records.fill_from_parent(children, parents, "l_orderkey", "run").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("run").alias("runs"))


@query("""WITH s AS (SELECT lower(p_name) AS title, 0 AS source, p_partkey AS id FROM part WHERE p_size < 10 UNION ALL SELECT lower(p_name), 1, p_partkey FROM part WHERE p_size < 30 UNION ALL SELECT lower(c_name), 2, c_custkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source, id) AS n FROM s) SELECT title, source, id FROM r WHERE n = 1""")
def merge_dedupe_discovery(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    named = [part.where(f"p_size < {size}").select(F.lower("p_name").alias("title"), F.col("p_partkey").alias("id")) for size in (10, 30)]
    named.append(table(spark, d, "customer").select(F.lower("c_name").alias("title"), F.col("c_custkey").alias("id")))
    return records.first_source_wins(named, "title", ["id"]).select("title", "source", "id")


@query("SELECT p_name AS source_key, p_partkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def dedupe_sources(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_name").alias("source_key"), F.col("p_partkey").alias("id"), "p_retailprice")
    return records.best_per_key(part, "source_key", "p_retailprice", "id", 3).select("source_key", "id", "rank")


_NORMAL = "array_to_string(list_filter(string_split(regexp_replace(lower(source || coalesce(' ' || nullif(text, ''), '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in FINDING_STOPWORDS) + ")), ' ')"


@query(f"SELECT doc_id, substr(sha1(substr({_NORMAL}, 1, 220)), 1, 16) AS fingerprint FROM documents")
def task_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", records.task_fingerprint(F.col("source"), F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id WHERE trim(coalesce(d.text, '')) <> ''")
def missed_units_anti(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "").join(known, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts IS NULL OR epoch_us(ts) + 604800000000 >= (SELECT max(epoch_us(ts)) FROM events) GROUP BY event_type")
def prune_expired(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("now"))
    return records.unexpired(events.join(F.broadcast(last)), "ts", 7 * DAY, F.col("now")).groupBy("event_type").agg(F.count("*").alias("n"))  # last is one row


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS feature FROM orders), g AS (SELECT feature, CAST(r AS INT) AS rating FROM s, range(1, 6) t(r)),
n AS (SELECT o_orderpriority AS feature, CAST(o_custkey % 6 AS INT) AS rating, count(*) AS n FROM orders GROUP BY ALL) SELECT feature, rating, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (feature, rating)""")
def feedback_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ratings 1 to 5 of each feature, those that nobody gave as 0; rating 0 is none."""
    rated = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(*[F.count_if(F.col("o_custkey") % 6 == r).alias(str(r)) for r in range(1, 6)])
    return rated.unpivot("feature", [str(r) for r in range(1, 6)], "rating", "n").select("feature", F.col("rating").cast("int").alias("rating"), "n")


@query("SELECT p_brand || '/' || (p_partkey // 100) AS file_id, 'p' || p_partkey AS cite_key, p_name AS title, CAST(1950 + p_size AS INT) AS year, lower(p_type) AS kind FROM part WHERE regexp_full_match(p_type, '[A-Z]+')")
def bibtex_source(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as BibTeX, a file for each brand and hundred of keys, and read back."""
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    file_id = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 100).cast("string"))
    entry = F.concat(F.lit("@"), "p_type", F.lit("{"), key, F.lit(",\n  title = {{"), "p_name", F.lit("}},\n  year = "), (1950 + F.col("p_size")).cast("string"), F.lit("\n}"))
    files = table(spark, d, "part").where(F.col("p_type").rlike("^[A-Z]+$")).groupBy(file_id.alias("file_id")).agg(F.array_join(F.collect_list(entry), "\n").alias("text"))
    return citations.bibtex_entries(files).select("file_id", "cite_key", "title", "year", "kind")


@query("SELECT p_partkey AS file_id, p_name AS title, p_type AS abstract, p_brand || ',' || p_size AS headings, CAST(2 AS INT) AS n_references FROM part")
def tei_parse(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as TEI and read back."""
    xml = F.format_string(
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>%s</title></titleStmt><abstract> %s </abstract></teiHeader><text><body><div><head>%s</head></div>'
        "<div><head>%d</head></div></body><listBibl><biblStruct/><biblStruct/></listBibl></text></TEI>", "p_name", "p_type", "p_brand", "p_size")
    part = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    found = citations.tei_fields(part.select(F.col("p_partkey").alias("file_id"), xml.alias("xml")))
    return found.withColumn("headings", F.array_join("headings", ","))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), x AS (SELECT l_orderkey, max_by(l_partkey, {'a': l_shipdate, 'b': l_partkey, 'c': l_extendedprice}) AS p, max_by(l_extendedprice, {'a': l_shipdate, 'b': l_partkey, 'c': l_extendedprice}) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS id, o_custkey AS other, o_totalprice AS price FROM c ANTI JOIN x ON o_orderkey = l_orderkey UNION ALL SELECT l_orderkey, p, e FROM x""")
def upsert_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Orders, those with returned items replaced by their last one."""
    current = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("other"), F.col("o_totalprice").alias("price"), F.lit(None).cast("timestamp").alias("at"))
    changes = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("other"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("at"))
    return records.upsert(current, changes, ["id"], ["at", "other", "price"]).select("id", "other", "price")


@query("""SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderkey = active) AS shown, max(active) AS active FROM (SELECT *, max(o_orderkey) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS active FROM orders) GROUP BY o_custkey""")
def publish_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The last finished order of each customer is the one that shows."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    pointers = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("active"))
    shown = records.published(orders, pointers, "o_custkey", "o_orderkey")
    return shown.groupBy("o_custkey").agg(F.count("*").alias("runs"), F.count_if("is_published").alias("shown"), F.max(F.when(F.col("is_published"), F.col("o_orderkey"))).alias("active"))


@query("""WITH r AS (SELECT c_nationkey AS scope, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, lower(c_mktsegment) AS seg, 1990 + c_custkey % 20 AS year FROM customer),
n AS (SELECT scope, pos, year, unnest([seg, 'a']) AS name FROM r),
k AS (SELECT scope, key, max(pos) AS pos FROM (SELECT scope, CAST(pos AS VARCHAR) AS key, pos FROM r UNION ALL SELECT scope, name, pos FROM n UNION ALL SELECT scope, name || year, pos FROM n) GROUP BY scope, key),
m AS (SELECT o_orderkey, c_nationkey AS scope, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN lower(c_mktsegment) || (1990 + o_orderkey % 25) END AS k1, CASE WHEN o_orderkey % 3 = 1 THEN lower(c_mktsegment) END AS k2 FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, coalesce(a.pos, b.pos) AS position FROM m LEFT JOIN k a ON m.scope = a.scope AND k1 = a.key LEFT JOIN k b ON m.scope = b.scope AND k2 = b.key""")
def marker_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Customers as the reference list of their nation, orders as citations of it."""
    customer, key = table(spark, d, "customer"), F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    references = customer.select(F.col("c_nationkey").alias("scope"), place.cast("long").alias("position"), F.concat("c_mktsegment", F.lit(" A.")).alias("author"), (1990 + F.col("c_custkey") % 20).alias("year"))
    marker = F.when(key % 3 == 0, F.concat(F.lit("["), (key % 40).cast("string"), F.lit("]"))).when(key % 3 == 1, F.concat("c_mktsegment", F.lit(" et al. ("), (1990 + key % 25).cast("string"), F.lit(")"))).otherwise("see above")
    cited = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("scope"), marker.alias("marker"))
    return records.resolve_markers(cited, references).select("o_orderkey", "position")
