"""Usage, cost and load summaries, boards over runs, row predicates and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import gates
from ..operators import usage as U
from ..operators.relational import first_wins
from ..sources.tables import table
from .registry import query


@query("""WITH u AS (SELECT o_custkey AS user_id, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY o_custkey), l AS (SELECT list_sort(list(cost)) AS v FROM u)
SELECT (SELECT count(*) FROM u) AS users, round((SELECT sum(cost) FROM u), 2) AS total, round((SELECT avg(cost) FROM u), 4) AS mean, round((SELECT median(cost) FROM u), 4) AS median, v[CAST(floor(len(v) * 0.9) AS INT) + 1] AS p90, v[CAST(floor(len(v) * 0.95) AS INT) + 1] AS p95 FROM l""")
def cost_all_users(spark: SparkSession, d: str) -> DataFrame:
    costs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(rounded(F.sum("o_totalprice"), 2).alias("cost"))
    return U.cost_summary(costs).select("users", rounded("total", 2).alias("total"), rounded("mean", 4).alias("mean"), rounded("median", 4).alias("median"), "p90", "p95")


_CALLS = "calls AS (SELECT event_id, event_type AS label, 'm-' || (user_id % 3) AS model, CAST(floor(value * 10) AS BIGINT) AS tokens, value / 100 AS usd FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_CALLS} SELECT label, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(usd), 4) AS usd FROM calls GROUP BY GROUPING SETS ((), (label), (model))")
def usage_fold(spark: SparkSession, d: str) -> DataFrame:
    """Totals, by label and by model in one pass."""
    e = table(spark, d, "events").where("value IS NOT NULL")
    calls = e.select(F.col("event_type").alias("label"), F.concat(F.lit("m-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor(F.col("value") * 10).alias("tokens"), (F.col("value") / 100).alias("usd"))
    sets = calls.groupingSets([[], ["label"], ["model"]], "label", "model")
    return sets.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), rounded(F.sum("usd"), 4).alias("usd"))


_LOAD = """r AS (SELECT event_id, epoch_us(ts) / 1e6 AS scheduled, epoch_us(ts) / 1e6 + value AS finished, value AS response, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'timeout: ' || user_id ELSE 'refused' END END AS error, user_id % 10 = 0 AS warmup FROM events WHERE value IS NOT NULL),
m AS (SELECT * FROM r WHERE NOT warmup), w AS (SELECT greatest(max(finished) - min(scheduled), 1e-9) AS w FROM m)"""


def _load(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros("ts") / 1e6
    error = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("timeout: "), F.col("user_id").cast("string"))).otherwise("refused"))
    return table(spark, d, "events").where("value IS NOT NULL").select(at.alias("scheduled"), (at + F.col("value")).alias("finished"), F.col("value").alias("response"), error.alias("error"), (F.col("user_id") % 10 == 0).alias("warmup"))


@query(f"""WITH {_LOAD} SELECT (SELECT count(*) FROM r) AS offered, (SELECT count(*) FROM r WHERE warmup) AS warmup, count(*) AS measured, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NULL AND response <= 20) AS within_slo,
round(max(w), 3) AS window, round(count(*) FILTER (error IS NULL) / max(w), 9) AS throughput, round(count(*) FILTER (error IS NULL AND response <= 20) / max(w), 9) AS goodput, quantile_disc(response, 0.5) FILTER (error IS NULL) AS p50, quantile_disc(response, 0.95) FILTER (error IS NULL) AS p95 FROM m, w""")
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests with an objective of 20 seconds; every tenth user warms up."""
    return U.load_summary(_load(spark, d), 20.0).withColumns({"window": rounded("window", 3), "throughput": rounded("throughput", 9), "goodput": rounded("goodput", 9)})


@query(f"WITH {_LOAD} SELECT string_split(error, ':')[1] AS kind, count(*) AS n FROM m WHERE error IS NOT NULL GROUP BY 1")
def load_errors(spark: SparkSession, d: str) -> DataFrame:
    return U.error_kinds(_load(spark, d).where("NOT warmup"))


@query("""WITH c AS (SELECT l_linenumber AS place, avg(l_extendedprice) * (1 + l_linenumber % 3) AS cost FROM lineitem GROUP BY l_linenumber)
SELECT place, round(cost, 4) AS cost, round(coalesce(sum(cost) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS saved, round(coalesce(sum(cost) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(cost) OVER (), 6) AS share FROM c""")
def savings_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as nodes in order, each with its mean cost times its fan-out: what a resume before each saves."""
    costs = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("place")).agg(F.avg("l_extendedprice").alias("mean")).withColumn("cost", F.col("mean") * (1 + F.col("place") % 3))
    return U.savings(costs, "place", "cost").select("place", rounded("cost", 4).alias("cost"), rounded("saved", 4).alias("saved"), rounded("share").alias("share"))


@query("""SELECT l_returnflag AS node, l_linenumber AS paper, count(*) AS runs, count(*) FILTER (l_discount = 0) AS failures, round(min(l_extendedprice) FILTER (l_discount > 0), 2) AS low, round(max(l_extendedprice) FILTER (l_discount > 0), 2) AS high,
round(coalesce(sum(l_tax) FILTER (l_linestatus = 'O'), 0), 4) AS new_cost, round(coalesce(sum(l_tax) FILTER (l_linestatus <> 'O'), 0), 4) AS replayed_cost FROM lineitem GROUP BY ALL""")
def replay_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Items as replays: runs, failures, the spread of those that worked, and the cost split by whether it was spent anew."""
    ok, new = F.col("l_discount") > 0, F.col("l_linestatus") == "O"
    part = lambda c: rounded(F.coalesce(F.sum(F.when(c, F.col("l_tax"))), F.lit(0.0)), 4)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("node"), F.col("l_linenumber").alias("paper")).agg(
        F.count("*").alias("runs"), F.count_if(~ok).alias("failures"), rounded(F.min(F.when(ok, F.col("l_extendedprice"))), 2).alias("low"), rounded(F.max(F.when(ok, F.col("l_extendedprice"))), 2).alias("high"), part(new).alias("new_cost"), part(~new).alias("replayed_cost"))


@query("""WITH u AS (SELECT l_orderkey AS paper, l_quantity / 10 AS weight, l_returnflag = 'R' AS matched FROM lineitem) SELECT paper, count(*) AS units, round(CASE WHEN sum(weight) > 0 THEN coalesce(sum(weight) FILTER (matched), 0) / sum(weight) END, 6) AS recall,
round(avg(CASE WHEN matched THEN 1.0 ELSE 0 END), 6) AS plain, CAST(ceil(count(*) / 10) AS INT) AS band FROM u GROUP BY paper""")
def severity_recall(spark: SparkSession, d: str) -> DataFrame:
    """Items as review units: the weight that was matched, beside the plain share and its band of a tenth."""
    u = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_quantity") / 10).alias("weight"), (F.col("l_returnflag") == "R").alias("matched"))
    r = U.weighted_recall(u, ["paper"])
    return r.select("paper", "units", rounded("recall").alias("recall"), rounded("plain").alias("plain"), F.ceil(F.col("units") / 10).cast("int").alias("band"))


@query("""WITH p AS (SELECT n_name AS persona, n_nationkey AS k FROM nation), f AS (SELECT c_nationkey AS k, count(*) AS findings FROM customer WHERE c_acctbal > 9000 GROUP BY 1), c AS (SELECT s_nationkey AS k, count(*) AS calls FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT persona, coalesce(findings, 0) AS findings, coalesce(calls, 0) AS calls, round(CASE WHEN calls > 0 THEN coalesce(findings, 0) / calls END, 6) AS ratio FROM p LEFT JOIN f USING (k) LEFT JOIN c USING (k)""")
def persona_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nations as personas, customers as findings, suppliers as calls; those without any count as none."""
    p = table(spark, d, "nation").select(F.col("n_name").alias("persona"), F.col("n_nationkey").alias("k"))
    f = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("findings"))
    c = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("calls"))
    z = p.join(f, "k", "left").join(c, "k", "left").na.fill(0, ["findings", "calls"])
    return z.select("persona", "findings", "calls", rounded(F.when(F.col("calls") > 0, F.col("findings") / F.col("calls"))).alias("ratio"))


@query("""WITH r AS (SELECT o_custkey AS point, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders) SELECT point, id, age = 1 AS current, CASE WHEN age > 1 THEN first_value(id) OVER (PARTITION BY point ORDER BY age) END AS superseded_by FROM r""")
def ann_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as measurements of a point: the latest counts, the others are listed with what took their place."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("point"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return U.superseded(rows, ["point"], "id", ["o_orderdate", "id"])


@query("""WITH r AS (SELECT o_orderpriority || o_orderstatus AS config, year(o_orderdate) AS snapshot, o_orderdate AS day, o_orderkey AS run, o_totalprice AS v, o_custkey % 50 = 0 AS invalid FROM orders),
g AS (SELECT config, snapshot, count(*) AS runs, arg_min(v, (day, run)) AS first, arg_max(v, (day, run)) AS last, arg_max(run, (day, run)) AS headline FROM r WHERE NOT invalid GROUP BY ALL), i AS (SELECT config, snapshot, count(*) AS invalid FROM r WHERE invalid GROUP BY ALL)
SELECT config, snapshot, runs, headline, round(last, 2) AS last, round(CASE WHEN runs >= 2 THEN last - first END, 2) AS delta, coalesce(invalid, 0) AS invalid FROM g LEFT JOIN i USING (config, snapshot)""")
def retrieval_board(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of a configuration on a year's snapshot: the last valid one is the headline; changes never go across snapshots."""
    rows = table(spark, d, "orders").select(
        F.concat("o_orderpriority", "o_orderstatus").alias("config"), F.year("o_orderdate").alias("snapshot"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("value"), (F.col("o_custkey") % 50 == 0).alias("invalid"))
    b = U.run_board(rows, ["config", "snapshot"])
    return b.select("config", "snapshot", "runs", "headline", rounded("last", 2).alias("last"), rounded("delta", 2).alias("delta"), "invalid")


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'all', NULL, count(*) FROM documents""")
def ingest_board(spark: SparkSession, d: str) -> DataFrame:
    """Value counts of a manifest's columns and of all its rows in one pass."""
    return U.value_counts(table(spark, d, "documents"), ["lang", "source"])


@query("""SELECT 'orders' AS sink, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 2) AS usd, count(*) FILTER (o_orderstatus = 'P') AS unpriced FROM orders UNION ALL SELECT 'items', round(sum(l_extendedprice) FILTER (l_discount > 0), 2), count(*) FILTER (l_discount = 0) FROM lineitem
UNION ALL SELECT 'events', round(sum(value), 2), count(*) - count(value) FROM events UNION ALL SELECT 'total', NULL, NULL""")
def cost_board(spark: SparkSession, d: str) -> DataFrame:
    """Three sinks that overlap, each by itself; their total is unknown on purpose."""
    o, l, e = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "events")
    return U.cost_board({
        "orders": o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("usd")), "items": l.select(F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("usd")), "events": e.select(F.col("value").alias("usd"))})


@query("""WITH u AS (SELECT o_orderpriority AS section, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'new' ELSE NULL END AS status FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT CASE WHEN l_linenumber > 4 THEN l_returnflag END, 'dismissed' FROM lineitem WHERE l_discount = 0.05)
SELECT coalesce(section, 'introduction') AS section, count(*) FILTER (coalesce(status, 'new') = 'new') AS new, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) AS total FROM u GROUP BY 1""")
def section_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of feedback in one, by section and status; no section is the introduction, no status is new."""
    a = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("section"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "new").alias("status"))
    b = table(spark, d, "lineitem").where("l_discount = 0.05").select(F.when(F.col("l_linenumber") > 4, F.col("l_returnflag")).alias("section"), F.lit("dismissed").alias("status"))
    return U.section_summary([a, b], ["new", "accepted", "dismissed"])


@query("""WITH t AS (SELECT n_name AS name, n_regionkey AS colour, n_nationkey AS id FROM nation), o AS (SELECT c_mktsegment AS name, c_custkey % 7 AS colour, c_custkey AS id FROM customer UNION ALL SELECT n_name, 99, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT name, colour, 'predefined' AS origin FROM t UNION ALL SELECT name, arg_min(colour, id), 'own' FROM o WHERE name NOT IN (SELECT name FROM t) GROUP BY name""")
def tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Predefined tags, and a user's own that are not among them, each with its first colour."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    fixed = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("colour"))
    own = c.select(F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 7).alias("colour"), F.col("c_custkey").alias("id")).unionByName(
        c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("name"), F.lit(99).cast("long").alias("colour"), F.col("c_custkey").alias("id")))
    first = first_wins(own, ["name"], ["id"]).select("name", "colour").join(fixed.select("name"), "name", "left_anti")
    return fixed.withColumn("origin", F.lit("predefined")).unionByName(first.withColumn("origin", F.lit("own")))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS completed, bool_or(o_totalprice > 499000) AS rewarded, count(DISTINCT o_custkey) AS referrers FROM orders""")
def referral_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.bool_or(F.col("o_totalprice") > 499000).alias("rewarded"), F.countDistinct("o_custkey").alias("referrers"))


@query("""WITH m AS (SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_nationkey % 2 = 0 THEN '.edu' ELSE '.org' END AS domain FROM customer) SELECT domain, count(DISTINCT c_custkey) AS completed FROM m JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND domain NOT IN ('building.org', 'machinery.org') GROUP BY domain HAVING count(DISTINCT c_custkey) >= 3""")
def domain_reward(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an address made of segment and nation: domains (free ones aside) with three completed referrals."""
    address = F.concat(F.lit("u@"), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, ".edu").otherwise(".org"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return U.rewarded_domains(table(spark, d, "customer").select("c_custkey", address.alias("email")).join(done, "c_custkey"), "c_custkey", ["building.org", "machinery.org"], 3)


@query("""SELECT c_mktsegment, count(DISTINCT n_name) AS authors, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, CAST(sum(o_custkey % 10) AS BIGINT) AS citations, round(avg(o_custkey % 10), 6) AS mean_citations
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cited, year = F.col("o_custkey") % 10, F.year("o_orderdate")
    return j.groupBy("c_mktsegment").agg(
        F.countDistinct("n_name").alias("authors"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.sum(cited).alias("citations"), rounded(F.avg(cited)).alias("mean_citations"))


@query("""WITH e AS (SELECT p_brand AS kind, unnest(string_split(p_name, ' ')) AS value, p_partkey FROM part), c AS (SELECT kind, value, count(*) AS n, min(p_partkey) AS first FROM e GROUP BY ALL) SELECT kind, value, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, first, value) <= 4""")
def coverage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent words of each brand's names; of equal ones the first seen."""
    e = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.explode(F.split("p_name", " ")).alias("value"), "p_partkey")
    return U.most_frequent(e, "kind", "value", "p_partkey", 4)


@query("SELECT c_custkey, c_name, {'id': n_nationkey, 'title': n_name} AS project FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9500".replace("{'id': n_nationkey, 'title': n_name} AS project", "n_nationkey AS project_id, n_name AS project_title"))
def embedded_inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their parent embedded as a struct, as it was asked for; here its fields side by side."""
    parent = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")).alias("project"))
    return table(spark, d, "customer").where("c_acctbal > 9500").join(parent, "c_nationkey").select("c_custkey", "c_name", F.col("project.id").alias("project_id"), F.col("project.title").alias("project_title"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """The report of the five latest orders."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_custkey")


@query("""SELECT 'orders_without_customer' AS check_name, count(*) AS broken FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'items_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'repeated_order', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'negative_price', count(*) FROM orders WHERE o_totalprice < 0""")
def integrity_asserts(spark: SparkSession, d: str) -> DataFrame:
    o, l, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    return U.integrity({
        "orders_without_customer": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "items_without_order": l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "repeated_order": o.groupBy("o_orderkey").count().where("count > 1"), "negative_price": o.where("o_totalprice < 0")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F'")
def isolation_assert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one run that are published; a row of another run in them would stop the query."""
    rows = table(spark, d, "orders").where("o_custkey % 10 = 3 AND o_orderstatus = 'F'").withColumns({"run": F.col("o_custkey") % 10, "published": F.col("o_orderstatus") == "F"})
    return U.isolated(rows, "run", F.lit(3), "published").select("o_orderkey", "o_custkey")


@query("""WITH h AS (SELECT o_custkey AS cell, o_orderkey AS run, round(o_totalprice / 100000, 1) AS overall, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders), b AS (SELECT cell, max(overall) AS best FROM h GROUP BY cell)
SELECT cell, best, arg_min(run, place) AS best_run FROM h JOIN b USING (cell) WHERE overall = best GROUP BY cell, best""")
def best_by_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.round(F.col("o_totalprice") / 100000, 1).alias("overall"))
    return gates.best_by_cell(rows)
