"""Traces, calibration, product analytics and the measurement store over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import nearest_rank, refused_below, rounded, wilson
from ..operators import calibration, gates, traces
from ..operators.relational import first_wins, index_quantiles, latest_wins, mean_ranks, offset_page, status_filter, top_k_per
from ..sources.tables import table
from .registry import query

PRICES = {"STANDARD": 1.0, "STANDARD POLISHED": 2.5, "PROMO": 4.0, "ECONOMY": 0.5, "ECONOMY BRUSHED": 0.75}
THRESHOLDS = [i / 10 for i in range(11)]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals of ``value`` seconds, in seconds since 1970, to the microsecond."""
    at = F.unix_micros("ts") / 1e6
    return table(spark, d, "events").where("value is not null").select("user_id", "event_id", "event_type", at.alias("start"), (at + F.col("value")).alias("stop"))


_SPANS = "spans AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS stop FROM events WHERE value IS NOT NULL)"
_ISLANDS = """marked AS (SELECT *, CASE WHEN start {op} max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""


@query(f"""WITH {_SPANS}, {_ISLANDS.format(op='<=')}, m AS (SELECT user_id, island, min(start) AS a, max(stop) AS b, sum(stop - start) AS part FROM isl GROUP BY user_id, island)
SELECT user_id, round(sum(b - a), 3) AS covered, round(sum(part), 3) AS busy, count(*) AS n_islands FROM m GROUP BY user_id""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    u = traces.interval_union(_spans(spark, d), ["user_id"])
    return u.select("user_id", rounded("covered", 3).alias("covered"), rounded("busy", 3).alias("busy"), "n_islands")


@query(f"""WITH {_SPANS}, {_ISLANDS.format(op='<')} SELECT user_id, island, count(*) AS n, round(min(start), 3) AS start, round(max(stop), 3) AS stop FROM isl GROUP BY user_id, island HAVING count(*) > 1""")
def overlap_groups(spark: SparkSession, d: str) -> DataFrame:
    return traces.overlap_groups(_spans(spark, d), ["user_id"]).select("user_id", "island", "n", rounded("start", 3).alias("start"), rounded("stop", 3).alias("stop"))


@query(f"""WITH {_SPANS}, e AS (SELECT event_type, start AS t, 1 AS step FROM spans UNION ALL SELECT event_type, stop, -1 FROM spans),
r AS (SELECT event_type, sum(step) OVER (PARTITION BY event_type ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS open FROM e)
SELECT event_type, max(open) AS peak FROM r GROUP BY event_type""")
def inflight_max(spark: SparkSession, d: str) -> DataFrame:
    return traces.in_flight(_spans(spark, d), ["event_type"])


@query("""WITH p AS (SELECT o_orderkey AS parent, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(o_orderdate) / 1e6 + 60 * 86400.0 AS b FROM orders),
c AS (SELECT l_orderkey AS parent, greatest(epoch_us(l_shipdate) / 1e6, a) AS start, least(epoch_us(l_shipdate) / 1e6 + l_quantity * 86400, b) AS stop FROM lineitem JOIN p ON l_orderkey = parent),
k AS (SELECT * FROM c WHERE stop > start),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY parent ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY parent ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT parent, sum(b - a) AS child FROM (SELECT parent, island, min(start) AS a, max(stop) AS b FROM i GROUP BY parent, island) GROUP BY parent)
SELECT p.parent, round(b - a, 3) AS total, round(coalesce(child, 0), 3) AS child_time, round(b - a - coalesce(child, 0), 3) AS self_time FROM p LEFT JOIN u USING (parent)""")
def self_time(spark: SparkSession, d: str) -> DataFrame:
    a = F.unix_micros("o_orderdate") / 1e6
    s = F.unix_micros("l_shipdate") / 1e6
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent"), a.alias("start"), (a + 60 * 86400.0).alias("stop"))
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), s.alias("start"), (s + F.col("l_quantity") * 86400).alias("stop"))
    return traces.self_time(parents, children).select("parent", *[rounded(c, 3).alias(c) for c in ("total", "child_time", "self_time")])


@query("""SELECT event_type, user_id, count(*) AS n, quantile_disc(value, 0.5) AS p50, CASE WHEN count(*) >= 20 THEN quantile_disc(value, 0.95) END AS p95,
CASE WHEN count(*) >= 100 THEN quantile_disc(value, 0.99) END AS p99, CASE WHEN count(*) < 20 THEN 'n=' || count(*) || ' < 20' END AS p95_refused FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id""")
def node_latency_refusing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), *[nearest_rank("value", q).alias(c) for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    n = F.col("n")
    return e.select("event_type", "user_id", "n", "p50", refused_below(F.col("p95"), n, 20).alias("p95"), refused_below(F.col("p99"), n, 100).alias("p99"), F.when(n < 20, F.concat(F.lit("n="), n, F.lit(" < 20"))).alias("p95_refused"))


@query("WITH a AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_custkey) SELECT o_custkey, v[least(CAST(floor(len(v) * 0.9) AS INT) + 1, len(v))] AS p90, v[least(CAST(floor(len(v) * 0.95) AS INT) + 1, len(v))] AS p95 FROM a")
def percentile_floor_index(spark: SparkSession, d: str) -> DataFrame:
    return index_quantiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", {"p90": 0.9, "p95": 0.95})


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def percentile_interp(spark: SparkSession, d: str) -> DataFrame:
    p = F.percentile("value", F.array(*[F.lit(x) for x in (0.025, 0.5, 0.975)]))
    return table(spark, d, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", *[rounded(F.element_at("p", i + 1)).alias(c) for i, c in enumerate(("low", "mid", "high"))])


@query("""WITH RECURSIVE walk AS (SELECT conv_id, turn, turn AS here, role, 0 AS depth FROM conversations
UNION ALL SELECT w.conv_id, w.turn, c.turn, c.role, w.depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.here - 1 WHERE w.role <> 'user')
SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN here END) AS owner, min(CASE WHEN role = 'user' THEN depth END) AS depth FROM walk GROUP BY conv_id, turn""")
def owning_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """The nearest user turn at or before each turn, where no turn is missing between; a window, not a walk."""
    c = table(spark, d, "conversations")
    # turns chain to the turn before them; a missing turn breaks the chain
    order = Window.partitionBy("conv_id").orderBy("turn")
    linked = c.withColumn("chain", F.sum(F.when(F.col("turn") - F.lag("turn").over(order) == 1, 0).otherwise(1)).over(order))
    owner = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id", "chain").orderBy("turn"))
    return linked.select("conv_id", "turn", owner.alias("owner")).withColumn("depth", F.col("turn") - F.col("owner"))


@query("""SELECT p_type, CASE WHEN p_type LIKE 'STANDARD POLISHED%' THEN 2.5 WHEN p_type LIKE 'ECONOMY BRUSHED%' THEN 0.75 WHEN p_type LIKE 'STANDARD%' THEN 1.0 WHEN p_type LIKE 'ECONOMY%' THEN 0.5 WHEN p_type LIKE 'PROMO%' THEN 4.0 END AS price, count(*) AS n FROM part GROUP BY p_type""")
def price_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return traces.longest_prefix_price(table(spark, d, "part"), "p_type", PRICES).groupBy("p_type", "price").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 0 AS g1, grouping(l_linestatus) + 0 AS g2, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost,
count(*) FILTER (l_discount = 0) AS unpriced FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def cost_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "lineitem")
    priced = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(30,10)"))
    sets = usage.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return sets.agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("calls"), F.sum("l_quantity").cast("long").alias("tokens"),
        F.round(priced, 2).cast("double").alias("cost"), F.count_if(F.col("l_discount") == 0).alias("unpriced"),
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a score from the length of the text."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    # as SQL rounds doubles: 0.575 * 100 is a little under 57.5, where a decimal 0.575 would go up
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), (F.round(F.col("score") * 100) / 100).alias("score"), "toxic")


_SCORED = "scored AS (SELECT quality AS y, round(least(1.0, n_chars / 4000.0), 2) AS score, toxic FROM labels JOIN documents USING (doc_id))"
_SWEEP = f"""WITH {_SCORED}, t AS (SELECT i / 10 AS threshold FROM range(11) r(i)),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM scored, t GROUP BY threshold)"""


@query(f"{_SWEEP} SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM c")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    t = calibration.threshold_sweep(_scored(spark, d), THRESHOLDS)
    return t.select("threshold", "tp", "fp", "fn", "tn", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@query(f"{_SWEEP}, w AS (SELECT threshold, tp + fp AS n, tp / (tp + fp) AS p FROM c WHERE tp + fp > 0) SELECT threshold, n, round(p, 6) AS precision, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM w")
def wilson_sweep(spark: SparkSession, d: str) -> DataFrame:
    t = calibration.threshold_sweep(_scored(spark, d), THRESHOLDS).where("tp + fp > 0").withColumn("n", F.col("tp") + F.col("fp"))
    low, high = wilson(F.col("tp"), F.col("n"))
    return t.select("threshold", "n", rounded("precision").alias("precision"), rounded(low).alias("low"), rounded(high).alias("high"))


@query(f"""WITH {_SCORED}, b AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score), r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER () AS p FROM b)
SELECT score, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp, round(tp / seen, 6) AS precision, round(tp / p, 6) AS recall FROM r""")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return calibration.pr_curve(_scored(spark, d)).select("score", "tp", "fp", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@query(f"WITH {_SCORED} SELECT CAST(greatest(0, (SELECT count(*) FROM range(10) r(i) WHERE i / 10 <= score) - 1) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM scored GROUP BY 1")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return calibration.reliability(_scored(spark, d)).select("bin", "n", rounded("mean_score").alias("mean_score"), rounded("rate").alias("rate"))


@query(f"""WITH {_SCORED}, b AS (SELECT greatest(0, (SELECT count(*) FROM range(10) r(i) WHERE i / 10 <= score) - 1) AS bin, count(*) AS n, avg(score) AS s, avg(y) AS r FROM scored GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(s - r)) / sum(n), 6) AS ece, round(max(abs(s - r)), 6) AS mce, (SELECT round(avg((score - y) * (score - y)), 6) FROM scored) AS brier FROM b""")
def ece_brier(spark: SparkSession, d: str) -> DataFrame:
    return calibration.calibration_error(_scored(spark, d)).select("n", *[rounded(c).alias(c) for c in ("ece", "mce", "brier")])


@query("""WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS o, avg(quality) AS a, avg(toxic) AS b FROM labels), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS x FROM s)
SELECT n, round(o, 6) AS observed, round(x, 6) AS expected, round((o - x) / (1 - x), 6) AS kappa FROM e""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return calibration.kappa(table(spark, d, "labels"), "quality", "toxic").select("n", *[rounded(c).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd, round(max(o_totalprice) - min(o_totalprice), 6) AS range FROM orders GROUP BY o_custkey")
def spread(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), rounded(F.avg(p)).alias("mean"), rounded(F.stddev_samp(p)).alias("sd"), rounded(F.max(p) - F.min(p)).alias("range"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal),
r AS (SELECT (rank() OVER (ORDER BY c_acctbal) + rank() OVER (ORDER BY c_acctbal) + (SELECT count(*) FROM c x WHERE x.c_acctbal = c.c_acctbal) - 1) / 2.0 AS a, (2 * rank() OVER (ORDER BY n) + count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM c)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation; ties get their mean rank.  Ranks come from counts of distinct values, added up range by range."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(o, "c_custkey", "left").select("c_acctbal", F.coalesce("n", F.lit(0)).alias("n"))

    ranked = rows.join(mean_ranks(rows, "c_acctbal", "a"), "c_acctbal").join(mean_ranks(rows, "n", "b"), "n")
    return ranked.agg(F.count("*").alias("n"), rounded(F.corr("a", "b")).alias("rho"))


_DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"


@query(f"SELECT {_DAY} AS day, count(DISTINCT user_id) AS dau, count(*) AS n FROM events GROUP BY 1")
def dau(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("user_id").alias("dau"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS mau FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def mau(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 30 DAYS")).agg(F.countDistinct("user_id").alias("mau"))  # one row


@query(f"""WITH f AS (SELECT user_id, min(date_trunc('week', ts)) AS cohort FROM events GROUP BY user_id), a AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS week FROM events)
SELECT CAST(CAST(cohort AS DATE) AS VARCHAR) AS cohort, CAST(date_diff('day', cohort, week) / 7 AS INT) AS week_no, count(*) AS users FROM a JOIN f USING (user_id) GROUP BY 1, 2""")
def retention_cohort(spark: SparkSession, d: str) -> DataFrame:
    weeks = table(spark, d, "events").select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).distinct()
    first = weeks.groupBy("user_id").agg(F.min("week").alias("cohort"))
    return weeks.join(first, "user_id").groupBy(F.col("cohort").cast("string").alias("cohort"), (F.datediff("week", "cohort") / 7).cast("int").alias("week_no")).agg(F.count("*").alias("users"))


@query("""WITH s AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT count(*) AS signed_up, count(*) FILTER (EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts >= s.at AND e.ts < s.at + INTERVAL 7 DAY)) AS activated FROM s""")
def activation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    signed = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("at"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    active = signed.join(bought, "user_id").where("bought >= at AND bought < at + INTERVAL 7 DAYS").select("user_id").distinct().withColumn("active", F.lit(1))
    return signed.join(active, "user_id", "left").agg(F.count("*").alias("signed_up"), F.count("active").alias("activated"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') >= 3")
def power_users(spark: SparkSession, d: str) -> DataFrame:
    """Users with three purchases or more."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("bought"))
    return by.where("bought >= 3").drop("bought")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def feature_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), rounded(F.avg("value")).alias("mean"))


@query("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS cost, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 9) AS share FROM orders GROUP BY o_custkey")
def cost_share(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    total = o.agg(F.sum("o_totalprice").alias("total"))
    by = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("cost"))
    return by.join(F.broadcast(total)).select("o_custkey", "orders", rounded("cost", 2).alias("cost"), rounded(F.col("cost") / F.col("total"), 9).alias("share"))  # one row


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS change FROM orders")
def timeline_lag(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", rounded(F.col("o_totalprice") - before).alias("change"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def section_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) >= 5 AND avg(c_acctbal) > 0")
def domain_having(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("mean")).where("customers >= 5 AND mean > 0").withColumn("mean", rounded("mean", 4))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM lineitem")
def prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    run = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", run.cast("long").alias("so_far"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return latest_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def first_per_order(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey", "l_shipdate")


_MEASURED = """m AS (SELECT c_mktsegment AS sink, o_orderdate AS day, o_orderpriority AS ident, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean, CASE WHEN min(o_orderstatus) <> 'P' THEN round(min(o_totalprice), 4) END AS low
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT sink, day, ident, 'n' AS metric, n AS value FROM m UNION ALL SELECT sink, day, ident, 'mean', mean FROM m UNION ALL SELECT sink, day, ident, 'least', low FROM m WHERE low IS NOT NULL)"""


@query(f"""WITH {_MEASURED}, newest AS (SELECT l.* FROM l JOIN (SELECT sink, max(day) AS day FROM l GROUP BY sink) USING (sink, day)),
earlier AS (SELECT n.sink, n.ident, max(l.day) AS day FROM newest n JOIN l ON l.sink = n.sink AND l.ident = n.ident AND l.day < n.day GROUP BY ALL)
SELECT n.sink, n.ident AS identity, n.metric, b.value AS baseline, n.value, CASE WHEN e.day IS NULL THEN 'new' WHEN b.value IS NULL THEN 'no_baseline'
  WHEN CASE n.metric WHEN 'n' THEN b.value - n.value > 1 WHEN 'mean' THEN n.value - b.value > 0.1 * abs(b.value) ELSE n.value - b.value > 50000 END THEN 'violation' ELSE 'ok' END AS verdict
FROM newest n LEFT JOIN earlier e USING (sink, ident) LEFT JOIN l b ON b.sink = n.sink AND b.ident = n.ident AND b.metric = n.metric AND b.day = e.day""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Segments as sinks, days as records, priorities as identities: the newest record's metrics against the last of the same identity."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    m = o.groupBy(F.col("c_mktsegment").alias("sink"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("identity")).agg(
        F.count("*").cast("double").alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean"), F.when(F.min("o_orderstatus") != "P", rounded(F.min("o_totalprice"), 4)).alias("least"))
    long = m.unpivot(["sink", "at", "identity"], ["n", "mean", "least"], "metric", "value").where("value IS NOT NULL")
    return gates.metric_regression(long, {"n": ("down", 1.0, False), "mean": ("up", 0.1, True), "least": ("up", 50000.0, False)})


@query("""WITH r AS (SELECT o_custkey AS cell, o_orderkey AS run, o_totalprice / 100000 AS overall, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
h AS (SELECT cell, max(overall) AS best FROM r WHERE age > 1 GROUP BY cell), f AS (SELECT cell, arg_min(run, place) AS best_run FROM r JOIN h USING (cell) WHERE age > 1 AND overall = best GROUP BY cell)
SELECT cell, round(best, 6) AS best, best_run, round(overall, 6) AS now, round(best - overall, 6) AS fell, best - overall > 0.5 AS failed FROM r JOIN h USING (cell) JOIN f USING (cell) WHERE age = 1""")
def best_ever(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order against the best one before: a fall of more than 0.5 fails, however many small steps made it."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_totalprice") / 100000).alias("overall"))
    last = rows.groupBy("cell").agg(F.max("at").alias("last"))
    marked = rows.join(last, "cell").withColumn("is_last", F.col("at") == F.col("last"))
    found = gates.best_regression(marked.where("is_last"), marked.where("NOT is_last"), 0.5)
    return found.select("cell", rounded("best").alias("best"), "best_run", rounded("now").alias("now"), rounded("fell").alias("fell"), "failed")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%build%' ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def ilike_page(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where(F.col("c_name").ilike("%00001%") | F.col("c_mktsegment").ilike("%build%")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, (SELECT count(*) FROM customer) AS total, 40 < (SELECT count(*) FROM customer) AS has_more FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def offset_paging(spark: SparkSession, d: str) -> DataFrame:
    return offset_page(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 20).select("c_custkey", "total", "has_more")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderstatus IN ('P', 'F')")
def null_status_filter(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").withColumn("status", status).where(status_filter(F.col("status"), "F", default="F")).select("o_orderkey", "status")


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(o, "custkey", "left_anti").distinct()


@query("SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("partkey")).intersect(l.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def rollup_join(spark: SparkSession, d: str) -> DataFrame:
    """Children joined to parents over three levels, then summed."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), rounded(F.sum("o_totalprice"), 2).alias("value"))
