"""Trace reports over the events: each user's events are a trace, a tree of three spans below each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import spans as S
from ..sources.stored import stored
from ..sources.tables import table
from .registry import query

#: Prices per 1,000 tokens: input, cached input (NULL: not known), output.
PRICES = {"m-0": (0.01, 0.005, 0.03), "m-1": (0.002, None, 0.006), "m-req": (0.1, 0.05, 0.2)}

_SPANS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, CAST(nullif(regexp_extract(props, '[0-9]+'), '') AS INT) AS k FROM events),
raw_spans AS (SELECT e.user_id AS trace_id, e.event_id AS span_id, CASE WHEN e.r = 0 THEN NULL WHEN e.event_id % 50 = 7 THEN -e.event_id ELSE p.event_id END AS parent_named,
  CASE e.event_type WHEN 'purchase' THEN 'llm_call' WHEN 'signup' THEN 'node' WHEN 'view' THEN 'node' ELSE 'tool' END AS kind, e.event_type AS name,
  CASE WHEN e.event_type IN ('signup', 'view') AND e.k % 4 > 0 THEN e.event_type || '_' || (e.k % 3) END AS node, CASE WHEN e.k % 2 = 0 THEN 'r' || (e.k % 4) END AS reviewer,
  epoch_us(e.ts) / 1e6 AS began, CASE WHEN e.event_id % 11 > 0 THEN epoch_us(e.ts) / 1e6 + e.value - 1 END AS ended, CASE WHEN e.event_id % 13 > 0 THEN e.value * 1000 END AS duration_ms,
  CASE WHEN e.event_type = 'error' THEN 'ERROR' WHEN e.k % 10 = 0 THEN 'ok' ELSE 'OK' END AS status, CASE WHEN e.event_type = 'click' AND e.k % 20 = 3 THEN 'Timeout' END AS exception,
  CASE WHEN e.event_type = 'purchase' AND e.k % 9 > 0 THEN e.k * 400 END AS input_tokens, CASE WHEN e.event_type = 'purchase' AND e.k % 7 > 0 THEN CASE WHEN e.k % 7 = 1 THEN 0 ELSE e.k END END AS output_tokens,
  CASE WHEN e.event_type = 'purchase' AND e.k % 3 > 0 THEN e.k * 100 END AS cached_tokens, CASE WHEN e.k % 4 > 0 THEN 'm-' || (e.k % 3) END AS response_model, CASE WHEN e.k % 8 > 0 THEN 'm-req' END AS request_model,
  CASE WHEN e.k % 25 = 24 THEN 1 WHEN e.k % 2 = 0 THEN 0 END AS attempt, CASE WHEN e.k % 5 = 0 THEN 'p' || (e.k % 10) END AS paper, CASE WHEN e.k % 5 = 1 THEN 'd' || (e.k % 10) END AS draft
  FROM ranked e LEFT JOIN ranked p ON p.user_id = e.user_id AND p.r = (e.r - 1) // 3),
spans AS (SELECT s.*, p.span_id AS parent_id, CASE WHEN p.span_id IS NULL THEN s.parent_named END AS missing_parent, CASE WHEN coalesce(s.ended, s.began + s.duration_ms / 1000) IS NOT NULL THEN s.began END AS start,
  CASE WHEN s.ended IS NOT NULL THEN greatest(s.began, s.ended) ELSE s.began + s.duration_ms / 1000 END AS stop
  FROM raw_spans s LEFT JOIN raw_spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_named)"""
_WALK = """walk AS (SELECT trace_id, span_id, span_id AS here, 0 AS depth FROM spans UNION ALL SELECT w.trace_id, w.span_id, s.parent_id, w.depth + 1 FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.span_id = w.here WHERE s.parent_id IS NOT NULL)"""
_OWNER = f"""{_WALK}, owners AS (SELECT w.trace_id, w.span_id, arg_min(s.span_id, w.depth) AS owner FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.span_id = w.here WHERE s.kind = 'node' GROUP BY ALL),
keyed AS (SELECT s.*, coalesce(s.node, s.name) || coalesce('[' || s.reviewer || ']', '') AS key FROM spans s)"""
_PRICED = """priced AS (SELECT s.*, coalesce(response_model, request_model) AS model, CASE coalesce(response_model, request_model) WHEN 'm-0' THEN 0.01 WHEN 'm-1' THEN 0.002 WHEN 'm-req' THEN 0.1 END AS pi,
  CASE coalesce(response_model, request_model) WHEN 'm-0' THEN 0.005 WHEN 'm-req' THEN 0.05 END AS pc, CASE coalesce(response_model, request_model) WHEN 'm-0' THEN 0.03 WHEN 'm-1' THEN 0.006 WHEN 'm-req' THEN 0.2 END AS po,
  coalesce(input_tokens, 0) - coalesce(cached_tokens, 0) AS fresh FROM spans s WHERE kind = 'llm_call'),
costs AS (SELECT *, CASE WHEN pi IS NOT NULL THEN CASE WHEN fresh = 0 THEN 0 ELSE fresh * pi / 1000 END + CASE WHEN coalesce(cached_tokens, 0) = 0 THEN 0 ELSE cached_tokens * pc / 1000 END + CASE WHEN coalesce(output_tokens, 0) = 0 THEN 0 ELSE output_tokens * po / 1000 END END AS usd FROM priced)"""


def named_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans as their source names them: ``parent_id`` may be a span that is not there."""
    k = F.col("k")
    e = table(spark, d, "events").withColumns({
        "r": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1, "k": F.nullif(F.regexp_extract("props", "[0-9]+", 0), F.lit("")).cast("int")})
    above = e.select(F.col("user_id").alias("_u"), F.col("r").alias("_r"), F.col("event_id").alias("_above"))
    e = e.join(above, (F.col("user_id") == F.col("_u")) & (F.floor((F.col("r") - 1) / 3) == F.col("_r")), "left")
    kind, at, value = F.col("event_type"), F.unix_micros("ts") / 1e6, F.col("value")
    call = kind == "purchase"
    numbered = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    start, stop = S.interval(at, F.when(F.col("event_id") % 11 > 0, at + value - 1), F.when(F.col("event_id") % 13 > 0, value * 1000))
    return e.select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.when(F.col("r") > 0, F.when(F.col("event_id") % 50 == 7, -F.col("event_id")).otherwise(F.col("_above"))).alias("parent_id"),
        F.when(call, "llm_call").when(kind.isin("signup", "view"), "node").otherwise("tool").alias("kind"), kind.alias("name"),
        F.when(kind.isin("signup", "view") & (k % 4 > 0), F.concat(kind, numbered("_", 3))).alias("node"), F.when(k % 2 == 0, numbered("r", 4)).alias("reviewer"),
        start.alias("start"), stop.alias("stop"), F.when(F.col("event_id") % 13 > 0, value * 1000).alias("duration_ms"),
        F.when(kind == "error", "ERROR").when(k % 10 == 0, "ok").otherwise("OK").alias("status"), F.when((kind == "click") & (k % 20 == 3), "Timeout").alias("exception"),
        F.when(call & (k % 9 > 0), k * 400).alias("input_tokens"), F.when(call & (k % 7 > 0), F.when(k % 7 == 1, 0).otherwise(k)).alias("output_tokens"), F.when(call & (k % 3 > 0), k * 100).alias("cached_tokens"),
        F.coalesce(F.when(k % 4 > 0, numbered("m-", 3)), F.when(k % 8 > 0, F.lit("m-req"))).alias("model"),
        F.when(k % 25 == 24, 1).when(k % 2 == 0, 0).alias("attempt"), F.when(k % 5 == 0, numbered("p", 10)).alias("paper"), F.when(k % 5 == 1, numbered("d", 10)).alias("draft"),
    )


def linked_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.link(named_spans(spark, d), ["start"])


def _owned(linked: DataFrame) -> DataFrame:
    """Spans with the key of the node that owns them: the nearest node at or above them, else their own."""
    key = S.node_key(F.col("node"), F.col("name"), F.col("reviewer"))
    found = linked.join(S.nearest_known(linked, F.when(F.col("kind") == "node", key)), ["trace_id", "span_id"])
    return found.withColumn("owner", F.coalesce("value", key)).drop("value")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    usd = S.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), PRICES)
    return linked_spans(spark, d).where("kind = 'llm_call'").withColumn("usd", usd)


@query(f"WITH {_SPANS} SELECT trace_id, count(*) AS n_spans, count(*) FILTER (parent_id IS NULL) AS n_roots, count(missing_parent) AS n_orphans, max(missing_parent) AS last_missing FROM spans GROUP BY trace_id")
def parent_child_link(spark: SparkSession, d: str) -> DataFrame:
    return linked_spans(spark, d).groupBy("trace_id").agg(
        F.count("*").alias("n_spans"), F.count_if("is_root").alias("n_roots"), F.count("missing_parent").alias("n_orphans"), F.max("missing_parent").alias("last_missing"))


@query(f"WITH {_SPANS} SELECT span_id, round(start, 3) AS start, round(stop, 3) AS stop, coalesce(node, name) || coalesce('[' || reviewer || ']', '') AS node_key FROM spans")
def span_interval(spark: SparkSession, d: str) -> DataFrame:
    key = S.node_key(F.col("node"), F.col("name"), F.col("reviewer"))
    return named_spans(spark, d).select("span_id", rounded("start", 3).alias("start"), rounded("stop", 3).alias("stop"), key.alias("node_key"))


@query(f"""WITH RECURSIVE {_SPANS}, {_WALK}, papers AS (SELECT w.trace_id, w.span_id, arg_min(s.paper, w.depth) AS paper FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.span_id = w.here WHERE s.paper IS NOT NULL GROUP BY ALL)
SELECT span_id, papers.paper FROM spans LEFT JOIN papers USING (trace_id, span_id)""")
def attr_ancestor_lookup(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_known(linked_spans(spark, d), F.col("paper")).select("span_id", F.col("value").alias("paper"))


@query(f"""WITH RECURSIVE {_SPANS}, {_OWNER} SELECT s.span_id, coalesce(k.key, m.key) AS owner FROM spans s JOIN keyed m USING (trace_id, span_id) LEFT JOIN owners o USING (trace_id, span_id) LEFT JOIN keyed k ON k.trace_id = o.trace_id AND k.span_id = o.owner""")
def owning_node_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return _owned(linked_spans(spark, d)).select("span_id", "owner")


_USAGE = """count(*) AS calls, count(*) FILTER (input_tokens IS NULL AND output_tokens IS NULL) AS no_usage, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output,
CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached, round(CASE WHEN sum(input_tokens) > 0 THEN coalesce(sum(cached_tokens), 0) / sum(input_tokens) END, 6) AS cache_hit_rate"""


@query(f"""WITH RECURSIVE {_SPANS}, {_OWNER} SELECT coalesce(k.key, m.key) AS owner, {_USAGE.replace("input_tokens", "s.input_tokens").replace("output_tokens", "s.output_tokens").replace("cached_tokens", "s.cached_tokens")}
FROM spans s JOIN keyed m USING (trace_id, span_id) LEFT JOIN owners o USING (trace_id, span_id) LEFT JOIN keyed k ON k.trace_id = o.trace_id AND k.span_id = o.owner WHERE s.kind = 'llm_call' GROUP BY 1""")
def tokens_by_node(spark: SparkSession, d: str) -> DataFrame:
    return S.usage(_owned(linked_spans(spark, d)).where("kind = 'llm_call'"), ["owner"]).withColumn("cache_hit_rate", rounded("cache_hit_rate"))


@query(f"WITH {_SPANS} SELECT coalesce(response_model, request_model, '<unknown model>') AS model, {_USAGE} FROM spans WHERE kind = 'llm_call' GROUP BY 1")
def tokens_by_model(spark: SparkSession, d: str) -> DataFrame:
    calls = named_spans(spark, d).where("kind = 'llm_call'").withColumn("model", F.coalesce("model", F.lit("<unknown model>")))
    return S.usage(calls, ["model"]).withColumn("cache_hit_rate", rounded("cache_hit_rate"))


@query(f"WITH {_SPANS} SELECT {_USAGE} FROM spans WHERE kind = 'llm_call'")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.usage(named_spans(spark, d).where("kind = 'llm_call'"), []).withColumn("cache_hit_rate", rounded("cache_hit_rate"))


@query(f"WITH {_SPANS}, {_PRICED} SELECT span_id, coalesce(response_model, request_model) AS model, round(usd, 6) AS usd FROM costs")
def price_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("span_id", "model", rounded("usd").alias("usd"))


@query(f"""WITH {_SPANS}, {_PRICED}, why AS (SELECT trace_id, string_agg(m || ':' || n, ',' ORDER BY m || ':' || n) AS models FROM (SELECT trace_id, coalesce(model, '<unknown model>') AS m, count(*) AS n FROM costs WHERE usd IS NULL GROUP BY ALL) GROUP BY trace_id)
SELECT trace_id, round(coalesce(sum(usd), 0), 6) AS usd, count(*) FILTER (usd IS NULL) AS unpriced, count(*) FILTER (usd IS NULL) = 0 AS complete, coalesce(max(models), '') AS unpriced_models FROM costs LEFT JOIN why USING (trace_id) GROUP BY trace_id""")
def run_cost(spark: SparkSession, d: str) -> DataFrame:
    return S.priced_totals(_calls(spark, d), ["trace_id"]).withColumn("usd", rounded("usd"))


@query(f"""WITH RECURSIVE {_SPANS}, {_PRICED}, {_OWNER} SELECT coalesce(k.key, m.key) AS owner, round(coalesce(sum(usd), 0), 6) AS usd, count(*) FILTER (usd IS NULL) AS unpriced
FROM costs c JOIN keyed m USING (trace_id, span_id) LEFT JOIN owners o USING (trace_id, span_id) LEFT JOIN keyed k ON k.trace_id = o.trace_id AND k.span_id = o.owner GROUP BY 1""")
def cost_by_node(spark: SparkSession, d: str) -> DataFrame:
    owned = _owned(linked_spans(spark, d)).where("kind = 'llm_call'")
    priced = owned.withColumn("usd", S.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), PRICES))
    return S.priced_totals(priced, ["owner"]).select("owner", rounded("usd").alias("usd"), "unpriced")


_UNION = """m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY {k} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM timed),
i AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m), u AS (SELECT {k}, sum(b - a) AS covered FROM (SELECT {k}, island, min(start) AS a, max(stop) AS b FROM i GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {_SPANS}, timed AS (SELECT * FROM spans WHERE parent_id IS NOT NULL AND start IS NOT NULL), {_UNION.format(k='trace_id, parent_id')}
SELECT trace_id, parent_id, count(*) AS n, round(CASE WHEN max(covered) > 0 THEN sum(stop - start) / max(covered) END, 6) AS concurrency FROM timed JOIN u USING (trace_id, parent_id) GROUP BY trace_id, parent_id HAVING count(*) >= 2""")
def sibling_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return S.sibling_concurrency(linked_spans(spark, d)).withColumn("concurrency", rounded("concurrency"))


@query(f"""WITH {_SPANS}, timed AS (SELECT * FROM spans WHERE kind = 'llm_call' AND start IS NOT NULL), {_UNION.format(k='trace_id')}, w AS (SELECT trace_id, max(stop) - min(start) AS wall FROM spans WHERE start IS NOT NULL GROUP BY trace_id),
b AS (SELECT trace_id, sum(stop - start) AS busy FROM timed GROUP BY trace_id)
SELECT trace_id, round(wall, 3) AS wall, round(coalesce(busy, 0), 3) AS llm_sum, round(coalesce(covered, 0), 3) AS llm_union, round(CASE WHEN wall > 0 THEN coalesce(covered, 0) / wall END, 6) AS share FROM w LEFT JOIN u USING (trace_id) LEFT JOIN b USING (trace_id)""")
def llm_share(spark: SparkSession, d: str) -> DataFrame:
    return S.llm_share(named_spans(spark, d)).select("trace_id", *[rounded(c, 3).alias(c) for c in ("wall", "llm_sum", "llm_union")], rounded("share").alias("share"))


_RULES = """rules AS (SELECT 'span_error' AS rule, trace_id, span_id, 'status=' || status || coalesce(' exception=' || exception, '') AS why FROM spans WHERE upper(status) <> 'OK' OR exception IS NOT NULL
UNION ALL SELECT 'empty_llm_output', trace_id, span_id, CASE WHEN output_tokens IS NULL THEN 'no output_tokens attribute on a completed call' ELSE 'output_tokens=0' END FROM spans WHERE kind = 'llm_call' AND upper(status) = 'OK' AND coalesce(output_tokens, 0) <= 0
UNION ALL SELECT 'slow_node', trace_id, span_id, 'wall ' || CAST(round_even(wall, 0) AS BIGINT) || ' ms >= 20000 ms' FROM (SELECT *, coalesce(duration_ms, (stop - start) * 1000) AS wall FROM spans) WHERE kind = 'node' AND wall >= 20000
UNION ALL SELECT 'oversized_prompt', trace_id, span_id, 'input_tokens ' || input_tokens || ' >= 20000' FROM spans WHERE kind = 'llm_call' AND input_tokens >= 20000
UNION ALL SELECT 'retry_path', trace_id, span_id, 'llm attempt index ' || attempt || ' (call was retried)' FROM spans WHERE attempt >= 1
UNION ALL SELECT 'incomplete_trace', trace_id, span_id, 'parent span ' || missing_parent || ' absent -- enclosing span never completed' FROM spans WHERE missing_parent IS NOT NULL)"""


@query(f"WITH {_SPANS}, {_RULES} SELECT * FROM rules")
def trace_rule_mine(spark: SparkSession, d: str) -> DataFrame:
    return S.rule_hits(linked_spans(spark, d))


_NEAREST = """nearest AS (SELECT w.trace_id, w.span_id, arg_min(s.paper, w.depth) FILTER (s.paper IS NOT NULL) AS paper, arg_min(s.draft, w.depth) FILTER (s.draft IS NOT NULL) AS draft, arg_min(s.reviewer, w.depth) FILTER (s.reviewer IS NOT NULL) AS reviewer,
  arg_min(s.node, w.depth) FILTER (s.node IS NOT NULL) AS node FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.span_id = w.here GROUP BY ALL),
identity AS (SELECT s.trace_id, s.span_id, coalesce(n.node, s.name) AS node, n.reviewer, n.paper, n.draft, coalesce(s.response_model, s.request_model) AS model, CASE WHEN n.paper IS NOT NULL THEN 'eval' WHEN n.draft IS NOT NULL THEN 'production' ELSE 'unknown' END AS origin
  FROM spans s JOIN nearest n USING (trace_id, span_id))"""


def identities(linked: DataFrame) -> DataFrame:
    """(trace_id, span_id, node, reviewer, paper, draft, model, origin): each attribute from the span or its nearest ancestor that has it."""
    found = S.nearest_values(linked, {c: F.col(c) for c in ("node", "reviewer", "paper", "draft")}, ["name", "model"])
    none = F.lit(None).cast("string")
    return found.select("trace_id", "span_id", F.coalesce("node", "name").alias("node"), "reviewer", "paper", "draft", "model", S.origin(F.col("paper"), none, F.col("draft"), none).alias("origin"))


@query(f"WITH RECURSIVE {_SPANS}, {_WALK}, {_NEAREST} SELECT * FROM identity")
def span_identity(spark: SparkSession, d: str) -> DataFrame:
    return identities(linked_spans(spark, d))


@query(f"""WITH RECURSIVE {_SPANS}, {_WALK}, {_NEAREST}, {_RULES},
cases AS (SELECT rule, span_id, substr(sha256('1' || chr(0) || rule || chr(0) || node || chr(0) || coalesce(reviewer, '') || chr(0) || coalesce(paper, draft, '') || chr(0) || coalesce(model, '') || chr(0)), 1, 16) AS fingerprint FROM rules JOIN identity USING (trace_id, span_id)),
known AS (SELECT DISTINCT fingerprint FROM cases WHERE span_id % 10 = 0)
SELECT rule, span_id, fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM known) THEN 'known' WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY span_id) = 1 THEN 'new' ELSE 'repeated' END AS outcome FROM cases""")
def case_dedup_append(spark: SparkSession, d: str) -> DataFrame:
    """Cases by fingerprint; those of every tenth span stand for the manifest of earlier batches."""
    linked = stored(linked_spans(spark, d))
    target = F.coalesce("paper", "draft")
    cases = S.rule_hits(linked).join(identities(linked), ["trace_id", "span_id"]).select("rule", "span_id", S.case_fingerprint(F.col("rule"), F.col("node"), F.col("reviewer"), target, F.col("model")).alias("fingerprint"))
    return S.new_cases(cases, cases.where("span_id % 10 = 0"), ["span_id"])


@query("""WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_id % 17 = 0 THEN 'blank' WHEN event_id % 17 = 1 THEN 'not_json' WHEN event_id % 17 = 2 THEN 'missing:span_id' WHEN event_id % 17 = 3 THEN 'missing:trace_id' END AS reason, event_id % 17 AS m FROM events)
SELECT coalesce(reason, 'good') AS outcome, count(*) AS n, count(*) FILTER (reason IS NULL AND m <> 4 AND value IS NOT NULL) AS timed, count(*) FILTER (reason IS NULL AND m = 5) AS unnamed FROM e GROUP BY 1""")
def span_scan(spark: SparkSession, d: str) -> DataFrame:
    """The events written as JSON lines, some damaged, and read as spans."""
    m, e = F.col("event_id") % 17, table(spark, d, "events")
    fields = F.struct(
        F.when(m != 2, F.col("event_id").cast("string")).otherwise("").alias("span_id"), F.when(m != 3, F.col("user_id").cast("string")).alias("trace_id"), F.when(m != 5, F.col("event_type")).alias("name"),
        F.when(m == 4, F.lit("soon")).otherwise(F.col("value").cast("string")).alias("start_time"))
    raw = F.when(m == 0, "  ").when(m == 1, F.substring(F.to_json(fields), 1, 20)).otherwise(F.to_json(fields))
    parsed = S.parse_lines(e.select(raw.alias("raw")))
    good = F.col("reason").isNull()
    return parsed.groupBy(F.coalesce("reason", F.lit("good")).alias("outcome")).agg(
        F.count("*").alias("n"), F.count_if(good & F.col("start").isNotNull()).alias("timed"), F.count_if(good & (F.col("name") == "<unnamed>")).alias("unnamed"))
