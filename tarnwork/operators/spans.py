"""Spans of traces: parsing, linking, owners, usage, cost, concurrency and rules that find bad cases.

A span is a row (trace_id, span_id, parent_id, kind, name, start, stop, duration_ms, status, ...); times in seconds.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import dropped, stored
from . import traces

#: Bounds of the rules and their version.
SLOW_NODE_MS, MAX_INPUT_TOKENS, RULES_VERSION = 20_000.0, 20_000, "1"


def parse_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON lines as spans with ``reason``: NULL for a good line, else blank, not_json or missing:<field>.

    Names, kinds and statuses have defaults; a time or duration that is no number is NULL, never 0.
    """
    schema = "span_id string, trace_id string, parent_span_id string, name string, kind string, status string, start_time string, end_time string, duration_ms string, _bad string"
    r = lines.withColumn("r", F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_bad"}))
    blank = lambda c: F.coalesce(F.trim(f"r.{c}"), F.lit("")) == ""
    reason = (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "blank").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not_json")
        .when(blank("span_id"), "missing:span_id").when(blank("trace_id"), "missing:trace_id")
    )
    number = lambda c: F.expr(f"try_cast(r.{c} AS double)")
    text = lambda c, default: F.coalesce(F.nullif(F.trim(f"r.{c}"), F.lit("")), F.lit(default))
    return r.select(
        "*", reason.alias("reason"), F.col("r.span_id").alias("span_id"), F.col("r.trace_id").alias("trace_id"), F.nullif(F.col("r.parent_span_id"), F.lit("")).alias("parent_id"),
        text("name", "<unnamed>").alias("name"), text("kind", "node").alias("kind"), text("status", "OK").alias("status"),
        number("start_time").alias("start"), number("end_time").alias("stop"), number("duration_ms").alias("duration_ms"),
    ).drop("r")


def interval(start: Column, stop: Column, duration_ms: Column) -> tuple[Column, Column]:
    """Begin and end: a stop before the start counts as the start; without a stop the duration tells; NULL where incomplete."""
    end = F.when(start.isNotNull(), F.when(stop.isNotNull(), F.greatest(start, stop)).otherwise(start + duration_ms / 1000))
    return F.when(end.isNotNull(), start), end


def node_key(node: Column, name: Column, reviewer: Column) -> Column:
    """The node attribute, else the name; with its reviewer in brackets."""
    key = F.coalesce(F.nullif(node, F.lit("")), name)
    return F.when(reviewer.isNotNull() & (reviewer != ""), F.concat(key, F.lit("["), reviewer, F.lit("]"))).otherwise(key)


def link(spans: DataFrame, order: list[str]) -> DataFrame:
    """Of spans with the same id the first by ``order``; parent_id NULL where the parent is not there.

    Added: missing_parent (the id that is not there), is_root.
    """
    once = spans.withColumn("_r", F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(*order))).where("_r = 1").drop("_r")
    there = once.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"))
    found = once.join(there, (F.col("trace_id") == F.col("_t")) & (F.col("parent_id") == F.col("_s")), "left")
    return (
        found.withColumn("missing_parent", F.when(F.col("_s").isNull(), F.col("parent_id"))).withColumn("parent_id", F.col("_s"))
        .withColumn("is_root", F.col("parent_id").isNull()).drop("_t", "_s")
    )


def nearest_known(linked: DataFrame, value: Column) -> DataFrame:
    """(trace_id, span_id, value): the span's own value, else that of the nearest ancestor that has one (NULL: none, or a cycle)."""
    return nearest_values(linked, {"value": value})


def nearest_values(linked: DataFrame, values: dict[str, Column], also: list[str] | None = None) -> DataFrame:
    """(trace_id, span_id, *also, *values): each by itself as ``nearest_known``, found together; ``also``: columns of the span that stay.

    Pointer doubling: each round joins every open span to the one its pointer has reached, so a depth of n takes log2(n)
    joins, whatever the shape of the trees and the number of values; spans that know all, or have reached a root, are not joined any more.
    """
    names, kept = list(values), ["trace_id", "span_id", *(also or [])]

    def going(known: list[Column], up: Column) -> Column:
        unknown = F.lit(False)
        for c in known:
            unknown |= c.isNull()
        return F.when(unknown, up).alias("up")

    now = stored(linked.select(*kept, going(list(values.values()), F.col("parent_id")), *[c.alias(n) for n, c in values.items()]))
    rounds = 1 + ceil(log2(1 + now.count()))
    while rounds and not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"), *[F.col(n).alias(f"_{n}") for n in names])
        step = now.where("up IS NOT NULL").join(above, (F.col("trace_id") == F.col("_t")) & (F.col("up") == F.col("_s")), "left")
        got = [F.coalesce(n, f"_{n}") for n in names]
        moved = step.select(*kept, going(got, F.col("_up")), *[c.alias(n) for n, c in zip(names, got)])
        nxt = stored(moved.unionByName(now.where("up IS NULL")))
        dropped(now)
        now, rounds = nxt, rounds - 1
    return now.select(*kept, *names)


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, calls without any usage, tokens and the share of cached input (NULL without input) of each key."""
    no_usage = F.col("input_tokens").isNull() & F.col("output_tokens").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(no_usage).alias("no_usage"), *[total(f"{c}_tokens").alias(c) for c in ("input", "output", "cached")])
    return sums.withColumn("cache_hit_rate", F.when(F.col("input") > 0, F.col("cached") / F.col("input")))


def cost(model: Column, prompt: Column, completion: Column, cached: Column, prices: dict[str, tuple[float, float | None, float]]) -> Column:
    """Dollars of a call by prices per 1,000 tokens (input, cached input, output); NULL if a rate that is needed is not known."""
    rate = lambda i: F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(p[i]).cast("double"))])[model]
    held = F.coalesce(cached, F.lit(0))
    part = lambda n, i: F.when(n == 0, 0.0).otherwise(n * rate(i) / 1000)
    return F.when(rate(0).isNotNull(), part(F.coalesce(prompt, F.lit(0)) - held, 0) + part(held, 1) + part(F.coalesce(completion, F.lit(0)), 2))


def priced_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the known costs, how many are not known, whether all are, and the unpriced calls of each model (``usd``, ``model``)."""
    why = calls.where("usd IS NULL").groupBy(*keys, F.coalesce("model", F.lit("<unknown model>")).alias("m")).agg(F.count("*").alias("n"))
    reasons = why.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "m", "n"))), ",").alias("unpriced_models"))
    sums = calls.groupBy(*keys).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"))
    return sums.join(reasons, keys, "left").withColumns({"complete": F.col("unpriced") == 0, "unpriced_models": F.coalesce("unpriced_models", F.lit(""))})


def sibling_concurrency(children: DataFrame) -> DataFrame:
    """(trace_id, parent_id, n, concurrency): summed time of a parent's children over the time that any runs; two children at least."""
    spans = children.where("parent_id IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    merged = traces.interval_union(spans, ["trace_id", "parent_id"])
    n = spans.groupBy("trace_id", "parent_id").agg(F.count("*").alias("n"))
    joined = merged.join(n, ["trace_id", "parent_id"]).where("n >= 2")
    return joined.select("trace_id", "parent_id", "n", F.when(F.col("covered") > 0, F.col("busy") / F.col("covered")).alias("concurrency"))


def llm_share(spans: DataFrame) -> DataFrame:
    """(trace_id, wall, llm_sum, llm_union, share): the calls' summed and merged time against the trace's wall time."""
    timed = spans.where("start IS NOT NULL AND stop IS NOT NULL")
    wall = timed.groupBy("trace_id").agg((F.max("stop") - F.min("start")).alias("wall"))
    calls = traces.interval_union(timed.where("kind = 'llm_call'"), ["trace_id"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wall.join(calls, "trace_id", "left").select("trace_id", "wall", zero("busy").alias("llm_sum"), zero("covered").alias("llm_union"), F.when(F.col("wall") > 0, zero("covered") / F.col("wall")).alias("share"))


def rule_hits(linked: DataFrame) -> DataFrame:
    """(rule, trace_id, span_id, why) of every rule that a span breaks; one pass over the spans."""
    ok, call = F.upper("status") == "OK", F.col("kind") == "llm_call"
    wall = F.coalesce(F.col("duration_ms"), (F.col("stop") - F.col("start")) * 1000)
    whole = lambda c: c.cast("long").cast("string")
    rules = {
        "span_error": (~ok | F.col("exception").isNotNull(), F.concat(F.lit("status="), F.col("status"), F.coalesce(F.concat(F.lit(" exception="), F.col("exception")), F.lit("")))),
        "empty_llm_output": (call & ok & (F.coalesce("output_tokens", F.lit(0)) <= 0), F.when(F.col("output_tokens").isNull(), "no output_tokens attribute on a completed call").otherwise("output_tokens=0")),
        "slow_node": ((F.col("kind") == "node") & (wall >= SLOW_NODE_MS), F.concat(F.lit("wall "), whole(F.bround(wall)), F.lit(f" ms >= {SLOW_NODE_MS:.0f} ms"))),
        "oversized_prompt": (call & (F.col("input_tokens") >= MAX_INPUT_TOKENS), F.concat(F.lit("input_tokens "), whole(F.col("input_tokens")), F.lit(f" >= {MAX_INPUT_TOKENS}"))),
        "retry_path": (F.col("attempt") >= 1, F.concat(F.lit("llm attempt index "), whole(F.col("attempt")), F.lit(" (call was retried)"))),
        "incomplete_trace": (F.col("missing_parent").isNotNull(), F.concat(F.lit("parent span "), F.col("missing_parent").cast("string"), F.lit(" absent -- enclosing span never completed"))),
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(r).alias("rule"), why.alias("why"))) for r, (cond, why) in rules.items()]))
    return linked.select("trace_id", "span_id", F.explode(hits).alias("h")).select("h.rule", "trace_id", "span_id", "h.why")


def case_fingerprint(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts, each closed by a zero byte; NULL is empty."""
    return F.substring(F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in (F.lit(RULES_VERSION), *parts)]), 256), 1, 16)


def origin(paper: Column, fixture: Column, draft: Column, run: Column) -> Column:
    """Where a span comes from, by what its nearest ancestors know."""
    return F.when(paper.isNotNull() | fixture.isNotNull(), "eval").when(draft.isNotNull() | run.isNotNull(), "production").otherwise("unknown")


def new_cases(cases: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Cases with ``outcome``: known (their fingerprint is in ``known``), repeated (not the first of this batch), new."""
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order)) == 1
    marked = cases.withColumn("_first", first).join(known.select(F.col("fingerprint").alias("_k")).distinct(), F.col("fingerprint") == F.col("_k"), "left")
    return marked.withColumn("outcome", F.when(F.col("_k").isNotNull(), "known").when(F.col("_first"), "new").otherwise("repeated")).drop("_first", "_k")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
