"""Gate calibration, agreement of raters, retrieval diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import calibration, gates, retrieval
from ..operators.relational import latest_wins
from ..sources.tables import table
from .analytics import _SCORED, _scored
from .registry import query
from .retrieval import _PAIRS, _RUN, _run_and_qrels, _vectors

_SHARES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END END, 6) AS f1"""
_CELLS = "count(*) FILTER (({p}) AND y = 1) AS tp, count(*) FILTER (({p}) AND y = 0) AS fp, count(*) FILTER (NOT ({p}) AND y = 1) AS fn, count(*) FILTER (NOT ({p}) AND y = 0) AS tn"


def _rounded_shares(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in ("precision", "recall", "f1", *more)})


@query(f"""WITH {_SCORED}, c AS (SELECT {_CELLS.format(p='score >= 0.5')}, avg(y) AS base FROM scored)
SELECT CAST(tp AS BIGINT) AS tp, fp, fn, tn, {_SHARES}, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fp_rate, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END, 6) AS fn_rate, round(base, 6) AS base_rate, 1.0 * fp + 3.0 * fn AS cost FROM c""")
def point_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every figure of one threshold, with the base rate and the expected cost of its errors."""
    rows = _scored(spark, d)
    c = _rounded_shares(gates.confusion(rows, [], F.col("score") >= 0.5), "fp_rate", "fn_rate").withColumn("cost", 1.0 * F.col("fp") + 3.0 * F.col("fn"))
    return c.join(F.broadcast(rows.agg(rounded(F.avg("y")).alias("base_rate"))))  # one row


_JOINT = """r AS (SELECT quality AS y, CASE WHEN doc_id % 11 > 0 THEN least(20, n_chars // 200) / 20.0 END AS a, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 25) / 25.0 END AS b FROM labels JOIN documents USING (doc_id)),
u AS (SELECT * FROM r WHERE a IS NOT NULL AND b IS NOT NULL), ta AS (SELECT DISTINCT a AS ta FROM u), tb AS (SELECT DISTINCT b AS tb FROM u)"""


def _joint_rows(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select(
        "doc_id", F.col("quality").alias("y"), F.when(F.col("doc_id") % 11 > 0, F.least(F.lit(20), F.floor(F.col("n_chars") / 200)) / 20.0).alias("a"),
        F.when(F.col("doc_id") % 9 > 0, (F.col("doc_id") % 25) / 25.0).alias("b"))


@query(f"""WITH {_JOINT}, c AS (SELECT ta, tb, {_CELLS.format(p='a < ta OR b < tb')} FROM u, ta, tb GROUP BY ta, tb)
SELECT round(ta, 6) AS ta, round(tb, 6) AS tb, tp, fp, fn, tn, {_SHARES}, 1.0 * fp + 2.0 * fn AS cost FROM c""")
def joint_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Two predictors joined by OR, over the grid of both their thresholds."""
    s = gates.joint_sweep(_joint_rows(spark, d), "a", "b", 1.0, 2.0)
    return _rounded_shares(s).select(rounded("ta").alias("ta"), rounded("tb").alias("tb"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], "precision", "recall", "f1", "cost")


@query(f"""WITH {_JOINT}, g AS (SELECT y, NOT (a >= 0.55 AND b >= 0.5) AS held FROM r WHERE a IS NOT NULL AND b IS NOT NULL), c AS (SELECT {_CELLS.format(p='held')}, count(*) AS n FROM g) SELECT n, tp, fp, fn, tn, {_SHARES}, 1.0 * fp + 2.0 * fn AS cost FROM c""")
def gate_as_shipped(spark: SparkSession, d: str) -> DataFrame:
    """A recorded verdict against the labels; rows without a verdict are left out."""
    rows = _joint_rows(spark, d).withColumn("held", ~((F.col("a") >= 0.55) & (F.col("b") >= 0.5))).where("a IS NOT NULL AND b IS NOT NULL")
    c = gates.confusion(rows, [], F.col("held")).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return _rounded_shares(c).withColumn("cost", 1.0 * F.col("fp") + 2.0 * F.col("fn")).drop("fp_rate", "fn_rate")


@query(f"""WITH {_JOINT}, p AS (SELECT y, least(1.0, greatest(0.0, 1 - a)) AS p FROM r WHERE a IS NOT NULL), b AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS share FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT sum(n * abs(conf - share)) FROM b) / (SELECT count(*) FROM p), 6) AS ece, round((SELECT avg((p - y) * (p - y)) FROM p), 6) AS brier""")
def calibration_block(spark: SparkSession, d: str) -> DataFrame:
    """A predictor read as the probability of failing: one less its value, between 0 and 1."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("a")))
    rows = _joint_rows(spark, d).where("a IS NOT NULL").select("y", p.alias("p")).withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10).cast("int")))
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("share"), F.sum((F.col("p") - F.col("y")) ** 2).alias("loss"))
    return sums.agg(F.sum("n").alias("n"), rounded(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("share"))) / F.sum("n")).alias("ece"), rounded(F.sum("loss") / F.sum("n")).alias("brier"))


_BINS = """d AS (SELECT doc_id, least(9, n_chars // 400) AS bin, n_chars / 4000.0 AS score FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM d), pop AS (SELECT bin, count(*) AS population FROM d GROUP BY bin),
l AS (SELECT s.*, quality AS y FROM s JOIN labels USING (doc_id) WHERE turn <= 20), w AS (SELECT bin, population / count(*) AS weight FROM l JOIN pop USING (bin) GROUP BY bin, population)"""


def _weighted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Up to twenty documents of each bin of length, taken by a seeded hash, with labels; and the bins' weights."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(9), F.floor(F.col("n_chars") / 400)).alias("bin"), (F.col("n_chars") / 4000.0).alias("score"))
    sample = calibration.stratified_sample(docs, "bin", "doc_id", 7, 20)
    labelled = sample.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return labelled, calibration.population_weights(docs, labelled, "bin")


@query(f"WITH {_BINS} SELECT bin, doc_id, turn FROM s WHERE turn <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(9), F.floor(F.col("n_chars") / 400)).alias("bin"))
    return calibration.stratified_sample(docs, "bin", "doc_id", 7, 20).select("bin", "doc_id", "turn")


@query(f"WITH {_BINS} SELECT bin, round(weight, 6) AS weight FROM w")
def union_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d)[1].select("bin", rounded("weight").alias("weight"))


_CURVE = """t AS (SELECT (10 + 2 * i) / 100.0 AS threshold FROM range(46) r(i)), c AS (SELECT threshold, coalesce(sum(weight) FILTER (score >= threshold AND y = 1), 0) AS tp, coalesce(sum(weight) FILTER (score >= threshold AND y = 0), 0) AS fp,
coalesce(sum(weight) FILTER (score < threshold AND y = 1), 0) AS fn FROM l JOIN w USING (bin), t GROUP BY threshold), m AS (SELECT threshold, tp, fp, fn, tp + fp AS candidates, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    rows, weights = _weighted(spark, d)
    thresholds = spark.range(46).select(((10 + 2 * F.col("id")) / 100.0).alias("threshold"))
    met = rows.join(weights, "bin").join(F.broadcast(thresholds))  # 46 rows
    c = gates.confusion(met, ["threshold"], F.col("score") >= F.col("threshold"), F.col("weight"))
    return c.withColumn("candidates", F.col("tp") + F.col("fp"))


@query(f"WITH {_BINS}, {_CURVE} SELECT round(threshold, 2) AS threshold, round(tp, 3) AS tp, round(fp, 3) AS fp, round(fn, 3) AS fn, round(recall, 4) AS recall FROM m")
def weighted_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds over a stratified sample, each row counting for its share of the population."""
    return _curve(spark, d).select(rounded("threshold", 2).alias("threshold"), *[rounded(c, 3).alias(c) for c in ("tp", "fp", "fn")], rounded("recall", 4).alias("recall"))


@query(f"WITH {_BINS}, {_CURVE} SELECT round(threshold, 2) AS threshold, round(candidates, 3) AS candidates FROM m ORDER BY CASE WHEN candidates <= 0.4 * (SELECT count(*) FROM documents) AND recall IS NOT NULL THEN 0 ELSE 1 END, threshold LIMIT 1")
def operating_point(spark: SparkSession, d: str) -> DataFrame:
    """The lowest threshold that lets through no more than two fifths of the documents."""
    curve = _curve(spark, d).join(F.broadcast(table(spark, d, "documents").agg((0.4 * F.count("*")).alias("budget"))))  # one row
    return gates.operating_point(curve, F.col("budget")).select(rounded("threshold", 2).alias("threshold"), rounded("candidates", 3).alias("candidates"))


_RATERS = """e AS (SELECT user_id // 2 AS run, CASE WHEN user_id % 2 = 0 THEN 'human' ELSE 'model' END AS rater, CASE WHEN event_type = 'error' THEN 'degraded' WHEN event_type = 'view' THEN 'unsure' ELSE 'ok' END AS label, ts, event_id FROM events),
last AS (SELECT run, rater, arg_max(label, event_id) AS label FROM e GROUP BY run, rater), pairs AS (SELECT h.label AS human, m.label AS model FROM last h JOIN last m ON h.run = m.run AND h.rater = 'human' AND m.rater = 'model'),
k AS (SELECT count(*) AS n, avg(CASE WHEN human = model THEN 1.0 ELSE 0 END) AS po, avg(CASE WHEN human = 'degraded' THEN 1.0 ELSE 0 END) AS h, avg(CASE WHEN model = 'degraded' THEN 1.0 ELSE 0 END) AS m FROM pairs WHERE human <> 'unsure' AND model <> 'unsure')"""


@query(f"""WITH {_RATERS} SELECT (SELECT count(*) FROM pairs) AS n_overlap, n AS n_scoreable, (SELECT count(*) FROM pairs WHERE human = 'unsure' AND model <> 'unsure') AS unsure_human_only, (SELECT count(*) FROM pairs WHERE human = 'unsure' AND model = 'unsure') AS unsure_both,
round(CASE WHEN n >= 10 THEN po END, 6) AS agreement, round(CASE WHEN n >= 10 AND h * m + (1 - h) * (1 - m) < 1 THEN (po - (h * m + (1 - h) * (1 - m))) / (1 - (h * m + (1 - h) * (1 - m))) END, 6) AS kappa FROM k""")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Users in pairs as a human and a model that label a run with each event; the last label counts."""
    e = table(spark, d, "events")
    label = F.when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "view", "unsure").otherwise("ok")
    labels = e.select(F.floor(F.col("user_id") / 2).alias("run"), F.when(F.col("user_id") % 2 == 0, "human").otherwise("model").alias("rater"), label.alias("label"), "event_id")
    return calibration.rater_agreement(latest_wins(labels, ["run", "rater"], ["event_id"]), 10).select("n_overlap", "n_scoreable", "unsure_human_only", "unsure_both", rounded("agreement").alias("agreement"), rounded("kappa").alias("kappa"))


@query(f"WITH {_RATERS} SELECT human, model, count(*) AS n FROM pairs GROUP BY ALL")
def rater_confusion(spark: SparkSession, d: str) -> DataFrame:
    """All three labels of both raters against each other."""
    e = table(spark, d, "events")
    label = F.when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "view", "unsure").otherwise("ok")
    last = latest_wins(e.select(F.floor(F.col("user_id") / 2).alias("run"), (F.col("user_id") % 2).alias("rater"), label.alias("label"), "event_id"), ["run", "rater"], ["event_id"])
    human, model = (last.where(f"rater = {i}").select("run", F.col("label").alias(n)) for i, n in enumerate(("human", "model")))
    return human.join(model, "run").groupBy("human", "model").agg(F.count("*").alias("n"))


@query(f"""WITH {_RUN}, n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id), f AS (SELECT query_id, count(*) FILTER (rank <= 10) AS top, count(*) AS f FROM run JOIN qrels USING (query_id, doc_id) GROUP BY query_id),
z AS (SELECT query_id, count(*) AS size FROM run GROUP BY query_id), a AS (SELECT n.query_id, coalesce(top, 0) / n AS r, least(10, n) / n AS c, least(10, coalesce(f, 0)) / n AS o, coalesce(size, 0) AS size FROM n LEFT JOIN f USING (query_id) LEFT JOIN z USING (query_id))
SELECT count(*) AS n, round(avg(r), 4) AS recall_10, round(avg(c), 4) AS ceiling_10, round(avg(o), 4) AS oracle_10, round(avg(size), 2) AS mean_pool, CAST(median(size) AS DOUBLE) AS median_pool, round(avg(r) / avg(c), 6) AS attained FROM a""")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Recall, ceiling, what a perfect reranker would reach, the pools' sizes, and the share of what is attainable."""
    run, qrels = _run_and_qrels(spark, d)
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    f = run.join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= 10).alias("top"), F.count("*").alias("found"))
    size = run.groupBy("query_id").agg(F.count("*").alias("size"))
    a = n.join(f, "query_id", "left").join(size, "query_id", "left").select(
        (F.coalesce("top", F.lit(0)) / F.col("n")).alias("r"), (F.least(F.lit(10), "n") / F.col("n")).alias("c"), (F.least(F.lit(10), F.coalesce("found", F.lit(0))) / F.col("n")).alias("o"), F.coalesce("size", F.lit(0)).alias("size"))
    return a.agg(
        F.count("*").alias("n"), rounded(F.avg("r"), 4).alias("recall_10"), rounded(F.avg("c"), 4).alias("ceiling_10"), rounded(F.avg("o"), 4).alias("oracle_10"), rounded(F.avg("size"), 2).alias("mean_pool"),
        F.median("size").alias("median_pool"), rounded(F.try_divide(F.avg("r"), F.avg("c"))).alias("attained"))


@query(f"""WITH {_RUN}, ever AS (SELECT DISTINCT doc_id FROM run), j AS (SELECT q.query_id, q.doc_id, r.rank, q.doc_id % 13 = 5 AS unknown, e.doc_id IS NULL AS dark FROM qrels q LEFT JOIN run r USING (query_id, doc_id) LEFT JOIN ever e ON e.doc_id = q.doc_id)
SELECT query_id % 200 AS topic, CASE WHEN rank <= 10 THEN 'hit' WHEN rank IS NOT NULL THEN 'ranking_failure' WHEN unknown THEN 'never_ingested' WHEN dark THEN 'never_retrieved' ELSE 'retrieved_elsewhere' END AS cause, count(*) AS n FROM j GROUP BY ALL""")
def failure_characterise(spark: SparkSession, d: str) -> DataFrame:
    """Why judged documents are not in the top ten, by topic; every thirteenth document counts as never ingested."""
    run, qrels = _run_and_qrels(spark, d)
    ever = run.select("doc_id").distinct().withColumn("seen", F.lit(True))
    j = qrels.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").join(ever, "doc_id", "left")
    cause = (
        F.when(F.col("rank") <= 10, "hit").when(F.col("rank").isNotNull(), "ranking_failure").when(F.col("doc_id") % 13 == 5, "never_ingested")
        .when(F.col("seen").isNull(), "never_retrieved").otherwise("retrieved_elsewhere"))
    return j.groupBy((F.col("query_id") % 200).alias("topic"), cause.alias("cause")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s, list_cosine_similarity(q.embedding[1:16]::DOUBLE[], c.embedding[1:16]::DOUBLE[]) AS a FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS exact, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, chunk_id) AS near FROM p),
h AS (SELECT query_id, count(*) FILTER (near <= 10) / count(*) AS recall FROM r WHERE exact <= 10 GROUP BY query_id) SELECT count(*) AS queries, round(avg(recall), 6) AS recall FROM h""")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by the vectors' first 16 places against the exact ten."""
    q, c = _vectors(spark, d)
    short = lambda df: df.withColumn("vector", F.slice("vector", 1, 16))
    exact = retrieval.knn(q, c, 10).select("query_id", "chunk_id")
    near = retrieval.knn(short(q), short(c), 10).select("query_id", "chunk_id", F.lit(1).alias("met"))
    per_query = exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("met") / F.count("*")).alias("recall"))
    return per_query.agg(F.count("*").alias("queries"), rounded(F.avg("recall")).alias("recall"))


@query(f"""WITH {_PAIRS}, pooled AS (SELECT query_id, query_label, doc_id, max(s) AS score FROM pairs WHERE query_id <> chunk_id GROUP BY ALL), k AS (SELECT CASE WHEN query_label = doc_id THEN score END AS a, CASE WHEN query_label <> doc_id THEN score END AS b FROM pooled),
g AS (SELECT avg(a) - avg(b) AS gap, sqrt((stddev_pop(a) ** 2 + stddev_pop(b) ** 2) / 2) AS pooled_sd FROM k) SELECT round(gap, 4) AS gap, round(pooled_sd, 4) AS pooled_sd, round(gap / pooled_sd, 3) AS gap_in_sd FROM g""")
def gap_effect_size(spark: SparkSession, d: str) -> DataFrame:
    """The gap between relevant and other documents in pooled deviations: what tells a weak encoder."""
    s = retrieval.document_separation(*_vectors(spark, d))
    gap, pooled, effect = retrieval.separation_gap((F.col("mean_same"), F.col("sd_same")), (F.col("mean_other"), F.col("sd_other")))
    return s.select(rounded(gap, 4).alias("gap"), rounded(pooled, 4).alias("pooled_sd"), rounded(effect, 3).alias("gap_in_sd"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs), f AS (SELECT r.query_id, r.chunk_id, d.doc_id AS known, d.lang FROM r LEFT JOIN documents d ON d.doc_id = r.chunk_id AND d.doc_id % 3 > 0 WHERE rank <= 10)
SELECT query_id, count(*) AS rows, count(known) AS mapped, count(*) - count(known) AS unmapped, round(coalesce(avg(CASE WHEN known IS NOT NULL THEN CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END END), 1.0), 6) AS covered,
concat_ws(',', CASE WHEN count(known) = 0 THEN 'no_joined_rows' END, CASE WHEN count(*) - count(known) > 4 THEN 'degraded' END) AS invalid FROM f GROUP BY query_id""")
def id_remap_join(spark: SparkSession, d: str) -> DataFrame:
    """Found chunks mapped to documents (every third is not known): what is lost is counted, and a run that lost too much is invalid."""
    q, c = _vectors(spark, d)
    known = table(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("known"), "lang")
    f = retrieval.knn(q, c, 10).join(known, "chunk_id", "left").groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count("known").alias("mapped"), rounded(F.coalesce(F.avg(F.when(F.col("known") == 1, (F.col("lang") == "en").cast("int"))), F.lit(1.0))).alias("covered"))
    lost = F.col("rows") - F.col("mapped")
    return f.withColumn("unmapped", lost).withColumn("invalid", F.concat_ws(",", F.when(F.col("mapped") == 0, "no_joined_rows"), F.when(lost > 4, "degraded")))
