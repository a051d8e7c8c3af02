"""Binary classifiers: confusion, curves, calibration, agreement.  Rows are (y int, score double)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 at each threshold (score >= threshold is positive); one pass over the rows."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    # rows are first counted by how many thresholds they reach, so the explode works on a handful
    reached = sum((F.col("score") >= x).cast("int") for x in thresholds)
    counts = rows.groupBy(reached.alias("reached"), "y").agg(F.count("*").alias("n"))
    ranked = {x: i for i, x in enumerate(sorted(thresholds))}
    place = F.element_at(F.create_map(*[F.lit(v) for kv in ranked.items() for v in kv]), F.col("threshold"))
    hit = F.col("reached") > place
    table = counts.select("reached", "y", "n", t).groupBy("threshold").agg(*[
        F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
        for name, cond in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)), ("tn", ~hit & (F.col("y") == 0)))
    ])
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return table.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def pr_curve(rows: DataFrame, slices: int = 1024) -> DataFrame:
    """score, tp, fp, precision, recall at each distinct score, highest first.

    Running counts in two steps, so that no task sees all scores: within slices of the score's range, and over the
    slices' totals (``slices`` to a unit of score; for scores in [0, 1] that table has ``slices`` + 1 rows).
    """
    by = rows.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("slice", F.floor(F.col("score") * slices))
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = by.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    before = totals.select("slice", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("n_above"), F.sum("p").over(Window.partitionBy()).alias("all_pos"))
    down = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    table = by.join(before, "slice").withColumn("tp", F.col("pos_above") + F.sum("pos").over(down)).withColumn("seen", F.col("n_above") + F.sum("n").over(down))
    return table.select("score", "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("seen")).alias("precision"), F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """auc_pr, one row: precision at each distinct score, weighted by the share of positives that have it; NULL without positives."""
    pos = rows.groupBy("score").agg(F.sum("y").alias("pos"))
    return pr_curve(rows).join(pos, "score").agg((F.sum(F.col("precision") * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0))).alias("auc_pr"))


#: P(X <= i) of a Poisson variable of mean 1.
_POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def bootstrap_interval(rows: DataFrame, key: str, value: str, resamples: int = 200, alpha: float = 0.05) -> DataFrame:
    """point, low, high and resamples of the mean of ``value``, one row; NULL bounds where there are no values.

    Each row counts Poisson(1) times in each resample, drawn from a digest of its key, so that resamples need no
    sampling pass, give the same result under any partitioning, and sum map-side.  Bounds are linear percentiles.
    Empty resamples are left out.  Rows with a null value or key do not count.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    each = known.select("key", "value", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "key", F.col("resample").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum((draw >= p).cast("int") for p in _POISSON)
    means = each.withColumn("w", times).groupBy("resample").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean")).where("mean is not null")
    bounds = means.agg(F.percentile("mean", alpha / 2).alias("low"), F.percentile("mean", 1 - alpha / 2).alias("high"), F.count("*").alias("resamples"))
    return known.agg(F.avg("value").alias("point")).join(F.broadcast(bounds))  # one row each


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate): bins [lo, hi), the last closed; from the edges i / bins."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    bin_ = F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= F.col("score"))) - 1)
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """n, ece, mce and brier, one row."""
    r = reliability(rows, bins).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"), F.max(F.abs(F.col("mean_score") - F.col("rate"))).alias("mce"))
    b = rows.agg(F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"))
    return r.join(F.broadcast(b))  # one row each


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa of two raters with labels 0 and 1."""
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.withColumn("expected", expected).select("n", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: int, most: int) -> DataFrame:
    """Up to ``most`` rows of each stratum, in the order of a seeded hash of the key, with their ``turn``."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)


def population_weights(population: DataFrame, labelled: DataFrame, stratum: str) -> DataFrame:
    """(stratum, weight): how many of the population each labelled row of a stratum stands for."""
    every = population.groupBy(stratum).agg(F.count("*").alias("population"))
    taken = labelled.groupBy(stratum).agg(F.count("*").alias("labelled"))
    return every.join(taken, stratum).select(stratum, (F.col("population") / F.col("labelled")).alias("weight"))


def rater_agreement(labels: DataFrame, least: int, unsure: str = "unsure", positive: str = "degraded") -> DataFrame:
    """Agreement of a human and a model on runs that both labelled (run, rater, label; one label each).

    Runs that either is unsure of do not enter agreement and kappa; with fewer than ``least`` others both are NULL.
    """
    sides = [labels.where(F.col("rater") == r).select("run", F.col("label").alias(r)) for r in ("human", "model")]
    pairs = sides[0].join(sides[1], "run")
    sure = (F.col("human") != unsure) & (F.col("model") != unsure)
    share = lambda c: F.avg(F.when(sure, c.cast("double")))
    s = pairs.agg(
        F.count("*").alias("n_overlap"), F.count_if(sure).alias("n_scoreable"), F.count_if((F.col("human") == unsure) & (F.col("model") != unsure)).alias("unsure_human_only"),
        F.count_if((F.col("human") == unsure) & (F.col("model") == unsure)).alias("unsure_both"), share(F.col("human") == F.col("model")).alias("po"),
        share(F.col("human") == positive).alias("h"), share(F.col("model") == positive).alias("m"))
    chance = F.col("h") * F.col("m") + (1 - F.col("h")) * (1 - F.col("m"))
    enough = F.col("n_scoreable") >= least
    return s.withColumn("agreement", F.when(enough, F.col("po"))).withColumn("kappa", F.when(enough & (chance < 1), (F.col("po") - chance) / (1 - chance)))
