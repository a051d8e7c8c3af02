"""Gates over measured records: tolerances, best values, points on curves, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import values_at

#: A metric's tolerance: the bad direction (up, down), the allowance, whether it is a share of the baseline.
Tolerance = tuple[str, float, bool]


def violates(baseline: Column, new: Column, tolerance: Tolerance) -> Column:
    """Whether a metric moved the wrong way by more than its allowance."""
    direction, allowed, relative = tolerance
    delta = new - baseline if direction == "up" else baseline - new
    return delta > (F.lit(allowed) * F.abs(baseline) if relative else F.lit(allowed))


def metric_regression(records: DataFrame, tolerances: dict[str, Tolerance]) -> DataFrame:
    """(sink, identity, metric, baseline, value, verdict): the newest record of each sink against the latest earlier one of the same identity.

    records: (sink, at, identity, metric, value).  Metrics without a tolerance are not gated.  verdict: violation, ok, new
    (no earlier record of the identity) or no_baseline (the earlier record lacks the metric); the last two are not checked,
    which is not a pass.
    """
    newest = records.join(records.groupBy("sink").agg(F.max("at").alias("at")), ["sink", "at"]).where(F.col("metric").isin(*tolerances))
    known = newest.select("sink", "identity", F.col("at").alias("now")).distinct()
    earlier = records.join(known, ["sink", "identity"]).where("at < now").groupBy("sink", "identity").agg(F.max("at").alias("before"))
    old = records.select("sink", "identity", "metric", F.col("at").alias("before"), F.col("value").alias("baseline"))
    joined = newest.join(earlier, ["sink", "identity"], "left").join(old, ["sink", "identity", "metric", "before"], "left")
    bad = F.lit(False)
    for metric, tolerance in tolerances.items():
        bad = F.when(F.col("metric") == metric, violates(F.col("baseline"), F.col("value"), tolerance)).otherwise(bad)
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("baseline").isNull(), "no_baseline").when(bad, "violation").otherwise("ok")
    return joined.select("sink", "identity", "metric", "baseline", "value", verdict.alias("verdict"))


def best_by_cell(history: DataFrame) -> DataFrame:
    """(cell, best, best_run): the best overall of each cell and the first run that reached it; history: (cell, run, at, overall)."""
    top = history.where(F.col("overall").isNotNull() & ~F.isnan("overall"))
    high = top.groupBy("cell").agg(F.max("overall").alias("best"))
    return top.join(high, "cell").where("overall = best").groupBy("cell", "best").agg(F.min_by("run", "at").alias("best_run"))


def best_regression(current: DataFrame, history: DataFrame, most: float) -> DataFrame:
    """(cell, best, best_run, now, fell, failed): current rows (cell, overall) of cells with a history; a fall of more than ``most`` fails."""
    joined = current.where("overall IS NOT NULL").join(best_by_cell(history), "cell")
    fell = F.col("best") - F.col("overall")
    return joined.select("cell", "best", "best_run", F.col("overall").alias("now"), fell.alias("fell"), (fell > most).alias("failed"))


def confusion(rows: DataFrame, keys: list[str], predicted: Column, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn of each key (``y`` is 1 or 0), counted or weighted, with precision, recall, f1, fp_rate and fn_rate.

    What has no denominator is NULL; f1 is 0 where precision and recall both are.
    """
    w = F.lit(1) if weight is None else weight
    cell = lambda p, y: F.coalesce(F.sum(F.when((predicted == p) & (F.col("y") == y), w)), F.lit(0))
    c = rows.groupBy(*keys).agg(cell(True, 1).alias("tp"), cell(True, 0).alias("fp"), cell(False, 1).alias("fn"), cell(False, 0).alias("tn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = share(tp, fp), share(tp, fn)
    return c.withColumns({"precision": p, "recall": r, "f1": F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), "fp_rate": share(fp, tn), "fn_rate": share(fn, tp)})


def grid(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(t): the distinct values, or where there are more than ``most`` that many quantiles of them, interpolated."""
    values = rows.select(column).distinct()
    if values.limit(most + 1).count() <= most:
        return values.select(F.col(column).cast("double").alias("t"))
    at = values_at(values, column, {f"q{i}": lambda n, i=i: (n - 1) * F.lit(i / (most - 1)) for i in range(most)})
    return at.select(F.explode(F.array(*[F.col(c).cast("double") for c in at.columns])).alias("t")).distinct()


def joint_sweep(rows: DataFrame, a: str, b: str, fp_cost: float, fn_cost: float, most: int = 40) -> DataFrame:
    """(ta, tb, tp, fp, fn, tn, precision, recall, f1, cost, ...) of every pair of thresholds; a row fails if a < ta or b < tb.

    rows: (y, a, b); rows that lack a predictor are left out.  Rows are counted per cell of the grid first, so the sums
    over thresholds run over at most (most + 1)^2 cells, not over rows.
    """
    usable = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ta, tb = grid(usable, a, most), grid(usable, b, most)
    listed = ta.agg(F.array_sort(F.collect_list("t")).alias("as")).join(tb.agg(F.array_sort(F.collect_list("t")).alias("bs")))  # one row, ``most`` values
    # how many thresholds a value reaches: it fails all later ones
    cells = usable.join(F.broadcast(listed)).select("y", F.size(F.filter("as", lambda t: t <= F.col(a))).alias("i"), F.size(F.filter("bs", lambda t: t <= F.col(b))).alias("j")).groupBy("y", "i", "j").agg(F.count("*").alias("n"))
    points = listed.select(F.posexplode("as").alias("ia", "ta"), "bs").select("ia", "ta", F.posexplode("bs").alias("jb", "tb"))
    met = points.join(F.broadcast(cells))  # both bounded by the grid
    fails = (F.col("i") <= F.col("ia")) | (F.col("j") <= F.col("jb"))
    return confusion(met, ["ta", "tb"], fails, F.col("n")).withColumn("cost", fp_cost * F.col("fp") + fn_cost * F.col("fn"))


def operating_point(curve: DataFrame, budget: Column | float) -> DataFrame:
    """The row of a sweep (threshold, candidates, recall, ...) with the lowest threshold inside the budget; if none is, the first row."""
    fits = (F.col("candidates") <= budget) & F.col("recall").isNotNull()
    return curve.orderBy(F.when(fits, 0).otherwise(1), "threshold").limit(1)
