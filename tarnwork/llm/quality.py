"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose feature lies above a cutoff.  Cutoffs are not set by hand: labelled documents
(quality 1: good) are parted by the hash of their id into a holdout, which certifies, and the rest, which chooses.  A
cutoff is certified if the exact binomial tail P(X <= rejected good of the holdout | false rejection rate = alpha /
rules) is at most the level.  Within a rule the cutoffs are tested from the laxest on and testing ends at the first
that fails (fixed sequence), so only rules and strata count as multiple tests: level = delta / (rules * strata).  With
probability 1 - delta at least, all rules together then reject at most the share alpha of the good documents of every
stratum that the base rules keep (what the base rules reject is no rule's error and not in the bound).  Of the
certified cutoffs the one is taken that rejects most bad documents among the choosing labels, each good one counting
against ``good_weight`` bad ones; a rule that gains nothing this way, or a stratum with too few labels, has no cutoff
and rejects nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ALPHA = 0.05
DELTA = 0.05
#: Of so many parts of the labels (by the hash of the id) one chooses and the others are the holdout.
PARTS = 3
GOOD_WEIGHT = 3.0
MIN_WORDS = 50
#: Rule: (step between cutoffs, number of steps).  The cutoffs are fixed beforehand, never taken from the labels.
GRIDS = {
    "symbols_per_word": (0.05, 40),
    "dup_line_share": (0.02, 50),
    "repeat_share": (0.02, 50),
    "capital_share": (0.02, 50),
    "mean_word_chars": (0.5, 60),
    "mark_share": (0.02, 50),
}
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def measure(text: bytes) -> tuple[int, ...]:
    """The counts of ``_COLUMNS`` for one text (UTF-8)."""
    words = text.split()  # for bytes: 0x20 and 0x09-0x0D only
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0
    solid = b"".join(words)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    dups = len(lines) - len(set(lines))
    capitals = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(solid) - len(solid.translate(None, b"!?#*$%&|<>+=_{}[]"))
    threes = list(zip(words, words[1:], words[2:]))
    found, covered = Counter(threes), 0
    if len(found) < len(threes):
        end = 0
        for i, x in enumerate(threes):
            if found[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dups, covered, len(lines), capitals, marks


def features(docs: DataFrame, stratum: str = "lang", carry: str | None = None) -> DataFrame:
    """(doc_id, stratum, carried, the counts, the rules' features), one row for each row of ``docs``.

    Null texts have no words; features of texts without words are 0.  ``carry``: a column of longs that comes along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            rows = [measure(t or b"") for t in texts]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COLUMNS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], ["doc_id", "stratum", "carried", *_COLUMNS])

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("text"),
        (F.col(f"`{carry}`") if carry else F.lit(None)).cast("long").alias("carried"),
    )
    counts = picked.mapInArrow(run, "doc_id long, stratum string, carried long, " + ", ".join(f"{c} long" for c in _COLUMNS))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counts.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "mean_word_chars": share("word_chars", "n_words"),
        "mark_share": share("n_marks", "word_chars"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if n <= 0 or k >= n:
        return 1.0
    if k < 0:
        return 0.0
    return _beta(float(n - k), k + 1.0, 1.0 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - _beta(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 100_000):
        for even in (True, False):
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) * total / a) if x > 0 else 0.0


def certified_cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p_value): the chosen cutoff of each rule and stratum.

    n_good, good_rejected and p_value are of the holdout, bad_rejected of the labels that choose.
    Labels with a null quality or doc_id are left out; of repeated labels of a document the lowest quality counts.
    """
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(step).alias("step"), F.least(F.lit(n), F.ceil(F.col(r) / step).cast("int")).alias("level"))
        for r, (step, n) in GRIDS.items()
    ])
    chooses = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == 0
    labelled = feats.where(~F.col("base_failed")).join(truth, "doc_id").withColumn("chooses", chooses)
    # a document of level v is rejected by the cutoffs 0, step, ..., (v - 1) * step
    counts = (
        labelled.select("stratum", "quality", "chooses", F.explode(rules).alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.step").alias("step"), F.col("r.level").alias("level"))
        .agg(
            F.count_if((F.col("quality") == 1) & ~F.col("chooses")).alias("good"), F.count_if((F.col("quality") == 1) & F.col("chooses")).alias("lost"),
            F.count_if((F.col("quality") == 0) & F.col("chooses")).alias("bad"),
        )
    )
    every = Window.partitionBy("stratum", "rule")
    from_top = every.orderBy(F.desc("level"))
    table = (
        counts.withColumn("n_good", F.sum("good").over(every))
        .withColumn("good_rejected", F.sum("good").over(from_top))
        .withColumn("lost", F.sum("lost").over(from_top))
        .withColumn("bad_rejected", F.sum("bad").over(from_top))
        .where("level > 0")
        .withColumn("cutoff", (F.col("level") - 1) * F.col("step"))
    )

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        each = alpha / len(GRIDS)
        return pd.Series([binomial_tail(a, b, each) if a <= 3 * b * each else 1.0 for a, b in zip(k, n)], dtype=float)

    strata = labelled.agg((F.count_distinct("stratum") + F.max(F.when(F.col("stratum").isNull(), 1).otherwise(0))).alias("strata"))  # a null stratum is one of its own
    tested = (
        table.withColumn("p_value", tail("good_rejected", "n_good")).crossJoin(F.broadcast(strata))  # one row
        .withColumn("level_of_test", delta / (len(GRIDS) * F.col("strata")))
        .withColumn("worst", F.max("p_value").over(from_top))
        .withColumn("gain", F.col("bad_rejected") - good_weight * F.col("lost"))
        .where((F.col("worst") <= F.col("level_of_test")) & (F.col("gain") > 0))
        .withColumn("rank", F.row_number().over(every.orderBy(F.desc("gain"), F.desc("cutoff"))))
    )
    return tested.where("rank = 1").select("stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected", "p_value")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, carry: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: its counts, features, base_failed, rules_failed array and kept.

    kept is false if the base rules fail, else if a certified rule of its stratum rejects it.  Null texts are
    texts without words (base_failed); a null stratum is a stratum of its own.  Each row is judged by its own text,
    also rows that repeat a doc_id or have none (the latter take part in no label).  ``carry``: a column of longs that
    comes along as ``carried``.
    """
    feats = stored(features(docs, stratum, carry))
    chosen = certified_cutoffs(feats, labels, alpha, delta)
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRIDS])
    wide = wide.withColumnRenamed("stratum", "of_stratum")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in GRIDS]))
    return (
        feats.join(wide, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
        .withColumn("rules_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0))
        .drop("of_stratum", *[f"cut_{r}" for r in GRIDS])
    )


def false_rejections(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, n_good, base_rejected, rule_rejected, rule_share) of the good labelled documents: rule_share is what alpha bounds.

    rule_share is over the good documents that the base rules keep (null if there are none); labels as in certified_cutoffs.
    """
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = judged.join(truth.where("quality = 1").select("doc_id"), "doc_id")
    counted = good.groupBy("stratum").agg(F.count("*").alias("n_good"), F.count_if("base_failed").alias("base_rejected"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("rule_rejected"))
    return counted.withColumn("rule_share", F.try_divide("rule_rejected", F.col("n_good") - F.col("base_rejected")))
