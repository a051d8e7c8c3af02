"""Manuscripts: entries of a bibliography from its lines, guessed titles, what each reviewer is shown, references that nothing cites."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_k_per

# How entries begin, what a year looks like, and the least entry.
YEAR = r"(?:19|20)\d{2}"
NUMBERED = r"^\[\d{1,3}\]\s*"
ENTRY_START = (
    r"^(?:\[\d{1,3}\]\s*)?((?:[A-Z]\.\s*){1,4}(?:-[A-Z]\.\s*)?[A-Z][\w'’\-]+|[A-Z][\w'’\-]+,\s*(?:[A-Z]\.|[A-Z][a-z]+)"
    r"|[A-Z][\w'’\-]+\s+[A-Z][\w'’\-]+,|[A-Z][\w'’\-]+\s+[A-Z]\.\s*[A-Z][\w'’\-]+)"
)
LEAST_NUMBERED, LEAST_ENTRY = 5, 25
# Quoted titles, and tokens of author lists.
QUOTED = re.compile(r"[“”\"](.{15,300}?)[.,]?[“”\"]")
AUTHOR = re.compile(r"^(?:[A-Z]\.?(?:-[A-Z]\.?)*[,.]?|[A-ZÀ-Ý][\wÀ-ÿ'’\-]*[,.]?|and|&|de|del|della|da|di|do|van|von|der|den|ten|ter|la|le|el|bin|ibn|dos|Jr\.?|Sr\.?|et|al\.?)[,.]?$")
TITLE_END = re.compile(r"\.\s+(?=[A-Z(]|arXiv|In\b)")
# Characters that a reviewer is shown, the least of a span, and the part kept for spans that nobody claims.
SHOWN_CHARS, LEAST_SPAN, UNCLAIMED_PART = 24_000, 400, 6

_SPACE = r"[ \t\n\x0B\f\r]+"


def bibliography_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, entry, text): the entries of a bibliography's lines (doc_id, line, text), numbered from 0 as they stand.

    Where five lines or more begin with a number in brackets, entries begin there; elsewhere at a line that begins like an author,
    if the entry before it has a year by then: that is, if there is one since the last line that begins so.  Blank and null lines go;
    numbers and hyphens at line ends go; entries of 25 characters or fewer, or without a year, go too.
    """
    text = F.regexp_replace(F.col("text"), f"^{_SPACE}|{_SPACE}$", "")
    known = lines.select("doc_id", "line", text.alias("text")).where("text <> ''")
    numbered = F.col("text").rlike(NUMBERED)
    enough = F.sum(numbered.cast("int")).over(Window.partitionBy("doc_id")) >= LEAST_NUMBERED
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = known.withColumn("by_number", enough).withColumn("opens", F.when(F.col("by_number"), numbered).otherwise(F.col("text").rlike(ENTRY_START)))
    parts = marked.withColumn("part", F.sum(F.col("opens").cast("int")).over(order)).groupBy("doc_id", "part").agg(
        F.first("by_number").alias("by_number"), F.max(F.col("text").rlike(YEAR)).alias("has_year"), F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines")
    )
    before = F.lag("has_year").over(Window.partitionBy("doc_id").orderBy("part"))
    starts = parts.withColumn("starts", F.when(F.col("by_number"), True).otherwise(F.coalesce(before, F.lit(True))))
    entry = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    joined = starts.withColumn("of", entry).groupBy("doc_id", "of").agg(F.min("line").alias("line"), F.array_join(F.transform(F.flatten(F.array_sort(F.collect_list("lines"))), lambda x: x["text"]), " ").alias("raw"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", _SPACE, " "), NUMBERED, ""), rf"(?<=[a-z])-{_SPACE}(?=[a-z])", "")
    kept = joined.select("doc_id", "line", clean.alias("text")).where((F.length("text") > LEAST_ENTRY) & F.col("text").rlike(YEAR))
    return kept.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).select("doc_id", "entry", "text")


def guessed_title(entry: str | None) -> str | None:
    """What is quoted; else what follows the last full stop before which only authors stand, up to its end; else the beginning."""
    if entry is None:
        return None
    if m := QUOTED.search(entry):
        return m[1].strip()
    cut = None
    for m in re.finditer(r"\.\s+", entry[:1200]):
        tokens = entry[: m.start()].split()
        if len(tokens) >= 2 and all(map(AUTHOR.match, tokens)):
            cut = m.end()
    if cut is None:
        return entry[:150].strip(" .,")
    end = TITLE_END.search(entry, cut)
    return entry[cut : end.start() if end else len(entry)].strip(" .,")[:300]


def title_guess(entry: Column) -> Column:
    @F.pandas_udf("string")
    def guess(entries: pd.Series) -> pd.Series:
        return entries.map(lambda x: guessed_title(x if isinstance(x, str) else None)).astype(object)

    return guess(entry)


def allowances(spans: DataFrame, reviewers: list[str], budget: int = SHOWN_CHARS, least: int = LEAST_SPAN, part: int = UNCLAIMED_PART) -> DataFrame:
    """(doc_id, reviewer, span, allowance): how many characters of each span (doc_id, span, lane, length) a reviewer is shown.

    A span is its lane's, one without lane is everyone's.  A reviewer's own spans come first: if they take all of the budget, a part is
    kept for the others (no more than these need), else the others get the rest.  Within each of the two every span gets a floor (its length,
    if shorter), and of what is left a part by what its length exceeds that, cut to whole numbers.  Null lengths count as 0.
    """
    names = F.array(*[F.lit(r) for r in reviewers])
    length = F.coalesce(F.col("length").cast("long"), F.lit(0))
    mine = spans.select("doc_id", "span", "lane", length.alias("length")).withColumn("reviewer", F.explode(F.when(F.col("lane").isNull(), names).otherwise(F.filter(names, lambda r: r == F.col("lane")))))
    every, group = Window.partitionBy("doc_id", "reviewer"), Window.partitionBy("doc_id", "reviewer", "claimed")
    rows = mine.withColumn("claimed", F.col("lane").isNotNull())
    claimed = F.sum(F.when(F.col("claimed"), F.col("length")).otherwise(0)).over(every)
    loose = F.sum(F.when(F.col("claimed"), 0).otherwise(F.col("length"))).over(every)
    reserve = F.when(claimed >= budget, F.least(loose, F.lit(budget // part))).otherwise(F.lit(budget) - claimed)
    given = F.when(F.col("claimed"), F.when(claimed >= budget, F.lit(budget) - reserve).otherwise(claimed)).otherwise(reserve)
    rows = rows.withColumn("given", given).withColumn("total", F.sum("length").over(group)).withColumn("n", F.count("*").over(group))
    floor = F.least(F.lit(least), F.floor(F.col("given") / F.col("n")))
    rows = rows.withColumn("base", F.least(F.col("length"), floor))
    left = F.col("given") - F.sum("base").over(group)
    over = F.col("total") - F.sum("base").over(group)
    more = F.when((left > 0) & (over > 0), F.floor(left * (F.col("length") - F.col("base")) / over)).otherwise(0)
    return rows.select("doc_id", "reviewer", "span", F.when(F.col("total") <= F.col("given"), F.col("length")).otherwise(F.col("base") + more).cast("long").alias("allowance"))


def scoping_coverage(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """(doc_id, spans, chars, covered, dropped_spans, ratio): what all reviewers together see: of a span, the longest beginning that one of them is shown."""
    best = allowed.groupBy("doc_id", "span").agg(F.max("allowance").alias("seen"))
    length = F.coalesce(F.col("length").cast("long"), F.lit(0))
    of = spans.select("doc_id", "span", length.alias("length")).join(best, ["doc_id", "span"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    sums = of.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("length").alias("chars"), F.sum("seen").alias("covered"), F.count(F.when(F.col("seen") < F.col("length"), 1)).alias("dropped_spans"))
    return sums.withColumn("ratio", F.when(F.col("chars") > 0, F.col("covered") / F.col("chars")).otherwise(1.0))


def unused_references(refs: DataFrame, drafts: DataFrame) -> DataFrame:
    """The references (draft_id, ref_id, author, year, title) that their draft (draft_id, text) does not cite.

    Cited: the author's last name (of three letters or more) with the year within 40 characters behind it, or the first four words of the title
    that have six letters or more, all of them.  Without a draft nothing is cited; nulls match nothing.
    """
    last = F.lower(F.element_at(F.split(F.trim("author"), _SPACE), -1))
    text = F.lower(F.coalesce("text", F.lit("")))
    named = F.expr(r"body rlike concat('(?s)\\b\\Q', last, '\\E\\b.{0,40}\\b\\Q', cast(year as string), '\\E\\b')") & (F.length("last") > 2)
    words = F.slice(F.filter(F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 5), 1, 4)
    titled = (F.size("words") > 0) & F.forall("words", lambda w: F.contains(F.col("body"), F.lower(w)))
    both = refs.join(drafts.select("draft_id", text.alias("body")), "draft_id", "left").withColumn("last", last).withColumn("words", words).withColumn("body", F.coalesce("body", F.lit("")))
    return both.where(~(F.coalesce(named, F.lit(False)) | F.coalesce(titled, F.lit(False)))).select(*refs.columns)


def references_for_claims(claims: DataFrame, refs: DataFrame, least: float = 0.25, most: int = 3) -> DataFrame:
    """(draft_id, claim_id, ref_id, overlap, rank): for each claim (draft_id, claim_id, text) the references (draft_id, ref_id, text) of its draft with most of its words.

    Words have five letters or more; overlap: shared words over those of the smaller side.  They meet in a join on draft and word, so
    only pairs that share one are counted; ties by ref_id.
    """
    words = lambda df, key: df.select("draft_id", key, F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 4)).alias("w")).where("size(w) > 0")
    side = lambda df, key, n: words(df, key).select("draft_id", key, F.size("w").alias(n), F.explode("w").alias("word"))
    met = side(claims, "claim_id", "n_claim").join(side(refs, "ref_id", "n_ref"), ["draft_id", "word"]).groupBy("draft_id", "claim_id", "ref_id", "n_claim", "n_ref").agg(F.count("*").alias("common"))
    scored = met.select("draft_id", "claim_id", "ref_id", (F.col("common") / F.least("n_claim", "n_ref")).alias("overlap")).where(F.col("overlap") >= least)
    return top_k_per(scored, ["draft_id", "claim_id"], [F.desc("overlap"), F.asc("ref_id")], most)
