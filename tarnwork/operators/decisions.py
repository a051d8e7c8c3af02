"""Decision lists over records: column builders with the rules and weights of each list marked as fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bonuses of a suggestion's type and impact, weights of a gap's priority and kind.
TYPE_BONUS = {"missing_citation": 0.3, "recent_work": 0.15, "foundational_work": 0.1, "alternative_source": 0.05, "weak_citation": 0.2}
IMPACT_BONUS = {"critical": 0.2, "high": 0.1, "medium": 0.05, "low": 0.0}
PRIORITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}
GAP_WEIGHT = {"missing_seminal": 3, "theoretical_gap": 2, "methodology_gap": 1}
#: Kinds of sections with the words that tell them, in order of precedence.
SECTION_WORDS = {
    "abstract": ["abstract", "summary", "overview", "executive summary"],
    "introduction": ["introduction", "background", "motivation", "overview", "problem statement", "context", "rationale"],
    "literature_review": ["literature", "related work", "prior work", "previous work", "state of the art", "sota", "background", "review", "theoretical framework", "conceptual framework"],
    "methodology": ["method", "approach", "design", "procedure", "implementation", "experimental setup", "materials", "techniques", "framework", "architecture", "algorithm", "model", "protocol"],
    "results": ["result", "finding", "experiment", "evaluation", "performance", "analysis", "outcome", "observation", "measurement", "data"],
    "discussion": ["discussion", "analysis", "interpretation", "implication", "limitation", "comparison", "insight", "reflection"],
    "conclusion": ["conclusion", "concluding remarks", "final remarks", "summary", "future work", "future directions", "closing", "wrap-up", "takeaways", "recommendations"],
    "references": ["reference", "bibliography", "works cited", "citation", "literature cited", "sources"],
}
#: Hints that name a section directly.
SECTION_HINTS = {
    "abstract": "abstract", "introduction": "introduction", "related work": "literature_review", "literature": "literature_review", "methods": "methodology", "methodology": "methodology",
    "results": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "references": "references", "bibliography": "references",
}
#: Weights and bounds of the readiness score by policy (critical, major, minor, citation without source, many major, many critical).
READINESS_POLICIES = {"scientific_empirical": (8.0, 3.5, 1.0, 3.0, 8, 3), "general_journal_article": (8.0, 3.0, 1.0, 4.0, 8, 3)}


def _lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def citation_strength(similarity: Column, citations: Column, importance: Column) -> Column:
    """strong, moderate, weak or missing support of a claim; important claims need two citations and more similarity."""
    needed = F.when(importance > 0.7, 2).otherwise(1)
    similar = F.when(importance > 0.7, 0.7).when(importance > 0.4, 0.6).otherwise(0.5)
    return (
        F.when((citations >= needed) & (similarity >= similar), "strong").when((citations >= 1) | (similarity >= 0.6), "moderate")
        .when((citations > 0) | (similarity >= 0.4), "weak").otherwise("missing")
    )


def suggestion_type(citations: Column, year: Column, relevance: Column, this_year: Column) -> Column:
    """What a suggested paper is to a claim with so many citations; a year that is not known makes it no recent and no founding work."""
    age = this_year - year
    return (
        F.when(F.coalesce(citations, F.lit(0)) == 0, "missing_citation").when((citations == 1) & (relevance > 0.8), "alternative_source")
        .when(age <= 5, "recent_work").when((age > 10) & (relevance > 0.7), "foundational_work").otherwise("alternative_source")
    )


def impact_level(confidence: Column, kind: Column) -> Column:
    return (
        F.when(kind == "missing_citation", F.when(confidence > 0.7, "critical").otherwise("high")).when((kind == "recent_work") & (confidence > 0.8), "high")
        .when((kind == "foundational_work") & (confidence > 0.75), "high").when(confidence > 0.8, "high").when(confidence > 0.6, "medium").otherwise("low")
    )


def priority_score(confidence: Column, kind: Column, impact: Column) -> Column:
    """Confidence with the bonuses of type and impact, 1 at most."""
    return F.least(F.lit(1.0), confidence + _lookup(TYPE_BONUS, kind, 0.0) + _lookup(IMPACT_BONUS, impact, 0.0))


def gap_priority(priority: Column, kind: Column, suggestions: Column) -> Column:
    """Weight of the priority times that of the kind, and half a point if there is literature to suggest."""
    return _lookup(PRIORITY_WEIGHT, priority, 1) * _lookup(GAP_WEIGHT, kind, 1) + F.when(suggestions > 0, 0.5).otherwise(0.0)


def recency_bonus(year: Column, this_year: Column) -> Column:
    """A tenth for this year's papers, falling to nothing in five years."""
    age = this_year - year
    return F.when(age.isNotNull() & (age <= 5), 0.1 * (5 - age) / 5).otherwise(0.0)


def readiness(critical: Column, major: Column, minor: Column, unsourced: Column, policy: str) -> tuple[Column, Column, Column]:
    """Score from 0 to 100 by the policy's deductions, the guardrail that capped it (NULL: none), and the verdict."""
    wc, wm, wn, wu, many_major, many_critical = READINESS_POLICIES[policy]
    raw = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - (critical * wc + major * wm + minor * wn + unsourced * wu)).cast("int")))
    guard = F.when((critical >= many_critical) | (major >= many_major), "critical_or_major_volume").when(critical > 0, "critical_issue_present")
    score = F.when(guard == "critical_or_major_volume", F.least(raw, F.lit(69))).when(guard.isNotNull(), F.least(raw, F.lit(84))).otherwise(raw)
    verdict = F.when(score >= 85, "Strong Submission").when(score >= 70, "Minor Revisions").when(score >= 50, "Needs Work").otherwise("Major Revisions")
    return score, guard, verdict


def section_type(title: Column, hint: Column) -> Column:
    """The kind of a section by its hint, else by the words in its title (10 for the title itself, 5 inside it, 3 inside the hint); introduction if nothing tells."""
    low_hint = F.trim(F.lower(F.coalesce(hint, F.lit(""))))
    clean = F.regexp_replace(F.trim(F.lower(F.coalesce(title, F.lit("")))), r"^[\d.\s]+", "")
    # an array of one: title and hint are made once a row, not for each word
    return F.transform(F.array(F.struct(clean.alias("clean"), low_hint.alias("hint"))), lambda x: _told(x["clean"], x["hint"]))[0]


def _told(clean: Column, hint: Column) -> Column:
    scores = []
    for kind, words in SECTION_WORDS.items():
        points = reduce(Column.__add__, [F.when(clean == w, 10).when(F.contains(clean, F.lit(w)), 5).when((hint != "") & F.contains(hint, F.lit(w)), 3).otherwise(0) for w in words])
        scores.append(F.struct(points.alias("points"), F.lit(-len(scores)).alias("first"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*scores))
    return F.coalesce(_direct(hint), F.when(best["points"] >= 3, best["kind"]), F.lit("introduction"))


def _direct(hint: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SECTION_HINTS.items() for x in kv])[hint]


def passes_domain(similarity: Column, query_terms: Column, profile_terms: Column, result_terms: Column) -> Column:
    """Whether a retrieved result belongs to the query's and the manuscript's field, by shared terms and similarity."""
    in_query = F.size(F.array_intersect(result_terms, query_terms))
    in_profile = F.size(F.array_intersect(result_terms, profile_terms))
    score = F.coalesce(similarity, F.lit(0.0))
    foreign = ((score < 0.72) & (in_query == 0)) | ((F.size(profile_terms) > 0) & (score < 0.82) & (in_profile == 0) & (in_query < 2))
    return ((F.size(query_terms) == 0) & (F.size(profile_terms) == 0)) | ~foreign


def actionable_claim(requires_citation: Column, importance: Column) -> Column:
    return requires_citation.eqNullSafe(F.lit(True)) | (F.coalesce(importance, F.lit(0.0)) >= 0.65)


def actionable_feedback(kind: Column) -> Column:
    """All but strengths; an unknown kind is kept."""
    return ~kind.eqNullSafe(F.lit("strength"))


def route(desk_reject: Column, halt: Column, branches: list[str]) -> Column:
    """Array of the next steps: the end of a rejected or halted run, else every branch."""
    return F.when(F.coalesce(desk_reject, F.lit(False)), F.array(F.lit("desk_reject"))).when(F.coalesce(halt, F.lit(False)), F.array(F.lit("halt"))).otherwise(F.array(*[F.lit(b) for b in branches]))


def quota_state(used: Column, limit: Column, reset_at: Column, now: Column, admin: Column) -> Column:
    """allowed, reset (the period is over and counts anew) or exceeded; administrators and kinds without a limit are always allowed."""
    return F.when(F.coalesce(admin, F.lit(False)) | limit.isNull(), "allowed").when(reset_at <= now, "reset").when(used >= limit, "exceeded").otherwise("allowed")


def meaningful_terms(text: Column, without: list[str]) -> Column:
    """Distinct lower-case terms of four characters or more that begin with a letter, in order, without stopwords."""
    terms = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0)), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 4) & ~t.isin(without)))


def prefix_stems(terms: Column, length: int = 5) -> Column:
    """Distinct prefixes of the terms that are long enough, so that inflections count as one."""
    return F.array_distinct(F.transform(F.filter(terms, lambda t: F.length(t) >= length), lambda t: F.substring(t, 1, length)))


def self_contradicts(anchor: Column, critique: Column, without: list[str]) -> Column:
    """Whether a task's own quotation has what the task says is missing: half of the critique's stems, or three of them."""
    wanted, held = prefix_stems(meaningful_terms(critique, without)), prefix_stems(meaningful_terms(anchor, without))
    met = F.size(F.array_intersect(wanted, held))
    return (F.trim(F.coalesce(anchor, F.lit(""))) != "") & (F.size(wanted) > 0) & ((met >= F.size(wanted) * 0.5) | (met >= 3))


def keywords(sources: Column) -> Column:
    """Distinct lower-case words of more than three characters of an array of texts, in order, without signs around them."""
    words = F.flatten(F.transform(sources, lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: F.length(w) > 3)))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,;:?!()\[\]{}]+|[.,;:?!()\[\]{}]+$", "")))


def keyword_groups(words: Column, size: int = 5, most: int = 3) -> Column:
    """Up to ``most`` groups of ``size`` keywords each; few keywords are one group."""
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * size), lambda i: (i < F.size(words)) | (i == 0))
    return F.transform(starts, lambda i: F.slice(words, i + 1, F.lit(size)))


def first_number(text: Column, default: float) -> Column:
    """The number that a text begins with, else the default."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(-?\d+(\.\d+)?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(default))


def first_year(*candidates: Column) -> Column:
    """The first year from 1900 to 2100 that a candidate holds; NULL if none does."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(19\d{2}|20\d{2}|2100)", 1), F.lit("")).cast("int") for c in candidates]
    return F.coalesce(*found)


def distinct_names(names: Column, most: int = 20) -> Column:
    """Names without repeats in another case, the first spelling kept, in order, ``most`` at most; blank ones go."""
    clean = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n.isNotNull() & (n != ""))
    none = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(clean, none, lambda seen, n: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(n)), seen).otherwise(F.array_append(seen, n)))
    return F.slice(kept, 1, most)


def filled(existing: Column, candidate: Column, overwrite: bool = False) -> Column:
    """A field of merged metadata: what is there stays unless it is empty (or its kind is always overwritten); empty candidates change nothing."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has(candidate), candidate).otherwise(existing) if overwrite else F.when(has(existing), existing).when(has(candidate), candidate).otherwise(existing)


def spaced(text: Column) -> Column:
    """White space, no-break spaces and soft hyphens as one space each run, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s ­]+", " "))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each closed by a zero byte; NULL is empty."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts]), 256)


def metric_number(text: Column) -> Column:
    """A metric of a JSON record as a number; truth values and NaN are NULL."""
    value = text.try_cast("double")
    return F.when(~F.lower(text).isin("true", "false") & ~F.isnan(value), value)


def tolerance_band(n: Column) -> Column:
    """A tenth of a count, rounded up."""
    return F.ceil(n * F.lit(1) / 10).cast("int")
