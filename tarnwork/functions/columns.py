"""Column builders with the semantics that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def nearest_rank(column: str, q: float) -> Column:
    """The value of rank ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def refused_below(value: Column, n: Column, least: int) -> Column:
    """NULL where there are too few values for the statistic."""
    return F.when(n >= least, value)


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-case ASCII words of more than ``longer_than`` characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


def title_words(text: Column, longer_than: int, without: list[str] | None = None, joined: bool = False) -> Column:
    """Distinct lower-case words of any alphabet with more than ``longer_than`` characters; joined: other signs vanish, so that "co-op" is one word."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(F.regexp_replace(lower, r"[^\p{L}\p{N}_\s]", ""), r"\s+") if joined else F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(without)) if without else F.filter(words, lambda w: F.length(w) > longer_than)
    return F.array_distinct(kept)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Shared items over the size of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half
