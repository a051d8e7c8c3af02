"""Column builders over wording: normal forms of findings, quotations, citation groups, bag-of-words cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that do not tell one finding from another.
FINDING_STOPWORDS = ["the", "and", "or", "but", "with", "that", "this", "from", "into", "your", "draft", "paper", "manuscript", "study"]


def normal_finding(text: Column) -> Column:
    """Lower-case letters and digits, one space between words, without stopwords; NULL is empty."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(FINDING_STOPWORDS)), " ")


def is_verbatim(anchor: Column, text: Column) -> Column:
    """Whether a quotation stands in the text, white space aside; one under 3 words and 24 characters is let through."""
    quoted, body = F.regexp_replace(F.coalesce(anchor, F.lit("")), r"^\s+|\s+$", ""), F.coalesce(text, F.lit(""))
    short = (F.size(F.split(quoted, r"\s+")) < 3) & (F.length(quoted) < 24)
    spaced = F.contains(F.regexp_replace(body, r"\s+", " "), F.regexp_replace(quoted, r"\s+", " "))
    return F.when((quoted == "") | (body == ""), False).otherwise(short | F.contains(body, quoted) | spaced)


def numeric_group(value: Column) -> Column:
    """The numbers and ranges of a numeric citation, in order; four digits are a year and go."""
    parts = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""), "[,;]")
    return F.filter(parts, lambda p: p.rlike(r"^\d{1,3}(-\d{1,3})?$"))


def text_cosine(pairs: DataFrame, keys: list[str], left: str, right: str, word: str = "[a-z0-9]{3,}") -> DataFrame:
    """(keys, cosine) of the word counts of two texts a row; 0 where either has no word.  The keys name one row each.

    Words are exploded and counted with map-side combine, so a very long text is no single task's work.
    """
    sides = [pairs.select(*keys, F.explode(F.regexp_extract_all(F.lower(c), F.lit(f"({word})"))).alias("w"), F.lit(int(c == left)).alias("is_left")) for c in (left, right)]
    counts = sides[0].unionByName(sides[1]).groupBy(*keys, "w").agg(F.sum("is_left").alias("l"), F.sum(1 - F.col("is_left")).alias("r"))
    sums = counts.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).cast("double").alias(a + b) for a, b in ("lr", "ll", "rr")])
    scored = sums.select(*keys, F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("lr") / (F.sqrt("ll") * F.sqrt("rr"))).otherwise(0.0).alias("cosine"))
    return pairs.select(*keys).join(scored, keys, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
