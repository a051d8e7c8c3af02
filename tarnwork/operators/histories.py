"""Append-only files of lines: what changed, shrank or went, and what a new run adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_only(base: DataFrame, now: DataFrame) -> DataFrame:
    """(file, status, line, base_lines, now_lines) of each file of ``base``: lines (file, line, text), numbered from 0.

    status: deleted (no line is left), shrank, rewritten (line: the first that differs), or appended.  Lines meet in a join by file and number, so
    no file is gathered.  An absent text is a line like any other; files that only ``now`` has are new and not listed.
    """
    of = lambda df, name: df.select("file", "line", F.struct(F.col("text").alias("text")).alias(name))
    both = of(base, "was").join(of(now, "is"), ["file", "line"], "full")
    differs = F.col("was").isNotNull() & F.col("is").isNotNull() & ~F.col("was").eqNullSafe(F.col("is"))
    files = both.groupBy("file").agg(F.count("was").alias("base_lines"), F.count("is").alias("now_lines"), F.min(F.when(differs, F.col("line"))).alias("line")).where("base_lines > 0")
    status = F.when(F.col("now_lines") == 0, "deleted").when(F.col("now_lines") < F.col("base_lines"), "shrank").when(F.col("line").isNotNull(), "rewritten").otherwise("appended")
    return files.select("file", status.alias("status"), F.when(status == "rewritten", F.col("line")).alias("line"), "base_lines", "now_lines")


def appended(base: DataFrame, now: DataFrame) -> DataFrame:
    """(file, line, text): the lines that ``now`` adds behind those of ``base``."""
    ends = base.groupBy("file").agg((F.max("line") + 1).alias("end"))
    return now.join(ends, "file", "left").where(F.col("line") >= F.coalesce("end", F.lit(0))).select("file", "line", "text")


def history(lines: DataFrame, key: str) -> DataFrame:
    """(file, line, value): the records of a history (file, line, text) that are JSON objects with ``key``, its value as text.

    Blank and damaged lines, and other JSON, are skipped.
    """
    record = F.try_parse_json("text")
    is_object = F.schema_of_variant(record).startswith("OBJECT")
    value = F.try_variant_get(record, f"$.{key}", "string")
    return lines.where(is_object).select("file", "line", value.alias("value")).where("value is not null")
