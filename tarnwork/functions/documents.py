"""Nested values of unknown shape: canonical forms, their hashes, values by path, texts without NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no white space; NULL if it is no JSON.  Objects that differ in order only are equal."""
    return F.to_json(F.try_parse_json(text))


def config_hash(text: Column, length: int = 12) -> Column:
    """The first characters of the SHA-256 of the canonical form."""
    return F.substring(F.sha2(canonical_json(text), 256), 1, length)


def dig(text: Column, *path: str) -> Column:
    """The value at a path of keys, as text; NULL where a step is missing or no object."""
    at = "$" + "".join(f"['{p}']" for p in path)
    return F.try_variant_get(F.try_parse_json(text), at, "string")


def json_without_nul(text: Column) -> Column:
    """JSON whose strings, keys too, have no NUL: the escape goes, but not a backslash escape that only looks like it."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)(?:\\u0000)+", "$1")
