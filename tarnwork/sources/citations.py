"""Readers of reference lists: BibTeX and TEI."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(name: str) -> Column:
    """A BibTeX field in braces or quotes, or a bare number, white space as one space; NULL if absent."""
    start = rf"(?is)(?:^|[,\s]){name}\s*=\s*"
    found = F.coalesce(*[F.nullif(F.regexp_extract("entry", start + rest, 1), F.lit("")) for rest in (r"\{((?:[^{}]|\{[^{}]*\})*)\}", r"\"([^\"]*)\"", r"(\d+)")])
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, r"[{}]", ""), r"\s+", " ")), F.lit(""))


def bibtex_entries(files: DataFrame) -> DataFrame:
    """(file_id, place, kind, cite_key, title, author, year int, doi) of files (file_id, text).

    An entry begins at an @kind{key, at the beginning of a line and ends before the next; anything before the first,
    @comment, @string and @preamble are skipped.  Absent fields are NULL; null texts have no entries.
    """
    cut = files.select("file_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?m)^\s*@")).alias("place", "entry")).where("place > 0")
    kind = F.lower(F.regexp_extract("entry", r"^(\w+)\s*\{", 1))
    key = F.trim(F.regexp_extract("entry", r"^\w+\s*\{\s*([^,\s]*)\s*,", 1))
    entries = cut.withColumn("kind", kind).withColumn("cite_key", key).where(~F.col("kind").isin("", "comment", "string", "preamble"))
    return entries.select("file_id", "place", "kind", "cite_key", _field("title").alias("title"), _field("author").alias("author"), _field("year").cast("int").alias("year"), _field("doi").alias("doi"))


def _tei(xml: str | None) -> tuple[str | None, str | None, list[str] | None, int | None]:
    """Title, abstract, headings and number of references of a TEI file, in one pass; what is no XML raises."""
    if not xml:
        return None, None, None, None
    path: list[str] = []
    parts: dict[str, list[str]] = {}  # text of the first title and abstract
    opened: dict[str, int] = {}
    headings: list[str] = []
    said: list[str] = []
    references = 0

    def end_of_text() -> None:
        if said and path[-3:] == ["body", "div", "head"]:
            headings.append("".join(said))
        said.clear()

    def start(name: str, attributes: dict) -> None:
        nonlocal references
        end_of_text()
        name = name.rpartition(":")[2]
        path.append(name)
        references += path[-2:] == ["listBibl", "biblStruct"]
        if (name == "abstract" or path[-2:] == ["titleStmt", "title"]) and name not in parts:
            parts[name], opened[name] = [], len(path)

    def end(name: str) -> None:
        end_of_text()
        if opened.get(path[-1]) == len(path):
            del opened[path[-1]]
        path.pop()

    def text(chars: str) -> None:
        said.append(chars)
        for name in opened:
            parts[name].append(chars)

    parser = expat.ParserCreate("utf-8")  # names as written; namespaces make no difference
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: end_of_text()
    parser.Parse(xml.encode(), True)
    title, abstract = ("".join(parts.get(name, [])).strip(" ") for name in ("title", "abstract"))
    return title, abstract, headings, references


def tei_fields(files: DataFrame) -> DataFrame:
    """(file_id, title, abstract, headings array<string>, n_references) of TEI files (file_id, xml); NULL stays NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
        for batch in batches:
            rows = [_tei(xml.as_py()) for xml in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]], ["file_id", "title", "abstract", "headings", "n_references"])

    known = files.select("file_id", F.col("xml").cast("string").alias("xml"))
    schema = f"file_id {known.schema['file_id'].dataType.simpleString()}, title string, abstract string, headings array<string>, n_references int"
    return known.mapInArrow(run, schema)
