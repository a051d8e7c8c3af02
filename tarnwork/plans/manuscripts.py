"""Queries of bibliographies, reviewers' shares and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import manuscripts as M
from ..sources.tables import table
from .registry import query

_START = M.ENTRY_START.replace("'", "''")
_LINES = r"""lines AS (SELECT doc_id, i - 1 AS line, CASE WHEN doc_id % 2 = 0 AND i % 3 = 1 THEN '[' || i % 900 || '] ' WHEN doc_id % 2 = 1 AND i % 2 = 1 THEN 'T. Akiba and ' ELSE '' END || l[i] || CASE WHEN i % 3 = 0 THEN ' 2015' WHEN i % 5 = 0 THEN ' exam-' ELSE '' END AS text
FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS t(i))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents as lines of a bibliography: numbered ones in every other document, authors in the rest."""
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("line", "said"))
    i = F.col("line") + 1
    head = F.when((F.col("doc_id") % 2 == 0) & (i % 3 == 1), F.concat(F.lit("["), (i % 900).cast("string"), F.lit("] "))).when((F.col("doc_id") % 2 == 1) & (i % 2 == 1), "T. Akiba and ").otherwise("")
    return s.select("doc_id", "line", F.concat(head, "said", F.when(i % 3 == 0, " 2015").when(i % 5 == 0, " exam-").otherwise("")).alias("text"))


@query(rf"""WITH {_LINES}, k AS (SELECT doc_id, line, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text FROM lines), m AS (SELECT *, count(*) FILTER (regexp_matches(text, '{M.NUMBERED}')) OVER (PARTITION BY doc_id) >= 5 AS by_number FROM k WHERE text <> ''),
o AS (SELECT *, CASE WHEN by_number THEN regexp_matches(text, '{M.NUMBERED}') ELSE regexp_matches(text, '{_START}') END AS opens, regexp_matches(text, '{M.YEAR}') AS y FROM m),
p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM o), g AS (SELECT doc_id, part, bool_or(by_number) AS by_number, bool_or(y) AS y FROM p GROUP BY ALL),
s AS (SELECT doc_id, part, CASE WHEN by_number THEN true ELSE coalesce(lag(y) OVER w, true) END AS starts FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY part)), e AS (SELECT doc_id, part, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY part) AS entry FROM s),
j AS (SELECT doc_id, entry, min(line) AS line, string_agg(text, ' ' ORDER BY line) AS raw FROM p JOIN e USING (doc_id, part) GROUP BY doc_id, entry),
c AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'), '{M.NUMBERED}', ''), '([a-z])-[ \t\n\x0B\f\r]+([a-z])', '\1\2', 'g') AS text FROM j)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INT) AS entry, sha256(text) AS text_sha256 FROM c WHERE length(text) > 25 AND regexp_matches(text, '{M.YEAR}')""")
def bibliography_split(spark: SparkSession, d: str) -> DataFrame:
    return M.bibliography_entries(_lines(spark, d)).select("doc_id", "entry", F.sha2("text", 256).alias("text_sha256"))


@query()
def title_guess(spark: SparkSession, d: str) -> DataFrame:
    """Titles guessed from the entries (tested by hand-made cases)."""
    return M.bibliography_entries(_lines(spark, d)).select("doc_id", "entry", M.title_guess(F.col("text")).alias("title"))


_SPANS = "spans AS (SELECT conv_id AS doc_id, turn AS span, CASE turn % 3 WHEN 0 THEN 'methods' WHEN 1 THEN 'statistics' END AS lane, coalesce(length(text), 0) AS length FROM conversations)"
_SHARES = f"""{_SPANS}, mine AS (SELECT *, unnest(CASE WHEN lane IS NULL THEN ['methods', 'statistics', 'writing'] ELSE [lane] END) AS reviewer, lane IS NOT NULL AS claimed FROM spans),
t AS (SELECT *, coalesce(sum(length) FILTER (claimed) OVER w, 0) AS c, coalesce(sum(length) FILTER (NOT claimed) OVER w, 0) AS u, sum(length) OVER v AS total, count(*) OVER v AS n FROM mine WINDOW w AS (PARTITION BY doc_id, reviewer), v AS (PARTITION BY doc_id, reviewer, claimed)),
r AS (SELECT *, CASE WHEN c >= 600 THEN least(u, 100) ELSE 600 - c END AS reserve FROM t), g AS (SELECT *, CASE WHEN claimed THEN CASE WHEN c >= 600 THEN 600 - reserve ELSE c END ELSE reserve END AS given FROM r),
b AS (SELECT *, least(length, least(40, floor(given / n))) AS base FROM g), s AS (SELECT *, sum(base) OVER (PARTITION BY doc_id, reviewer, claimed) AS bases FROM b),
shares AS (SELECT doc_id, reviewer, span, length, CAST(CASE WHEN total <= given THEN length ELSE base + CASE WHEN given > bases AND total > bases THEN floor((given - bases) * (length - base) / (total - bases)) ELSE 0 END END AS BIGINT) AS allowance FROM s)"""


def _shares(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as spans of a manuscript, with a budget of 600 characters for each of three reviewers."""
    lane = F.when(F.col("turn") % 3 == 0, "methods").when(F.col("turn") % 3 == 1, "statistics")
    spans = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("span"), lane.alias("lane"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    return spans, M.allowances(spans, ["methods", "statistics", "writing"], 600, 40)


@query(f"WITH {_SHARES} SELECT doc_id, reviewer, span, allowance FROM shares")
def persona_allowance(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)[1]


@query(f"""WITH {_SHARES}, best AS (SELECT doc_id, span, max(allowance) AS seen FROM shares GROUP BY ALL), o AS (SELECT doc_id, span, length, coalesce(seen, 0) AS seen FROM spans LEFT JOIN best USING (doc_id, span))
SELECT doc_id, count(*) AS spans, CAST(sum(length) AS BIGINT) AS chars, CAST(sum(seen) AS BIGINT) AS covered, count(*) FILTER (seen < length) AS dropped_spans, round(CASE WHEN sum(length) > 0 THEN sum(seen) / sum(length) ELSE 1.0 END, 6) AS ratio FROM o GROUP BY doc_id""")
def scoping_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.scoping_coverage(*_shares(spark, d)).withColumn("ratio", rounded("ratio"))


_REFS = r"""w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL),
refs AS (SELECT doc_id AS draft_id, k AS ref_id, 'A ' || w[k * 5] AS author, 2000 + k AS year, array_to_string(w[k * 7:k * 7 + 5], ' ') || CASE WHEN k = 2 THEN ' unwritten' ELSE '' END AS title FROM w, unnest([1, 2, 3]) AS t(k) WHERE len(w) >= 30),
drafts AS (SELECT doc_id AS draft_id, text || CASE WHEN len(w) >= 30 AND doc_id % 2 = 0 THEN ' ' || w[15] || ' and others, 2003' ELSE '' END AS text FROM w)"""


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three references of each longer document, made of its words; every other document cites the third."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    k = F.col("ref_id")
    title = F.concat(F.array_join(F.slice("w", k * 7, F.lit(6)), " "), F.when(k == 2, " unwritten").otherwise(""))
    refs = w.where("size(w) >= 30").withColumn("ref_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(F.col("doc_id").alias("draft_id"), "ref_id", F.concat(F.lit("A "), F.element_at("w", k * 5)).alias("author"), (2000 + k).alias("year"), title.alias("title"))
    cites = (F.size("w") >= 30) & (F.col("doc_id") % 2 == 0)
    return refs, w.select(F.col("doc_id").alias("draft_id"), F.concat("text", F.when(cites, F.concat(F.lit(" "), F.expr("try_element_at(w, 15)"), F.lit(" and others, 2003"))).otherwise("")).alias("text"))


@query(rf"""WITH {_REFS}, x AS (SELECT r.*, lower(d.text) AS body, lower(split_part(author, ' ', 2)) AS last, list_filter(regexp_extract_all(title, '[A-Za-z]+'), lambda v: length(v) > 5)[1:4] AS words FROM refs r JOIN drafts d USING (draft_id))
SELECT draft_id, ref_id FROM x WHERE NOT (length(last) > 2 AND regexp_matches(body, '(?s)\b' || last || '\b.{{0,40}}\b' || year || '\b')) AND NOT (len(words) > 0 AND len(list_filter(words, lambda v: NOT contains(body, lower(v)))) = 0)""")
def unused_refs_anti(spark: SparkSession, d: str) -> DataFrame:
    return M.unused_references(*_refs(spark, d)).select("draft_id", "ref_id")


@query(rf"""WITH {_REFS}, claims AS (SELECT doc_id AS draft_id, i AS claim_id, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS t(i)),
cw AS (SELECT draft_id, claim_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda v: length(v) > 4)) AS w FROM claims), rw AS (SELECT draft_id, ref_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), lambda v: length(v) > 4)) AS w FROM refs),
o AS (SELECT draft_id, claim_id, ref_id, len(list_intersect(c.w, r.w)) / least(len(c.w), len(r.w)) AS overlap FROM cw c JOIN rw r USING (draft_id) WHERE len(list_intersect(c.w, r.w)) > 0)
SELECT draft_id, claim_id, ref_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.25""")
def weak_claim_ref_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines as claims: the references of their draft that share a quarter of the words."""
    refs, _ = _refs(spark, d)
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("draft_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return M.references_for_claims(lines.select("draft_id", (F.col("at") + 1).alias("claim_id"), "text"), refs.select("draft_id", "ref_id", F.col("title").alias("text"))).select("draft_id", F.col("claim_id").cast("long").alias("claim_id"), "ref_id", rounded("overlap").alias("overlap"))
