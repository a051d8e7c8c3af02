"""Queries of citations, anchors, contained strings, histories, nested values and streams whose state expires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from ..operators import anchors, histories
from ..sources.stored import fresh_path
from ..sources.tables import table
from ..streaming import progress, sessions
from .registry import query

#: Texts that cite: a capital word after a full stop is an author, a comma is followed by a number.
_CITING = r"regexp_replace(regexp_replace(coalesce(text, ''), '[.] ([A-Z][a-z]+) ', '. \1 (' || (1990 + doc_id % 30) || ') ', 'g'), ', ', ' [' || (doc_id % 9 + 1) || '], ', 'g')"
_NUMBERED = f"docs AS (SELECT doc_id, {_CITING} AS text FROM documents)"
_FOUND = r"""narrative AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+et\s+al\.)?\s+\(\d{4}[a-z]?\)') AS m, regexp_split_to_array(text, '\b[A-Z][a-z]+(?:\s+et\s+al\.)?\s+\(\d{4}[a-z]?\)') AS p FROM docs),
numeric_ AS (SELECT doc_id, regexp_extract_all(text, '\[\d+\]') AS m, regexp_split_to_array(text, '\[\d+\]') AS p FROM docs),
every AS (SELECT doc_id, 'narrative' AS kind, m, p FROM narrative UNION ALL SELECT doc_id, 'numeric', m, p FROM numeric_),
spots AS (SELECT doc_id, kind, m[i] AS citation, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM every, unnest(range(1, len(m) + 1)) AS t(i)),
cited AS (SELECT doc_id, kind, citation, min(start) AS start FROM spots GROUP BY ALL)"""


def _citing(spark: SparkSession, d: str) -> DataFrame:
    year, number = (1990 + F.col("doc_id") % 30).cast("string"), (F.col("doc_id") % 9 + 1).cast("string")
    named = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"[.] ([A-Z][a-z]+) "), F.concat(F.lit(". $1 ("), year, F.lit(") ")))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(named, F.lit(", "), F.concat(F.lit(" ["), number, F.lit("], "))).alias("text"))


@query(f"WITH {_NUMBERED}, {_FOUND} SELECT doc_id, kind, citation, start, start + length(citation) AS stop FROM cited")
def extract_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations with their first places in texts that cite."""
    return anchors.citations(_citing(spark, d)).select("doc_id", "kind", "citation", "start", "stop")


@query(f"""WITH {_NUMBERED}, {_FOUND}, tokens AS (SELECT doc_id, CASE kind WHEN 'numeric' THEN substr(citation, 2, length(citation) - 2) ELSE citation END AS token, start FROM cited)
SELECT doc_id, string_agg(token, ';' ORDER BY start) AS tokens, count(*) AS n FROM tokens GROUP BY doc_id""")
def extract_citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What each text cites, in the order of first places."""
    found = anchors.citations(_citing(spark, d)).select("doc_id", "start", F.when(F.col("kind") == "numeric", F.expr("substring(citation, 2, length(citation) - 2)")).otherwise(F.col("citation")).alias("token"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "token"))).alias("t"), F.count("*").alias("n")).select("doc_id", F.array_join(F.transform("t", lambda x: x["token"]), ";").alias("tokens"), "n")


_LINES = r"""lines AS (SELECT doc_id, i - 1 AS claim_id, l[i] AS line, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS t(i)),
claims AS (SELECT doc_id, claim_id, start, start + length(line) AS stop FROM lines WHERE line <> ''),
gaps AS (SELECT c.doc_id, c.claim_id, m.start AS mark_id, m.start > c.start AS behind, CASE WHEN m.start <= c.start THEN greatest(0, c.start - m.start - length(m.citation)) ELSE greatest(0, m.start - c.stop) END AS distance, m.start AS spot FROM claims c JOIN cited m USING (doc_id)),
nearest AS (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY doc_id, claim_id ORDER BY distance, behind, CASE WHEN behind THEN spot ELSE -spot END) = 1),
near AS (SELECT c.doc_id, c.claim_id, CASE WHEN distance <= 100 THEN mark_id END AS mark_id, CASE WHEN distance <= 100 THEN distance END AS distance FROM claims c LEFT JOIN nearest USING (doc_id, claim_id))"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    docs = _citing(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("claim_id", "line"), "text")
    before = F.slice(F.split("text", "\n"), F.lit(1), F.col("claim_id"))
    start = F.length(F.array_join(before, "\n")) + F.when(F.col("claim_id") > 0, 1).otherwise(0)
    claims = lines.where("line <> ''").select("doc_id", F.col("claim_id").cast("long").alias("claim_id"), start.cast("long").alias("start"), (start + F.length("line")).cast("long").alias("stop"))
    marks = anchors.citations(docs).select("doc_id", F.col("start").alias("mark_id"), "start", "stop")
    return anchors.nearest_intervals(claims, marks, 100)


@query(f"WITH {_NUMBERED}, {_FOUND}, {_LINES} SELECT doc_id, claim_id, mark_id, distance FROM near")
def citation_near_claim(spark: SparkSession, d: str) -> DataFrame:
    """The first place of a citation that is nearest to each line, within 100 characters."""
    return _near(spark, d)


@query(f"WITH {_NUMBERED}, {_FOUND}, {_LINES} SELECT doc_id, count(*) AS claims, count(mark_id) AS has_citation, count(*) - count(mark_id) AS needs_citation FROM near GROUP BY doc_id")
def citation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Claims that need no citation as one stands near them, and those that do."""
    return _near(spark, d).groupBy("doc_id").agg(F.count("*").alias("claims"), F.count("mark_id").alias("has_citation"), (F.count("*") - F.count("mark_id")).alias("needs_citation"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORMAL = r"trim(regexp_replace(lower({x}), '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
_SNIPPETS = rf"""w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
snippets AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[11:30], ' ') WHEN 1 THEN translate(array_to_string(w[11:30], '  '), '{_LOW}', '{_UP}') WHEN 2 THEN array_to_string(list_concat(['zzz'], w[11:30]), ' ') ELSE 'nowhere at all' END AS snippet FROM w WHERE len(w) >= 30),
tried AS (SELECT *, {_NORMAL.format(x='text')} AS body, regexp_split_to_array(trim(snippet), '\s+') AS sw FROM snippets),
windows AS (SELECT *, list_filter(flatten([list_transform(range(1, greatest(len(sw) - n + 1, 0) + 1), lambda i: array_to_string(sw[i:i + n - 1], ' ')) FOR n IN [14, 10, 7]]), lambda x: length(x) >= 35) AS c,
  list_filter(regexp_split_to_array(regexp_replace(snippet, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) >= 30) AS s FROM tried),
judged AS (SELECT doc_id, text, snippet, CASE WHEN contains(text, snippet) THEN 'exact' WHEN contains(body, {_NORMAL.format(x='snippet')}) THEN 'normalized' WHEN len(list_filter(s, lambda x: contains(body, {_NORMAL.format(x='x')}))) > 0 THEN 'sentence'
  WHEN len(list_filter(c, lambda x: contains(body, {_NORMAL.format(x='x')}))) > 0 THEN 'window' ELSE 'not_found' END AS way FROM windows)"""


def _located(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    words = F.slice("w", 11, 20)
    upper = F.translate(F.array_join(words, "  "), _LOW, _UP)
    of = F.col("doc_id") % 4
    snippet = F.when(of == 0, F.array_join(words, " ")).when(of == 1, upper).when(of == 2, F.concat_ws(" ", F.lit("zzz"), F.array_join(words, " "))).otherwise("nowhere at all")
    s = docs.select("doc_id", w.alias("w")).where("size(w) >= 30").select(F.col("doc_id").alias("snippet_id"), "doc_id", snippet.alias("snippet"))
    return anchors.locate_snippets(s, docs)


@query(f"WITH {_SNIPPETS} SELECT doc_id, way, CASE way WHEN 'exact' THEN 0.95 WHEN 'normalized' THEN 0.88 WHEN 'sentence' THEN 0.74 WHEN 'window' THEN 0.66 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN way = 'exact' THEN position(snippet IN text) - 1 END::BIGINT AS exact_start FROM judged")
def locate_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Passages as they are, in capitals, with a word that is not there, and elsewhere: how they are found again."""
    return _located(spark, d).select("doc_id", "way", "confidence", F.when(F.col("way") == "exact", F.col("start")).alias("exact_start"))


@query(f"WITH {_SNIPPETS} SELECT way, count(*) AS n FROM judged GROUP BY way")
def repair_anchor(spark: SparkSession, d: str) -> DataFrame:
    """How many anchors each way repairs."""
    return _located(spark, d).groupBy("way").agg(F.count("*").alias("n"))


_PIECES = "pieces AS (SELECT item_id * 1000 + i AS string_id, l[i] AS string FROM (SELECT item_id, string_split(text, '. ') AS l FROM benchmark), unnest(range(1, len(l) + 1)) AS t(i) WHERE length(l[i]) >= 8)"


@query(f"WITH {_PIECES} SELECT string_id, doc_id AS text_id FROM pieces JOIN documents ON contains(text, string)")
def citation_edge_join(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the benchmark, of eight characters or more, that stand in documents as they are."""
    pieces = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "string")).select((F.col("item_id") * 1000 + F.col("i") + 1).alias("string_id"), "string").where("length(string) >= 8")
    return anchors.contained_in(pieces, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


_TURNS = "SELECT conv_id AS file, turn AS line, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN text || '!' ELSE text END AS text FROM conversations WHERE conv_id % 11 <> 5 AND NOT (conv_id % 5 = 2 AND turn > 0) UNION ALL SELECT conv_id, max(turn) + 1, 'more' FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 5 <> 2 GROUP BY conv_id"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as files of lines, and a later state of them: some are gone, some cut, some changed, some longer."""
    t = table(spark, d, "conversations")
    base = t.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "text")
    changed = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = t.where("conv_id % 11 <> 5 AND NOT (conv_id % 5 = 2 AND turn > 0)").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), changed.alias("text"))
    more = t.where("conv_id % 3 = 0 AND conv_id % 5 <> 2").groupBy(F.col("conv_id").alias("file")).agg((F.max("turn") + 1).alias("line")).withColumn("text", F.lit("more"))
    return base, kept.unionByName(more)


@query(f"""WITH now AS ({_TURNS}), b AS (SELECT conv_id AS file, turn AS line, text FROM conversations), j AS (SELECT file, line, b.text AS was, now.text AS is_, b.line IS NOT NULL AS x, now.line IS NOT NULL AS y FROM (SELECT file, line, text, line AS l FROM b) b FULL JOIN now USING (file, line)),
f AS (SELECT file, count(*) FILTER (x) AS base_lines, count(*) FILTER (y) AS now_lines, min(line) FILTER (x AND y AND was IS DISTINCT FROM is_) AS line FROM j GROUP BY file HAVING count(*) FILTER (x) > 0)
SELECT file, CASE WHEN now_lines = 0 THEN 'deleted' WHEN now_lines < base_lines THEN 'shrank' WHEN line IS NOT NULL THEN 'rewritten' ELSE 'appended' END AS status, CASE WHEN now_lines >= base_lines AND now_lines > 0 THEN line END AS line, base_lines, now_lines FROM f""")
def append_only_check(spark: SparkSession, d: str) -> DataFrame:
    return histories.append_only(*_versions(spark, d))


@query(f"WITH now AS ({_TURNS}), e AS (SELECT conv_id AS file, max(turn) + 1 AS e FROM conversations GROUP BY 1) SELECT file, line, text FROM now LEFT JOIN e USING (file) WHERE line >= coalesce(e, 0)")
def append_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The lines that a later state adds."""
    return histories.appended(*_versions(spark, d))


@query("SELECT CAST(floor(event_id / 100) AS BIGINT) AS file, event_id AS line, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 13 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def history_scan(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as lines of history files; every thirteenth is damaged."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 13 == 0, F.expr("left(props, 4)")).otherwise(F.col("props")).alias("text"))
    return histories.history(e, "k")


_NESTED = """'{"user": {"id": ' || user_id || ', "kind": "' || event_type || '"}, "at": ' || event_id || ', "props": ' || props || '}'"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    parts = ['{"user": {"id": ', F.col("user_id").cast("string"), ', "kind": "', F.col("event_type"), '"}, "at": ', F.col("event_id").cast("string"), ', "props": ', F.col("props"), "}"]
    return e.select("event_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


@query("""SELECT event_id, substr(sha256('{"at":' || event_id || ',"props":' || replace(props, ' ', '') || ',"user":{"id":' || user_id || ',"kind":"' || event_type || '"}}'), 1, 12) AS hash FROM events""")
def config_hash(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested configurations: a hash that does not depend on the order of keys."""
    return _nested(spark, d).select("event_id", documents.config_hash(F.col("text")).alias("hash"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_dig(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _nested(spark, d).select("event_id", documents.dig(text, "user", "kind").alias("kind"), documents.dig(text, "props", "k").alias("k"), documents.dig(text, "at", "k").alias("missing"))


@query("""SELECT page_id, length(url) AS n FROM pages""")
def nul_strip_json(spark: SparkSession, d: str) -> DataFrame:
    """Pages' addresses as JSON with a NUL behind every slash: what is left after the NULs go is the address."""
    url = F.to_json(F.struct(F.regexp_replace("url", "/", "/\x00").alias("url")))
    back = F.get_json_object(documents.json_without_nul(url), "$.url")
    return table(spark, d, "pages").select("page_id", F.length(back).cast("long").alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return progress.events_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts", F.col("event_type").alias("step"), F.col("value").alias("percent"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, coalesce(value, 0) AS value, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events WHERE user_id IS NOT NULL), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 86400000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM g), l AS (SELECT user_id, session, max(value) AS percent, arg_max(event_type, (ms, event_id)) AS step, max(ms) AS spot FROM s GROUP BY ALL), last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session DESC) = 1)
SELECT user_id, round(percent, 6) AS percent, step, spot AS "at" FROM last WHERE spot + 86400000 >= (SELECT max(ms) FROM e) - 3600000""")
def progress_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Users' progress that never falls back; who is silent for a day is forgotten."""
    last = sessions.gathered(sessions.progress_snapshots(_stream(spark, d), 86_400), fresh_path(spark, "stream"), ["key"])
    return last.where("not expired").select(F.col("key").alias("user_id"), F.round("percent", 6).alias("percent"), "step", "at")


@query("SELECT user_id, event_id FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) ORDER BY floor(epoch_us(ts) / 1000), event_id) <= 2")
def event_track(spark: SparkSession, d: str) -> DataFrame:
    """The first two events of each user and day."""
    return sessions.gathered(sessions.limited(_stream(spark, d), 2, 86_400), fresh_path(spark, "stream"), mode="append").select(F.col("key").alias("user_id"), "event_id")
