"""The registered queries of the operators, with production parameters over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, extraction, licenses, passages, quality, sentencepieces, simhash, suffixes, tokencount, toxicity, variants

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.array_join("near_items", ",").alias("near_items"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules_failed", ",").alias("rules_failed"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.read_back(chat.format_conversations(chat.message_events(turns.unionByName(extra))), in_order=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    held_out = F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.paragraph_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_paragraphs_removed", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "classes", "spans")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))
    return coded.select("doc_id", "n_bytes", "n_pieces", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_counts, op3_quality_rules, op4_chat_format, op5_toxicity,
        op6_paragraph_dedup, op7_sentencepiece, op8_suffix_dedup, op9_license_scan, op10_simhash,
        op11_spelling_variants, op12_collocations, op13_html_extraction,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_PHRASES = ", ".join(f"({[*p.split()]}, '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES.items())

ORACLE_SQL: dict[str, str] = {
    "op9_license_scan": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}),
stands AS (SELECT doc_id, i - 1 AS spot, label FROM docs, phrases, unnest(range(1, greatest(len(w) - len(p) + 1, 0) + 1)) AS t(i) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM stands GROUP BY doc_id),
texts(template, text) AS (VALUES {_TEMPLATES}),
templates AS (SELECT template, {_WORDS} AS tw FROM texts),
tg AS (SELECT template, i AS place, tw[i:i + 4] AS gram FROM templates, unnest(range(1, len(tw) - 3)) AS t(i)),
met AS (
  SELECT doc_id, template, pos, place, pos - place AS diagonal FROM (SELECT doc_id, i AS pos, w[i:i + 4] AS gram FROM docs, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS t(i)) JOIN tg USING (gram)
),
marked AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER o <= 4 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, template, diagonal FROM met) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
banded AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM marked),
spread AS (SELECT DISTINCT doc_id, template, band, pos + j AS p, place + j AS q FROM met JOIN banded USING (doc_id, template, diagonal), unnest(range(0, 5)) AS t(j)),
cut AS (SELECT doc_id, template, band, p, CASE WHEN p - lag(p) OVER o <= 5 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, template, band, p FROM spread) WINDOW o AS (PARTITION BY doc_id, template, band ORDER BY p)),
runs AS (SELECT doc_id, template, band, p, sum(new) OVER (PARTITION BY doc_id, template, band ORDER BY p) AS run FROM cut),
spans AS (SELECT doc_id, template, band, run FROM runs GROUP BY doc_id, template, band, run HAVING count(*) >= 10),
covered AS (
  SELECT doc_id, template, count(DISTINCT q) / max(len(tw)) AS coverage FROM spans JOIN runs USING (doc_id, template, band, run) JOIN spread USING (doc_id, template, band, p) JOIN templates USING (template)
  GROUP BY doc_id, template
),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM stands UNION ALL SELECT doc_id, template FROM covered WHERE coverage >= 0.5) GROUP BY doc_id),
best AS (SELECT doc_id, max(coverage) AS coverage FROM covered GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(coverage, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)""",
    "op1_decontaminate": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS gram
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS gram FROM docs, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)
),
hits AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.gram = x.gram),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
said AS (SELECT doc_id, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
common AS (SELECT word, count(*) AS n FROM said GROUP BY word),
rarest AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY n, encode(word)) AS r FROM (SELECT DISTINCT item_id, unnest(w) AS word FROM items) JOIN common USING (word)
),
terms AS (SELECT item_id, word, count(*) OVER (PARTITION BY item_id) AS n_terms FROM rarest WHERE r <= 4),
places_of AS (SELECT doc_id, item_id, i, word, n_terms FROM terms JOIN said USING (word)),
close AS (
  SELECT a.doc_id, a.item_id FROM places_of a JOIN places_of b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.i > a.i - 26 AND b.i <= a.i
  GROUP BY a.doc_id, a.item_id, a.i HAVING count(DISTINCT b.word) = max(a.n_terms)
),
near AS (
  SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM (SELECT DISTINCT doc_id, item_id FROM close) ANTI JOIN hits USING (doc_id, item_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(near_items, '') AS near_items
FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 15 AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op8_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM docs, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE doc_id > least),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM covered),
runs AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM spans)),
kept AS (SELECT g.doc_id, string_agg(CASE WHEN g.b IS NULL THEN substring(h, CAST(2 * g.a + 1 AS BIGINT)) ELSE substring(h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (g.b - g.a) AS BIGINT)) END, '' ORDER BY g.a) AS h FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op11_spelling_variants": r"""
WITH RECURSIVE bits(i, step, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY id, run
),
bytes AS (SELECT id, run, times, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT id, run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda k: CAST(('0x' || substr(x, 2 * k + 1, 2)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM bytes, crc
),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
up(word, top, step) AS (SELECT word, word, 0 FROM known UNION ALL SELECT up.word, k.form, step + 1 FROM up JOIN known k ON k.word = up.top WHERE k.form IS NOT NULL),
roots AS (SELECT word, arg_max(top, step) AS root FROM up GROUP BY word)
SELECT k.word, k.form, r.root, k.n, k.n_near, k.form_n FROM known k JOIN roots r USING (word)""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  )
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g FROM words, (VALUES (1), (2), (3), (4)) AS s(m), unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) AS t(i)
),
f AS (SELECT lang, m, g, count(*) AS a FROM grams GROUP BY lang, m, g),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, g, a FROM f WHERE m > 1 AND a >= 30),
cut AS (
  SELECT c.lang, c.m, c.g, c.a, k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM candidates c, unnest(range(1, m)) AS t(k) JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, g[i:i + n - 1] AS g, max(a) AS of FROM candidates, (VALUES (2), (3)) AS s(n), unnest(range(1, greatest(m - n + 1, 0) + 1)) AS t(i) WHERE n < m GROUP BY ALL),
left_ AS (SELECT x.*, array_to_string(x.g, ' ') AS phrase FROM lowest x LEFT JOIN inner_ y ON x.lang = y.lang AND x.g = y.g WHERE coalesce(100 * CAST(y.of AS HUGEINT) < 80 * CAST(x.a AS HUGEINT), true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_html_extraction": r"""
WITH cut AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inside FROM pages),
parts AS (SELECT page_id, url, unnest(regexp_split_to_array(inside, '</?(h1|p)>')) AS part, generate_subscripts(regexp_split_to_array(inside, '</?(h1|p)>'), 1) AS i FROM cut),
plain AS (SELECT page_id, url, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g')) AS block FROM parts),
texts AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY i) FILTER (WHERE block <> ''), '') AS text FROM plain GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts""",
}
