"""SentencePiece encoding and decoding over a relational lattice of pieces.

The lattice of a word: its substrings of bounded length, equi-joined to the piece table, grouped by word.  Folded with
Spark's ``aggregate``: for unigram models by Viterbi; for BPE models, whose encoding is not the path of the best
sum, by merging the adjacent pair whose piece has the best score, the leftmost of equals, until none is left.

Words split where no piece goes across (before a space that follows another character, around line breaks), so the
encoding of a text is that of its words.  The most frequent words are encoded this way once, as a table of bounded size;
each task encodes the words that are not in it by the same merges, in numpy, many words at a time.  Words of more than
``LATTICE_CHARS`` characters (texts without spaces) never enter the lattice: the tasks merge them with a heap.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored, utf8

SPACE = "▁"
#: Words in the broadcast table, and the longest of them.
LEXICON = 50_000
LATTICE_CHARS = 32
#: Words a task keeps besides, and words that it counts before it reports them.
MOST_WORDS = 120_000
COUNTED_WORDS = 150_000
#: Words merged at a time.
MERGED_WORDS = 20_000
#: Tasks that fold the lattice of the frequent words.
WORD_TASKS = 32
BATCH_BYTES = 1_500_000
UNIGRAM, BPE = 1, 2


class Pieces:
    """What a .model file says: pieces with scores, byte pieces, normalisation flags."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.rows = [(i, p.piece, float(p.score)) for i, p in enumerate(model.pieces) if p.type in (1, 4)]  # normal, user-defined
        self.ids = {piece: i for i, piece, _ in self.rows}
        self.score = {piece: s for _, piece, s in self.rows}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(len(p) for p in self.ids)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces that go across words")
        self.text = [p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in model.pieces]

        self._merges: MergeTable | None = None

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode()] if len(self.bytes) == 256 else [self.unknown]

    def encode(self, word: str) -> list[int]:
        """The fold over one word's lattice."""
        return self._viterbi(word) if self.kind == UNIGRAM else self._merge(word)

    def encode_many(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        if self.kind == UNIGRAM:
            return [np.array(self._viterbi(w), "<i4").tobytes() for w in words]
        if self._merges is None:
            self._merges = MergeTable(self)
        found = []
        for i in range(0, len(words), MERGED_WORDS):
            part = words[i : i + MERGED_WORDS]
            short = iter(self._merges.encode([w for w in part if len(w) <= 64]))
            found.extend(next(short) if len(w) <= 64 else np.array(self._merge(w), "<i4").tobytes() for w in part)
        return found

    def _merge(self, word: str) -> list[int]:
        """Merges with a heap, for words of any length."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score, heap = self.score, []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for p in parts if p is not None for x in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def _viterbi(self, word: str) -> list[int]:
        worst = min(self.score.values()) - 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + self.score[word[s:end]], s) for s in range(max(0, end - self.longest), end) if word[s:end] in self.score]
            if word[end - 1] not in self.score:
                options.append((best[end - 1][0] + worst, end - 1))
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        found, at = [], len(word)
        while at:
            found.append(word[best[at][1] : at])
            at = best[at][1]
        return [x for p in reversed(found) for x in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def decode_many(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        if not hasattr(self, "_bytes"):
            self._bytes = np.frombuffer(b"".join(self.text), np.uint8)
            self._size = np.array([len(t) for t in self.text], np.int64)
            self._at = np.cumsum(self._size) - self._size
        size = self._size[ids]
        ends = np.cumsum(size)
        return self._bytes[np.repeat(self._at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class MergeTable:
    """The pairs of symbols (pieces and single characters) that make a piece, for merging many words at a time."""

    def __init__(self, pieces: Pieces) -> None:
        symbols = {s: i for i, s in enumerate(dict.fromkeys([*pieces.ids, *(c for p in pieces.ids for c in p)]))}
        self.symbols, self.pieces = symbols, pieces
        pairs = [(symbols[p[:k]] << 32 | symbols[p[k:]], symbols[p]) for p in pieces.ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, made = (np.array([x[i] for x in pairs], np.int64) for i in (0, 1))
        # open addressing: a pair lies in the first free slot from its hash on
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.key, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.key[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[first]], self.made[slot[first]] = keys[left[first]], made[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.score = np.array([pieces.score.get(s, -np.inf) for s in symbols])
        self.id = np.array([pieces.ids.get(s, -1) for s in symbols], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes; -1: none."""
        keys = a.astype(np.int64) << 32 | b
        found, live, slot = np.full(len(keys), -1, np.int32), np.flatnonzero((a >= 0) & (b >= 0)), None
        slot = self._slot(keys[live])
        while len(live):
            held = self.key[slot]
            hit = held == keys[live]
            found[live[hit]] = self.made[slot[hit]]
            on = ~hit & (held >= 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found

    def encode(self, words: list[str]) -> list[bytes]:
        """One merge in each word a pass: the pair of the best score, the leftmost of equals."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, at = np.unique(code, return_inverse=True)
        symbol = np.array([self.symbols.get(chr(c), -1 - i) for i, c in enumerate(kinds.tolist())], np.int64)[at]  # below 0: no symbol
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.r_[word[1:] != word[:-1], True]
        made = np.r_[self.merged(symbol[:-1], symbol[1:]), -1].astype(np.int64)
        made[last] = -1
        while len(symbol):
            score = np.where(made >= 0, self.score[made], -np.inf)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.maximum.reduceat(score, starts)
            of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            live = (best > -np.inf)[of]
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, made, score, of = symbol[live], word[live], made[live], score[live], of[live]
                if not len(symbol):
                    break
            here = np.flatnonzero(score == best[of])
            here = here[np.r_[True, word[here][1:] != word[here][:-1]]]
            symbol[here] = made[here]
            stay = np.ones(len(symbol), bool)
            stay[here + 1] = False
            at = here - np.arange(len(here))  # where they stand when the merged-away are gone
            symbol, word, made = symbol[stay], word[stay], made[stay]
            change = np.r_[at, at[at > 0] - 1]
            nxt = np.minimum(change + 1, len(symbol) - 1)
            new = self.merged(symbol[change], symbol[nxt])
            made[change] = np.where((word[nxt] == word[change]) & (nxt > change), new, -1)
        word, symbol = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        ids = np.where(symbol >= 0, self.id[symbol], -1).astype("<i4")
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
        spelt = None
        for w in np.unique(word[ids < 0]).tolist():  # words with characters that no piece has
            spelt = spelt or list(self.symbols)
            chars = [chr(kinds[-1 - x]) if x < 0 else spelt[x] for x in symbol[cuts[w] : cuts[w + 1]].tolist()]
            out[w] = np.array([y for c in chars for y in ([self.pieces.ids[c]] if c in self.pieces.ids else self.pieces.fallback(c))], "<i4").tobytes()
        return out


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def keys(text: str) -> list[str]:
    """What stands between a text's spaces; a line break begins a key.  Their words, in order, are those of the text."""
    if "  " in text or SPACE in text or text[:1] == " ":
        return [" " + w for w in words(text)]
    return text.replace("\n", " \n").split(" ") if text else []


def key_words(key: str) -> list[str]:
    """The words of a key of ``keys``: a space stands before it, or a line break, or (from the slow way) it is a word."""
    if key[:1] == " ":
        return [key[1:]]
    return [SPACE + key] if key[:1] != "\n" else ["\n", key[1:]] if len(key) > 1 else ["\n"]


def words(text: str) -> list[str]:
    """The words of a text with its dummy prefix; joined they are the text with spaces marked."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame(pieces.rows, "id int, piece string, score double")


def lattice(word_rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges array<struct<start, stop, id, score>>) of a table of distinct words; words without a piece have none."""
    table = F.broadcast(piece_table(word_rows.sparkSession, pieces))  # as large as the vocabulary
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(s + 1, F.least(s + F.lit(pieces.longest), n)), lambda e: F.struct(s.alias("start"), e.alias("stop")))))
    subs = word_rows.where("length(word) > 0").select("word", F.explode(spans).alias("e")).select("word", "e.start", "e.stop", F.expr("substring(word, e.start + 1, e.stop - e.start)").alias("piece"))
    edges = subs.join(table, "piece").groupBy("word").agg(F.collect_list(F.struct("start", "stop", "id", "score")).alias("edges"))
    return word_rows.select("word").join(edges, "word", "left").withColumn("edges", F.coalesce("edges", F.expr("array()").cast("array<struct<start:int,stop:int,id:int,score:double>>")))


def fold_merges(word: str = "word", edges: str = "edges") -> Column:
    """Places where the pieces of a BPE word begin and end: merges by best score, leftmost first."""
    return F.expr(f"""
      aggregate(sequence(1, greatest(length({word}), 1)), sequence(0, length({word})), (cuts, step) -> coalesce(
        element_at(transform(
          array(array_max(transform(
            filter({edges}, e -> array_contains(cuts, e.start) and array_contains(cuts, e.stop) and size(filter(cuts, c -> c > e.start and c < e.stop)) = 1),
            e -> named_struct('score', e.score, 'left', -e.start, 'stop', e.stop)))),
          best -> if(best is null, cuts, filter(cuts, c -> c <= -best.left or c >= best.stop))), 1), cuts))""")


def fold_viterbi(word: str = "word", edges: str = "edges", unknown: float = -1e6) -> Column:
    """Places where the pieces of the path of the best score sum begin and end."""
    return F.expr(f"""
      aggregate(sequence(1, greatest(length({word}), 1)), array(named_struct('score', 0D, 'cuts', array(0))), (best, at) ->
        if(at > length({word}), best, concat(best, array(array_max(concat(
          transform(filter({edges}, e -> e.stop = at), e -> named_struct('score', best[e.start].score + e.score, 'cuts', concat(best[e.start].cuts, array(at)))),
          if(exists({edges}, e -> e.start = at - 1 and e.stop = at), cast(array() as array<struct<score:double,cuts:array<int>>>), array(named_struct('score', best[at - 1].score + {unknown}D, 'cuts', concat(best[at - 1].cuts, array(at)))))))))),
        best -> element_at(best, -1).cuts)""")


def encode_words(word_rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids array<int>) of a table of distinct words, by relational operators only; a character without a piece is null."""
    found = lattice(word_rows, pieces).withColumn("cuts", fold_viterbi() if pieces.kind == UNIGRAM else fold_merges())
    return found.select("word", F.when(F.size("cuts") > 1, F.expr("transform(sequence(1, size(cuts) - 1), i -> get(transform(filter(edges, e -> e.start = cuts[i - 1] and e.stop = cuts[i]), e -> e.id), 0))")).otherwise(F.expr("array()").cast("array<int>")).alias("ids"), "cuts")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of at most LATTICE_CHARS characters with its number in all texts."""

    def report(counts: Counter) -> pa.RecordBatch:
        of_words: Counter = Counter()
        for key, n in counts.items():
            for w in key_words(key):
                if len(w) <= LATTICE_CHARS:
                    of_words[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(of_words), pa.string()), pa.array(list(of_words.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, BATCH_BYTES):
            for text in batch.column(1).to_pylist():
                counts.update(keys(text or ""))
            if len(counts) > COUNTED_WORDS:
                yield report(counts)
                counts.clear()
        yield report(counts)
        pa.default_memory_pool().release_unused()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON) -> DataFrame:
    """(word): the most frequent words, at most ``most``: all that occur more often than the least number that so few words exceed."""
    counted = stored(word_counts(docs).where("n > 1"))
    by_number = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, total = None, 0
    for r in by_number.limit(most).collect():  # distinct numbers, from the largest on
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return counted.where(F.col("n") >= (least or 1 << 62)).select("word")


class Lexicon(dict):
    """Encoded keys of texts; a worker keeps them from task to task, within a bound."""

    def __init__(self, pieces: Pieces, table: dict[str, bytes]) -> None:
        super().__init__()
        self.pieces, self.table = pieces, table
        self.start()

    def start(self) -> None:
        self.clear()
        self.update((w[1:], ids) for w, ids in self.table.items() if w[:1] == SPACE and w[1:2] not in (SPACE, " "))

    def learn(self, wanted: set[str]) -> None:
        """Encode the keys that are not known yet."""
        if len(self) > len(self.table) + MOST_WORDS:
            self.start()
        new = wanted.difference(self)
        plain = [k for k in new if k[:1] != "\n" and k[:1] != " "]
        self.update(zip(plain, self.pieces.encode_many([SPACE + k for k in plain])))
        if len(plain) < len(new):
            others = [(k, key_words(k)) for k in new if k[:1] == "\n" or k[:1] == " "]
            missing = list({w for _, ws in others for w in ws if w not in self.table})
            found = self.table | dict(zip(missing, self.pieces.encode_many(missing)))
            self.update((k, b"".join([found[w] for w in ws])) for k, ws in others)


_LEXICONS: dict[str, Lexicon] = {}


def lexicon_of(vocabulary: str, table: dict[str, bytes]) -> Lexicon:
    if vocabulary not in _LEXICONS:
        _LEXICONS[vocabulary] = Lexicon(pieces_of(vocabulary), table)
    return _LEXICONS[vocabulary]


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = LEXICON) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_pieces, ids array<int>, ids_sha256, decoded string, round_trip.

    ids are those of the library for the model at ``vocabulary`` (a path that every executor has), without begin or
    end.  decoded is read back from the ids; round_trip tells whether it is the text (a text that has the space
    mark itself comes back with spaces).  Null and empty texts have no pieces.  Each row is encoded by itself, also rows
    that repeat a doc_id or have none.
    """
    pieces = pieces_of(vocabulary)
    frequent = frequent_words(docs, lexicon_words).repartition(WORD_TASKS, "word")
    rows = encode_words(frequent, pieces).collect()  # at most lexicon_words
    table = {}
    for r in rows:
        ids = [x for i, (a, p) in enumerate(zip(r["cuts"], r["ids"])) for x in ([p] if p is not None else pieces.fallback(r["word"][a : r["cuts"][i + 1]]))]
        table[r["word"]] = np.array(ids, "<i4").tobytes()
    known = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pieces_of(vocabulary)
        lexicon = lexicon_of(vocabulary, known.value)
        for batch in slices(batches, BATCH_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [keys(t) for t in texts]
            gc.disable()  # many small objects, none of them in cycles
            lexicon.learn(set().union(*parts))
            blobs = [b"".join(map(lexicon.__getitem__, p)) for p in parts]
            raw = utf8(batch.column(1))
            decoded = [t if mine.decode_many(np.frombuffer(b, "<i4"))[1:] == r else mine.decode(np.frombuffer(b, "<i4").tolist()) for t, r, b in zip(texts, raw, blobs)]
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int32)
            gc.enable()
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), ids,
                    pa.array([hashlib.sha256(b).hexdigest() for b in blobs]), pa.array(decoded, pa.string()), pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_pieces", "ids", "ids_sha256", "decoded", "round_trip"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids array<int>, ids_sha256 string, decoded string, round_trip boolean")
