"""Token counts by a compiled finite-state transducer.

Byte-pair encoding is stable under prefixes: the encoding of a longer prefix of a word ends in exactly one token t
whose predecessor is the last token of the prefix before t, and t follows a token u only if u + t encodes to (u, t).
So a deterministic transducer can read a word symbol by symbol.  Its state holds the vocabulary-trie nodes of the
suffixes that may still grow into a token, with the last token and the token count, relative to now, where each
suffix begins; each transition is annotated with the number of tokens it adds (it may be negative, as a longer token
swallows earlier ones).  States and transitions are determinised when first met, within a bound.

Long texts are cut anywhere into chunks.  What a chunk does to any entry state is a map (head, n, tail): white space
puts every entry state into the same state, so only the symbols before the first and after the last white space
depend on neighbours, and stand for what they do to an entry state that is not known yet.  Maps compose associatively;
as only the whole text's map is wanted, of a parallel prefix scan the up-sweep is enough: neighbours are composed in
pairs, round by round, so memory stays linear in the text, also where it has no white space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

CHUNK_CHARS = 65536
#: Bounds of what a worker keeps: transitions of the transducer, words with known counts.
MOST_TRANSITIONS = 700_000
MOST_WORDS = 300_000
_SPACE = regex.compile(r"[ \n\t]")


class Merges:
    """The vocabulary of a byte-level BPE file with word-end suffix, as bytes.

    A symbol is a byte, or a byte that ends the word (byte + 256).
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("not a BPE vocabulary with word ends")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        to_byte = _byte_of_char()

        def symbols(token: str) -> tuple[int, ...]:
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            raw = [to_byte[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return (*raw[:-1], raw[-1] + 256 * ends)

        self.tokens = {}
        for token in model["vocab"]:
            if token not in self.special:
                self.tokens.setdefault(symbols(token), len(self.tokens))
        self.spelt = list(self.tokens)
        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = symbols(a), symbols(b)
            if self.suffix and a.endswith(self.suffix) and a != self.suffix:
                continue  # nothing follows a word end
            self.rank[self.tokens[x], self.tokens[y]] = (i, self.tokens[x + y])

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Encoding by repeatedly merging the first pair of best rank."""
        now = [self.tokens[(s,)] for s in symbols]
        while len(now) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(now, now[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            now[i : i + 2] = [self.rank[now[i], now[i + 1]][1]]
        return now


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of words; compiled on demand."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for spelt, token in merges.tokens.items():
            node = 0
            for s in spelt:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.made = 0

    def follows(self, u: int, t: int) -> bool:
        known = self.fits.get((u, t))
        if known is None:
            if len(self.fits) > MOST_TRANSITIONS:
                self.fits.clear()
            spelt = self.merges.spelt
            known = self.fits[u, t] = self.merges.encode(spelt[t] if u < 0 else spelt[u] + spelt[t]) == ([t] if u < 0 else [u, t])
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition from ``state`` on ``symbol``: (next state, tokens added)."""
        grown = [(node, last, n) for at, last, n in self.states[state] if (node := self.child[at].get(symbol)) is not None]
        last, added = next((self.token[node], n + 1) for node, last, n in grown if self.token[node] >= 0 and self.follows(last, self.token[node]))
        if symbol >= 256:
            nxt = -1
        else:
            new = (*((node, u, n - added) for node, u, n in grown if self.child[node]), (0, last, 0))
            nxt = self.number.get(new)
            if nxt is None:
                nxt = self.number[new] = len(self.states)
                self.states.append(new)
                self.steps.append({})
        self.steps[state][symbol] = (nxt, added)
        self.made += 1
        return nxt, added

    def count(self, word: bytes) -> int:
        if self.made > MOST_TRANSITIONS:
            self.reset()
        state, n, steps = 0, 0, self.steps
        end = 256 if self.merges.suffix else 0
        for s in word[:-1]:
            step = steps[state].get(s) or self.compile(state, s)
            state = step[0]
            n += step[1]
        s = word[-1] + end
        return n + (steps[state].get(s) or self.compile(state, s))[1]


class Counter(dict):
    """Token counts of texts; as a dict, of words (bounded)."""

    def __init__(self, path: str) -> None:
        merges = Merges(path)
        self.transducer = Transducer(merges)
        self.words = regex.compile(merges.pattern)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(word.encode())
        return n

    def count(self, text: str) -> int:
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased by itself, not as the last of a word
        return sum(map(self.__getitem__, self.words.findall(text.lower())))

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, n, tail) of a chunk; tail None: no white space, the head is the whole chunk."""
        first = _SPACE.search(text)
        if first is None:
            return text, 0, None
        cut = max(text.rfind(" "), text.rfind("\n"), text.rfind("\t"))
        return text[: first.start()], self.count(text[first.start() : cut]), text[cut:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of chunk a followed by chunk b."""
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2])

    def combine(self, maps: list[tuple]) -> tuple:
        """The map of all chunks: the up-sweep of a prefix scan, log2(len(maps)) rounds of independent compositions."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, m: tuple) -> int:
        return self.count(m[0]) + m[1] + (self.count(m[2]) if m[2] else 0)


@cache
def counter(path: str) -> Counter:
    """One for each worker and vocabulary."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each row of ``docs``.

    ``vocabulary``: path of the tokenizer's .json, which every executor has.  Counts are without added special
    tokens; special strings inside a text count as one token each, as the library does by default.  Null is empty.
    Every chunk of a text is mapped by itself; only the small maps are shuffled, to be composed by row.  Each row is counted
    by its own text, also rows that repeat a doc_id or have none.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            found = [c.chunk_map(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len((t or "").encode()) for t in batch.column(3).to_pylist()], pa.int64()), pa.array([m[0] for m in found], pa.string()), pa.array([m[1] for m in found], pa.int64()), pa.array([m[2] for m in found], pa.string())],
                ["row", "doc_id", "chunk", "bytes", "head", "n", "tail"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            totals = [c.total(c.combine([(m["head"], m["n"], m["tail"]) for m in ms])) for ms in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    chunks = (
        id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))).alias("chunk", "piece"))
        .mapInArrow(maps, "row long, doc_id long, chunk int, bytes long, head string, n long, tail string")
    )
    by_doc = chunks.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk", "head", "n", "tail"))).alias("maps"),
    )
    return by_doc.select("doc_id", "n_bytes", "maps").mapInArrow(join, "doc_id long, n_bytes long, n_tokens long")
