"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its hashed words and word prefixes; the
document's is their noisy-or, 1 - prod(1 - p).  Only documents have labels; the gradient of the document's likelihood
reaches the sentences through the noisy-or, so the fitted model also tells which sentences offend.

Fitting is distributed: in each step every task adds up the gradient of its documents' likelihood, whole texts, into one
vector of fixed size; only these vectors reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import id_and_text, slices, stored, utf8

BUCKETS = 1 << 18
PREFIX_CHARS = (3, 4, 5)
#: Features of fewer training documents than this get no weight.
LEAST_DOCS = 8
#: The classifier is fitted on at most so many labelled documents of each class, taken by the hash of their id.
TRAIN_PER_CLASS = 1000
#: Tasks of a step of the fit; each sends one vector to the driver.
TASKS = 8
EPOCHS = 60
RATE = 0.15
DECAY = 1e-5
BATCH_BYTES = 4_000_000
FOLDS = 5
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[.!?\n]")
_ENDS = frozenset((b".", b"!", b"?", b"\n"))


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its prefixes."""
    chars = word.decode("utf-8", "ignore")
    return [xxh32_intdigest(word, 0) % BUCKETS, *(xxh32_intdigest(chars[:n].encode(), n) % BUCKETS for n in PREFIX_CHARS)]


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence that has any; sentences end at . ! ? and line ends."""
    found, now = [], []
    for t in _TOKEN.findall(text.decode("utf-8", "replace").lower().encode()):
        if t in _ENDS:
            if now:
                found.append(now)
                now = []
        else:
            now.append(t)
    return [*found, now] if now else found


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes, memo: dict) -> tuple[float, np.ndarray]:
        """The document's probability and its sentences'; a text without words has one empty sentence."""
        values = [memo[t] for t in _TOKEN.findall(text.decode("utf-8", "replace").lower().encode())]
        z = np.array([self.bias])
        if values:
            v = np.array(values)
            ends = np.isnan(v)
            group = np.cumsum(ends)
            words = ~ends
            count = np.bincount(group[words], minlength=group[-1] + 1)
            z = np.bincount(group[words], weights=v[words], minlength=group[-1] + 1)[count > 0] + self.bias
            if not len(z):
                z = np.array([self.bias])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p


class WordWeights(dict):
    """Sum of a word's weights, computed when first asked for; nan for what ends a sentence."""

    def __init__(self, weights: np.ndarray, most: int = 500_000) -> None:
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        if word in _ENDS:
            value = float("nan")
        else:
            value = float(self.weights[word_features(word)].sum())
        self[word] = value
        return value


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<int>, lengths array<int>): hashed features of all sentences, and how many each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES):
            features, lengths = [], []
            for text in utf8(batch.column(1)):
                found = sentences(text) or [[]]
                features.append(np.fromiter((x for s in found for w in s for x in word_features(w)), np.int32))
                lengths.append(np.array([(1 + len(PREFIX_CHARS)) * len(s) for s in found], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], ["doc_id", "features", "lengths"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, features array<int>, lengths array<int>")


def gradient(x: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """(loss, d loss / d w, d loss / d bias) of weighted bags: the negative log-likelihood of y under the noisy-or.

    x: the features of all sentences of all documents; per_sentence: how many each sentence has; per_doc: how many sentences.
    """
    of_sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    of_doc = np.repeat(np.arange(len(y)), per_doc)
    z = np.bincount(of_sentence, weights=w[x], minlength=len(per_sentence)) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.bincount(of_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
    some = np.maximum(-np.expm1(none), 1e-9)
    loss = float((weight * -np.where(y == 1, np.log(some), none)).sum())
    slope = np.where(y == 1, -np.exp(none) / some, 1.0) * weight  # d(loss)/dz of a sentence is this times p
    g = slope[of_doc] * p
    return loss, np.bincount(x, weights=g[of_sentence], minlength=len(w)), float(g.sum())


def _step(spark: SparkSession, rows: DataFrame, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """The gradient over all rows (features, lengths, y, weight): each task's vector, added up on the driver."""
    now = spark.sparkContext.broadcast((w, bias))  # at most BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = now.value
        gw, gb = np.zeros(len(w)), 0.0
        for batch in batches:
            if batch.num_rows:
                x, per_sentence = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                per_doc = np.diff(batch.column(1).offsets.to_numpy())
                _, a, b = gradient(x, per_sentence, per_doc, batch.column(2).to_numpy(), batch.column(3).to_numpy(), w, bias)
                gw, gb = gw + a, gb + b
        yield pa.RecordBatch.from_arrays([pa.array([gw.tobytes()], pa.binary()), pa.array([gb], pa.float64())], ["gw", "gb"])

    parts = rows.mapInArrow(run, "gw binary, gb double").collect()  # one row a task
    now.destroy()
    return sum((np.frombuffer(r["gw"]) for r in parts), np.zeros(len(w))), sum(r["gb"] for r in parts)


def fit(rows: DataFrame, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the noisy-or likelihood of weighted documents (features, lengths, y, weight).

    Features of fewer documents than LEAST_DOCS get no weight.
    """
    spark = rows.sparkSession
    counts = rows.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").count().where(F.col("count") >= LEAST_DOCS)
    known = np.sort(np.array([r["f"] for r in counts.select("f").collect()], np.int64))  # at most BUCKETS
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    shared = spark.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, lengths = [], []
            for f, n in zip(batch.column(0), batch.column(1)):
                x, n = shared.value[f.values.to_numpy()], n.values.to_numpy()
                kept = np.bincount(np.repeat(np.arange(len(n)), n)[x >= 0], minlength=len(n))
                features.append(x[x >= 0])
                lengths.append(kept.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), batch.column(2), batch.column(3)], ["features", "lengths", "y", "weight"])

    held = stored(rows.select("features", "lengths", "y", "weight").mapInArrow(run, "features array<int>, lengths array<int>, y int, weight double"))
    w, bias = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for t in range(1, epochs + 1):
        gw, gb = _step(spark, held, w, bias)
        gw = gw + DECAY * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        np.maximum(w, 0, out=w)  # words are evidence for toxicity or none, so that long sentences do not drown it
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[known] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, folds: int = FOLDS) -> Model:
    """Fit on labelled documents outside the held-out fold (crc32 of the id as text, modulo ``folds``, is 0).

    At most ``per_class`` documents of each class, the first by the hash of their id, with their whole texts; classes are
    weighted back to their shares among all labelled rows.  Labels without doc_id or toxic are left out; of repeated ones
    the highest counts.  Of rows that repeat a doc_id the first by the hash of the text is taken.  Without labels the
    model has no weights.
    """
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    truth = truth.where((F.crc32(F.col("doc_id").cast("string")) % folds != 0) & F.col("toxic").isin(0, 1))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = truth.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(truth.where("toxic = 0").orderBy(*order).limit(per_class))
    chosen = id_and_text(docs).join(F.broadcast(picked), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text", "toxic").alias("row"))
    texts = chosen.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.text", "row.toxic")
    bagged = stored(bags(texts).join(picked, "doc_id").repartition(TASKS, "doc_id").sortWithinPartitions("doc_id"))
    shares = truth.groupBy("toxic").agg(F.count("*").alias("labelled")).join(bagged.groupBy("toxic").agg(F.count("*").alias("taken")), "toxic").collect()  # two rows
    if not shares:
        return Model(np.zeros(BUCKETS), -6.0)
    total = sum(r["labelled"] for r in shares)
    weight = F.create_map(*[F.lit(x) for r in shares for x in (r["toxic"], r["labelled"] / r["taken"] / total)])[F.col("toxic")]
    return fit(bagged.select("features", "lengths", F.col("toxic").alias("y"), weight.alias("weight")))


def score_documents(docs: DataFrame, model: Model, locate_from: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, offending array<struct<sentence, start, end, p>>), one row for each row of ``docs``.

    offending: the sentences with a probability of ``locate_from`` or more, with their byte span in the lower-cased
    UTF-8 text.  Null and empty texts are scored as one sentence without words.  Each row is scored by its own text, also
    rows that repeat a doc_id or have none.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights.value
        fitted, memo = Model(w, bias), WordWeights(w)
        spans = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in slices(batches, BATCH_BYTES):
            scores, counts, offending = [], [], []
            for text in utf8(batch.column(1)):
                score, p = fitted.score(text, memo)
                scores.append(score)
                counts.append(len(p))
                bad = np.flatnonzero(p >= locate_from)
                offending.append([] if not len(bad) else _spans(text, set(bad.tolist()), p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(offending, spans)], ["doc_id", "score", "n_sentences", "offending"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<sentence: int, start: bigint, end: bigint, p: double>>")


def _spans(text: bytes, bad: set[int], p: np.ndarray) -> list[dict]:
    found, start, end, k = [], None, 0, 0
    for m in _TOKEN.finditer(text.decode("utf-8", "replace").lower().encode() + b"\n"):
        if m[0] in _ENDS:
            if start is not None:
                if k in bad:
                    found.append({"sentence": k, "start": start, "end": end, "p": float(p[k])})
                k, start = k + 1, None
        else:
            start, end = (m.start() if start is None else start), m.end()
    return found
