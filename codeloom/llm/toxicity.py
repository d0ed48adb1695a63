"""Toxicity by multiple-instance learning.

Labels are of documents, the cause is in single sentences. Each sentence has a logistic score over its hashed words; a
document's score is the noisy-or of its sentences', 1 - prod(1 - p). The likelihood of the document labels is followed
down to the sentences, so the fitted model also tells which sentences offend.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw

BUCKETS = 1 << 18
#: Bounds of the labelled sample that the model is fitted on, in documents and in bytes of text on the driver.
MAX_LABELLED, MAX_LABELLED_BYTES = 6_000, 32 << 20
#: Of the fit: steps, step width, L1 penalty, first bias; the least number of documents that a feature stands in; the
#: most features.
ROUNDS, RATE, PENALTY, START, LEAST_DOCS, MOST_FEATURES = 120, 0.1, 1.5e-4, -6.0, 3, 3000
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
SENTENCE = re.compile(rb"[^.!?\n]+")
WORD = re.compile(rb"[0-9a-z_'\x80-\xff]+")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Features(dict):
    """The buckets of a word: the word itself, and its first PREFIXES bytes, which words of one stem share."""

    BOUND = 300_000

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.BOUND:
            self.clear()
        parts = [b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
        found = self[word] = [xxhash.xxh64_intdigest(x) % self.buckets for x in parts]
        return found


class Scores(dict):
    """The score of a word: the sum of its features' weights."""

    BOUND = 300_000

    def __init__(self, weights: np.ndarray):
        self.weights, self.features = weights, Features(len(weights))

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.BOUND:
            self.clear()
        found = self[word] = float(self.weights[self.features[word]].sum())
        return found


def sentences(text: bytes) -> tuple[list[bytes], np.ndarray, list[tuple[int, int]]]:
    """The words of a whole text, where each sentence's begin, and the sentences' byte ranges. Sentences without words
    are left out."""
    words, starts, ranges = [], [], []
    for m in SENTENCE.finditer(text):
        found = WORD.findall(m[0].lower())
        if found:
            starts.append(len(words))
            ranges.append(m.span())
            words += found
    return words, np.array(starts, np.int64), ranges


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> pa.Table:
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # A doc_id may have any number of rows and a text any length: the sample is bounded in both, by hash.
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id")]
    rows = rows.withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("n") <= MAX_LABELLED_BYTES).orderBy(*order).limit(2 * max_labelled)
    running = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sum", running).where(F.col("sum") <= MAX_LABELLED_BYTES).select("text", "label").toArrow()


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias. labels (doc_id, label 0 to 1): at most max_labelled of them are used, those whose
    ids have the least hashes, and of these documents, by hash, as many as MAX_LABELLED_BYTES of text allow."""
    got = _sample(docs, labels, max_labelled)
    return fit_sample(raw(got["text"]), np.array(got["label"].to_pylist(), float), buckets)


def fit_sample(texts: list[bytes | None], truth: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """fit() on texts and their labels: proximal Adam on the noisy-or likelihood, with an L1 penalty."""
    of, in_docs, in_toxic = Features(buckets), np.zeros(buckets), np.zeros(buckets)
    weights = np.zeros(buckets, np.float32)
    for text, y in zip(texts, truth):
        have = list({f for w in set(WORD.findall((text or b"").lower())) for f in of[w]})
        in_docs[have] += 1
        in_toxic[have] += y
    # Features are screened by documents: those of few say nothing about others, and of the rest the MOST_FEATURES that
    # the labels depend on most are fitted.
    apart = np.where(in_docs >= LEAST_DOCS, np.abs(in_toxic - in_docs * (truth.mean() if len(truth) else 0)) / np.sqrt(in_docs + 1), -1)
    order = np.argsort(-apart, kind="stable")[:MOST_FEATURES]
    chosen = set(order[apart[order] >= 0].tolist())
    feature_of, sentence_of, doc_of, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, text in enumerate(texts):
        words, starts, ranges = sentences(text or b"")
        per_word = [[f for f in of[w] if f in chosen] for w in words]
        feature_of.append(np.fromiter(itertools.chain.from_iterable(per_word), np.int64))
        counts = np.fromiter(map(len, per_word), np.int64, len(words))
        sentence_of.append(np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)])), counts) + n)
        doc_of.append(np.full(len(ranges), i))
        n += len(ranges)
    if not n:
        return weights, START
    feature, sentence, doc = map(np.concatenate, (feature_of, sentence_of, doc_of))
    pairs, times = np.unique(sentence * buckets + feature, return_counts=True)
    sentence, (used, column) = pairs // buckets, np.unique(pairs % buckets, return_inverse=True)
    w, b = np.zeros(len(used)), START
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(sentence, w[column] * times, n) + b
        p = np.exp(-np.logaddexp(0, -z))
        q = np.exp(np.maximum(np.bincount(doc, -np.logaddexp(0, z), len(truth)), -500))  # prod(1 - p)
        pull = (1 - truth - truth * q / np.maximum(1 - q, 1e-9))[doc] * p / len(truth)
        gradient = np.r_[np.bincount(column, pull[sentence] * times, len(used)), pull.sum()]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        rate = RATE / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        moved = np.r_[w, b] - rate * mean / (1 - 0.9**step)
        w, b = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate[:-1] * PENALTY, 0), moved[-1]
    weights[used] = w
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, score, and offending: the sentences whose own
    score reaches the threshold (from, to: byte range in the text's UTF-8; score). A null or empty text scores 0."""

    def run(batches):
        of = Scores(weights)
        for batch in batches:
            scores, offending = [], []
            for text in raw(batch["text"]):
                words, starts, ranges = sentences(text or b"")
                z = np.add.reduceat(np.fromiter(map(of.__getitem__, words), np.float64, len(words)), starts) + bias if words else np.empty(0)
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                p = np.exp(-np.logaddexp(0, -z))
                offending.append([{"from": ranges[i][0], "to": ranges[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= threshold)])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(offending, kind)], ["doc_id", "score", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<from: bigint, to: bigint, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if the score reaches the threshold), offending.

    labels (doc_id, toxic 0 or 1; null: no label) are learned from only where held_out is false; a doc_id with several
    labels counts as their mean. Without labels the model is its start, a low score everywhere. A null doc_id is scored
    and isn't held out; repeated rows get equal scores; other columns are ignored, whatever their names.
    """
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out())
    scored = score(docs, *fit(docs, known), threshold)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
