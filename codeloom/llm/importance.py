"""Quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs, `buckets` hashes): one of the target texts, one of all
raw texts. A document's weight is the ratio of its likelihoods; documents are drawn without replacement, in proportion
to their weights, by adding Gumbel noise to the log weights and keeping the `k` largest.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, gram_hashes, raw, unit, written

BUCKETS = 1 << 14
#: Bound of the sample of target documents; the raw model is of all documents.
MAX_TARGET = 20_000
SEED = 20
BINS = 4096
_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+")


def grams(text: bytes, hasher: WordHasher, buckets: int) -> np.ndarray:
    """Bucket numbers of a text's words, marks and their pairs; whole text, A-Z in lower case."""
    words = hasher.of(_TOKEN.findall(text.lower()))
    return np.concatenate([words % np.uint64(buckets), gram_hashes(words, 2) % np.uint64(buckets)]).astype(np.int64)


def _counts(buckets: int):
    def run(batches):
        hasher, sums = WordHasher(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(raw(batch["text"]), batch["target"].to_pylist()):
                if text:
                    found = np.bincount(grams(text, hasher, buckets), minlength=buckets)
                    sums[0] += found
                    if target:
                        sums[1] += found
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "n_raw", "n_target"])

    return run


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> np.ndarray:
    """Log of target over raw probability, by bucket. target_ids (doc_id): at most max_target of them, those whose ids
    have the least hashes, are the target; the raw counts are of all docs."""
    chosen = target_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_counts(buckets), "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    sums = np.ones((2, buckets))  # at most `buckets` rows; one is added to each count
    for bucket, n_raw, n_target in counts.collect():
        sums[:, bucket] += n_raw, n_target
    p = np.log(sums) - np.log(sums.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, of (a hash of the text), n_grams, log_weight: the log of the ratio of the document's likelihoods."""
    buckets, ratio = len(ratio), ratio.astype(np.float64)

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            n, weight = [], []
            for text in raw(batch["text"]):
                found = grams(text or b"", hasher, buckets)
                n.append(len(found))
                weight.append(float(ratio[found].sum()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["of"], pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "of", "n_grams", "log_weight"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("of")).mapInArrow(run, "doc_id long, of long, n_grams long, log_weight double")


def gumbel(*columns):
    """Gumbel noise from a hash of the columns, the same in every run."""
    return -F.log(-F.log(unit(SEED, *columns)))


def _limit(rows: DataFrame, key: str, k: int) -> tuple | None:
    """The k + 1st largest key of rows, and how many keys are above it; None if there are no more than k rows.

    It is found by counting in ranges, and again within the range that holds it, so nothing is sorted and at most BINS
    counts come to the driver at a time.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= k:
        return None
    above = 0
    while low < high:
        place = (F.col(key).cast("double") - float(low)) / (float(high) - float(low)) * BINS
        within = rows.where(F.col(key).between(low, high)).groupBy(F.least(F.floor(place), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for x in sorted(within.collect(), key=lambda x: -x["bin"]):
            if above + x["n"] > k:
                low, high = x["low"], x["high"]
                break
            above += x["n"]
    return low, above


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("gumbel_key",)) -> DataFrame:
    """scored (a written table) with `kept`: whether a row is among the k largest by the keys, the second of which
    decides among equals of the first, and so on. Rows equal in all keys are kept or dropped together, so that exactly
    k are kept if the last key is unique. Whole numbers in keys must be below 2 ** 53."""
    kept, equal = F.lit(False), F.lit(True)
    for key in keys:
        found = _limit(scored.where(equal), key, k)
        if found is None:
            return scored.withColumn("kept", kept | equal)
        limit, above = found
        kept, equal, k = kept | (equal & (F.col(key) > limit)), equal & (F.col(key) == limit), k - above
    return scored.withColumn("kept", kept)


def resample(docs: DataFrame, target_ids: DataFrame, share: float, buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, of (xxhash64 of the text), n_grams,
    log_weight, gumbel_key, row (a number of its own), kept. The share of the rows, rounded, is kept, exactly.

    Weights are products over all n-grams of the whole text, so the longer a document, the surer its place. A null or
    empty text has weight 1 (log 0) and takes its chance. Repeated rows have equal keys; where these are at the limit, a
    hash of id and text and then the row's number decide. A null doc_id is a value like others. Without targets all
    weights are near 1. No rows: no result.
    """
    ratio = fit(docs, target_ids, buckets, max_target)
    noise = gumbel(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("of", F.lit(0)))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "doc_id", "of"), 11)
    scored = written(weigh(docs, ratio).withColumns({"gumbel_key": F.col("log_weight") + noise, "tie": tie, "row": F.monotonically_increasing_id()}), "weights")
    return top_k(scored, round(scored.count() * share), ("gumbel_key", "tie", "row")).drop("tie")


def target_share(labels: DataFrame) -> float:
    """The share of the labelled documents that are of the target's quality."""
    return labels.where("quality is not null").agg(F.coalesce(F.avg("quality"), F.lit(1.0))).first()[0]
