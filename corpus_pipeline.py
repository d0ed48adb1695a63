"""From raw documents to a training mix, in five stages: quality, near duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, written as Parquet and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontamination, extendible_hashing, fair_mix, importance, jaccard_join
from codeloom.llm.common import table, written

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled as good: as large a share as is good among the labels."""
    labels = table(spark, sf_dir, "labels")
    kept = importance.resample(docs, labels.where("quality = 1"), importance.target_share(labels)).where("kept").select("doc_id", "of").distinct()
    kept = kept.toDF("__id", "__of")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__of"]), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least doc_id stays, and
    of those that share it the one with the least text. Of rows equal in doc_id and text one stays; rows without doc_id
    stay."""
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    of = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("one"), F.max(F.xxhash64("text")).alias("other"))
    if of.where("one <> other").isEmpty():
        found = jaccard_join.jaccard_components(docs, k=5, percent=80)
        stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
        kept = named.join(stays, F.col("doc_id") == F.col("__id"), "left_semi")
    else:  # each text is judged, under a number of its own
        named = written(named.withColumn("__n", F.monotonically_increasing_id()), "numbered")
        found = jaccard_join.jaccard_components(named.select(F.col("__n").alias("doc_id"), "text"), k=5, percent=80)
        groups = named.select("__n", "doc_id", "text").join(found.select(F.col("doc_id").alias("__n"), "component_id"), "__n").groupBy("component_id")
        stays = groups.agg(F.min_by("__n", F.struct("doc_id", "text")).alias("__n"))
        kept = named.join(stays, "__n", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten-word passage of a benchmark item go. Rows that share a doc_id, or have none, are told apart
    by their text."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select("doc_id", "of").distinct().toDF("__id", "__of")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__of"]), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the proportions of their weights: each document as often as the mix takes it, zero to three times."""
    taken = fair_mix.mix(docs).where("copies > 0").groupBy("doc_id", "of").agg(F.max("copies").alias("copies")).toDF("__id", "__of", "__copies")
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"]) & (F.xxhash64(docs["text"]) == taken["__of"]))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard that it is written to."""
    return extendible_hashing.shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mix", mixed), ("sharding", sharded)]

#: The quality stage is a fitted model; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
