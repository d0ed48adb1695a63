"""Sharding by extendible hashing.

A row's hash picks its bucket by as many leading bits as the directory has there. Only a bucket over its byte limit is
split, on the next bit, until every one fits: a row's bucket is its shortest prefix whose bytes fit. Byte counts are
summed for fine prefixes first, and those of shorter ones are made from these, so the rows are summed once; only rows
whose fine prefix is still too large are looked at again, bit by bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, written

#: Bits of the hash that the directory can use; rows that share them all go on in numbered overflow pages.
BITS = 40
#: The first sums are for prefixes so many bits longer than evenly filled buckets need.
FINE = 10
SHARD_BYTES = 64 << 20
#: The limit of the registered query: the given tables exceed it many times over, so that buckets do split.
QUERY_SHARD_BYTES = 64 << 10
#: Directories of so many entries at most (40 bytes each) are broadcast; beyond, rows are shuffled by their leading bits.
MOST_BROADCAST = 500_000


def hash_bits(key: str | Column) -> Column:
    """The BITS leading bits of a key's MD5, a number that other systems can compute too."""
    return F.conv(F.substring(F.md5(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftright", F.col("hash"), (F.lit(BITS) - depth).cast("int"))


def _sums(rows: DataFrame, least: int, most: int) -> DataFrame:
    """n_bytes below each prefix of least to most bits: depth, prefix, n_bytes. rows: hash, bytes."""
    every = rows.select(F.explode(F.sequence(F.lit(least), F.lit(most))).alias("depth"), "hash", "bytes")
    return every.groupBy("depth", _prefix(F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("n_bytes"))


def _leaves(rows: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """The shortest prefixes of least to most bits that fit, where that of one bit less doesn't: depth, prefix."""
    sums = _sums(rows, least, most)
    parent = sums.where(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    fits = sums.where(F.col("n_bytes") <= limit).withColumn("above", F.shiftright("prefix", 1))
    return fits.where(F.col("depth") == least).select("depth", "prefix").unionByName(fits.join(parent, ["depth", "above"]).select("depth", "prefix"))


def _looked_up(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows (__hash) with depth and prefix of the one entry that they lie below: that of their bits as far as the
    shortest entry goes whose range holds the hash. Texts stay where they are, unless the directory is too large."""
    least, n = directory.agg(F.min("depth"), F.count("*")).first()
    at = (F.lit(BITS) - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", F.col("prefix"), at)
    entries = directory.select("depth", "prefix", first.alias("__first"), F.call_function("shiftleft", F.col("prefix") + 1, at).alias("__end"))
    entries = entries.withColumn("__root", F.shiftright("__first", BITS - (least or 0)))
    below = (F.shiftright("__hash", BITS - (least or 0)) == F.col("__root")) & (F.col("__hash") >= F.col("__first")) & (F.col("__hash") < F.col("__end"))
    return rows.join(F.broadcast(entries) if n <= MOST_BROADCAST else entries, below).drop("__first", "__end", "__root")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the shard of each row: all columns of docs, then n_bytes (of the text; null: 0), depth, prefix, page
    and shard ("<depth>:<prefix>:<page>", or "big:<hash>:<page>").

    No shard exceeds `limit` bytes, except that a text longer than the limit is a shard of its own (pages number those of
    one key). Rows that share
    all BITS bits (equal keys) and don't fit one shard are dealt to numbered pages, in halves of the limit. A null key
    hashes like ''. Columns of docs that have the names of the added ones are replaced. No rows: no shards.
    """
    own = ["n_bytes", "depth", "prefix", "page", "shard"]
    kept = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(*kept, F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("__bytes"), hash_bits(key).alias("__hash"))
    narrow = written(rows.where(F.col("__bytes") <= limit).groupBy(F.col("__hash").alias("hash")).agg(F.sum("__bytes").alias("bytes")), "hashes")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINE)
    at_fine = narrow.groupBy(_prefix(F.lit(fine)).alias("p")).agg(F.sum("bytes").alias("bytes"))
    first = at_fine.select(F.shiftleft("p", BITS - fine).alias("hash"), "bytes")
    leaves = _leaves(first, 0, fine, limit)
    if fine < BITS:
        heavy = at_fine.where(F.col("bytes") > limit).select("p")
        rest = narrow.withColumn("p", _prefix(F.lit(fine))).join(heavy, "p", "left_semi").select("hash", "bytes")
        leaves = leaves.unionByName(_leaves(rest, fine, BITS, limit).where(F.col("depth") > fine))
    leaves = written(leaves, "directory")
    crowded = narrow.where(F.col("bytes") > limit).select(F.col("hash").alias("__hash"), F.lit(BITS).alias("depth"), F.col("hash").alias("prefix"))
    many = not crowded.isEmpty()
    directory = leaves.unionByName(crowded.select("depth", "prefix")) if many else leaves
    big = F.col("__bytes") > limit
    fits = _looked_up(rows.where(~big), directory)
    paged = fits.withColumn("page", F.lit(0).cast("long"))
    if many:
        paged = _pages(fits.join(crowded.select("__hash"), "__hash", "left_anti").withColumn("page", F.lit(0)), fits.join(crowded.select("__hash"), "__hash", "left_semi"), limit)
    name = F.concat_ws(":", "depth", "prefix", "page")
    out = paged.select(*kept, F.col("__bytes").alias("n_bytes"), "depth", "prefix", "page", name.alias("shard"))
    alone = rows.where(big)
    if alone.isEmpty():
        return out
    counted = alone.withColumns({"__row": F.monotonically_increasing_id(), "__one": F.lit(1)})
    numbered = running(counted, ["__hash", "__row"], "__one", "number", ("__hash",)).withColumn("number", F.col("number") - 1)
    return out.unionByName(numbered.select(*kept, F.col("__bytes").alias("n_bytes"), F.lit(BITS).alias("depth"), F.col("__hash").alias("prefix"), F.col("number").alias("page"), F.concat_ws(":", F.lit("big"), "__hash", "number").alias("shard")))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, written once, with a number that tells rows of equal hash apart."""
    return written(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")


def _pages(plain: DataFrame, crowded: DataFrame, limit: int) -> DataFrame:
    """Rows of hashes that no bit can split, dealt to pages by their running bytes. The running sum has two levels
    (the parts the rows are written in, then the rows of a part), so no task sees all rows of a hash."""
    at = _numbered(crowded.withColumn("part", F.spark_partition_id()))
    per_part = at.groupBy("__hash", "part").agg(F.sum("__bytes").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("__hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = F.coalesce(F.sum("__bytes").over(Window.partitionBy("__hash", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = max(1, limit // 2)
    small = at.where(F.col("__bytes") <= half).join(per_part.select("__hash", "part", before.alias("before")), ["__hash", "part"])
    dealt = small.withColumn("page", (2 * F.floor((F.col("before") + running) / half)).cast("long"))
    large = at.where(F.col("__bytes") > half).withColumn("page", 2 * F.col("number") + 1)
    columns = [c for c in plain.columns]
    return plain.withColumn("page", F.col("page").cast("long")).unionByName(dealt.select(columns)).unionByName(large.select(columns))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, with one file in it."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
