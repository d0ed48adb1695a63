"""What the operators of this subpackage share: reading tables, cutting lineage, hashing words."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import own_path, shared_dir, written  # noqa: F401

#: Multipliers of the polynomial hashes; any odd numbers do.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A key of more than one in so many rows is hot, and so is one of more rows than a task should have.
HOT_SHARE, HOT_ROWS = 1000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """big joined with small on keys. A key has one row of small, whose `count` tells how many rows of big have it.

    Keys of more than a HOT_SHARE-th of all rows, or of more than HOT_ROWS rows, are broadcast, so the rows of a key,
    however many, stay in the tasks that they are in; of the first there are fewer than HOT_SHARE, of the second fewer
    than rows / HOT_ROWS (50,000 of 10^11 rows). All others are shuffled, so big and small are read twice. A small of no
    more than HOT_SHARE rows is broadcast whole.
    """
    total, rows = small.agg(F.sum(count), F.count("*")).first()
    if rows <= HOT_SHARE:
        return big.join(F.broadcast(small), keys)
    is_hot = (F.col(count) * HOT_SHARE > (total or 0)) | (F.col(count) > HOT_ROWS)
    hot = F.broadcast(small.where(is_hot))
    cold = big.join(hot.select(*keys), keys, "left_anti").join(small.where(~is_hot), keys)
    return big.join(hot, keys).unionByName(cold)


def running(rows: DataFrame, order: list[str | Column], column: str, out: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """rows with `out`: the sum of a column over a row and all that come before it by `order`, or, with groups, all of
    its group (order then begins with these).

    Rows are range-sorted over all partitions and written; sums have two levels, of partitions and then of the rows in
    one. order ends in something unique, so no range is much larger than another, however many rows are alike.
    """
    ranges = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*groups, "__part").agg(F.sum(column).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(column).over(Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.col("__part") == F.col("__p"))
    return ranges.withColumn("__within", within).join(sums, same).select(*rows.columns, (F.col("__before") + F.col("__within")).alias(out))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shard_count(df: DataFrame, column: str, bytes_each: int) -> int:
    """So many shards that each holds about bytes_each of the column; at least as many as a shuffle has partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-text_bytes(df, column) // bytes_each))


def unit(seed: int, *columns: str | Column) -> Column:
    """A number in (0, 1) from a hash of the columns: random, but the same in every run and every retry."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + 0.5) / float(1 << 53)


class WordHasher(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """A hash of every k consecutive entries, by doubling: log k passes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, at, block, width = np.zeros(n, np.uint64), 0, words, 1
    while True:
        if k & width:
            total += block[at : at + n] * np.uint64(pow(base, at, 1 << 64))
            at += width
        if width * 2 > k:
            return mixed(total)
        block = block[:-width] + block[width:] * np.uint64(pow(base, width, 1 << 64))
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive entries."""
    n, width = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x[:n] if width == w else np.minimum(x[:n], x[w - width : w - width + n])


def found_in(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether the sorted array has it, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def u64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)
