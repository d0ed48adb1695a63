"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are put in a random order, repeated up to `repeats` times over. A copy's virtual finish time
is the source's words up to and with it, divided by the source's target. Copies are range-sorted by finish time over
all partitions, which is the order they are served in: sources advance in proportion to their targets. The mix is
truncated where its total budget is used up.

All orders end in a row's own number and all running sums have two levels (sums of ranges, then rows within a range),
so a source with a third of all rows, or a row that is there very often, is spread over ranges like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, written

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 6


def sizes(text: str = "text"):
    """Words of a text: runs of characters other than ASCII white space. Null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def turn() -> F.Column:
    """A row's place in its source's random order: 60 bits of an MD5 of its id and text, which other systems have too."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target. sources (source, source_size) has a row for each source, null among them.

    Weights go by turns to the sources in order of code points, null last. A target stops at `repeats` times the
    source's size; what it can't use is shared out again by weight, until none is above. Only sums come to the driver.
    """
    placed = running(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = written(placed.select("source", "source_size", weight.alias("weight")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * float(repeats)
    level = 0.0  # words for each unit of weight
    while True:
        open_ = most > F.col("weight") * level  # grows no larger as the level rises
        weight, full = rows.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, most))).first()
        if not weight:
            break
        new = (total - (full or 0.0)) / weight
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Every row of docs with its place in its source's order: row (a number of its own), doc_id, of, source, size,
    source_size, target, through (words of the source up to and with it). A written table."""
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("of"), sizes().alias("size"), turn().alias("turn"))
    rows = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats).withColumnRenamed("source", "s")
    placed = running(rows, ["source", "turn", "doc_id", "of", "row"], "size", "through", ("source",))
    return written(placed.join(by_source, F.expr("source <=> s")).select("row", "doc_id", "of", "source", "size", "source_size", "target", "through"), "queue")


def served(queued: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix itself, a row for each copy that is served, in the order of `served` (words up to and with it): row,
    doc_id, of, source, epoch, finish, size, served. queued: a queue() of all documents, whose words are the budget."""
    budget = queued.agg(F.sum("size")).first()[0] or 0
    copies = queued.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    finish = F.try_divide(F.col("through") + F.col("epoch") * F.col("source_size"), F.col("target"))
    copies = copies.select("row", "doc_id", "of", "source", "epoch", finish.alias("finish"), "size")
    return running(copies, ["finish", "source", "doc_id", "of", "epoch", "row"], "size", "served").where(F.col("served") <= budget)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per row of docs (doc_id, text, source; other columns are ignored): doc_id, of (xxhash64 of the text), source,
    size, source_size, target (its source's), copies (0 to repeats) and taken (size times copies).

    The budget is the words of all documents. A null text has size 0; null is a source of its own; documents without
    words are never taken. Rows that repeat a row (same doc_id and text) are served one after the other, each in its
    own right. An empty table gives an empty mix.
    """
    queued = queue(docs, weights, repeats)
    copies = served(queued, repeats).groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    out = queued.join(copies, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("doc_id", "of", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
