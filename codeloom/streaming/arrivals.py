"""Source files as a stream: a table of (path, source) rows that grows, scanned as rows arrive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.detectors import DETECTORS, PROJECT, facts_for


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, names: list[str] | None = None):
    """Starts a query that adds to `out` (Parquet, by batch) the findings of every Parquet file of (path, source) put into
    folder. A batch that is tried again replaces what it wrote. Detectors of single files only: those of whole projects
    need all files at hand."""
    chosen = [n for n in (names or DETECTORS) if n not in PROJECT]
    stream = spark.readStream.schema("path string, source string").parquet(folder)

    def scan(batch: DataFrame, number: int) -> None:
        facts = facts_for(batch, chosen)
        facts.nested.persist()
        found = reduce(DataFrame.unionByName, [DETECTORS[name](facts) for name in chosen])
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        facts.nested.unpersist()

    return stream.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
