"""Facts kept by content: a file whose source was parsed before, here or elsewhere, isn't parsed again."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..scratch import exists
from .facts import extracted


def version(wanted: str | None) -> str:
    """Names the facts that are wanted, as this extractor makes them."""
    fields = sorted((fact, sorted(names)) for fact, names in extract.wanted_of(wanted).items())
    return hashlib.sha256(f"{fields}\n{Path(extract.__file__).read_text(encoding='utf-8')}".encode()).hexdigest()[:16]


def kept_facts(files: DataFrame, store: str, wanted: str | None = None) -> DataFrame:
    """What extracted() gives of files (path, source), through a table at `store`: facts by the SHA-256 of a source, in a
    folder for each version. Sources that aren't in it are parsed once each and added, those that can't be parsed too.
    Two runs at a time may both add a source; either row is the same."""
    spark, at = files.sparkSession, f"{store}/version={version(wanted)}"
    keyed = files.select("path", "source", F.sha2("source", 256).alias("key"))
    new = keyed.where("source is not null").select(F.col("key").alias("path"), "source").dropDuplicates(["path"])
    if exists(spark, at):
        new = new.join(spark.read.parquet(at).select(F.col("path")), "path", "left_anti")
    facts = extracted(new, wanted, broken=True)
    facts.write.mode("append").parquet(at)
    kept = spark.read.schema(facts.schema).parquet(at).dropDuplicates(["path"]).where("ok").withColumnRenamed("path", "key")
    return keyed.select("path", "key").join(kept, "key").select("path", *[c for c in kept.columns if c != "key"])
