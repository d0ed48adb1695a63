"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else what SparkContext.setCheckpointDir was given. Without either: in local mode, where
    driver and executors are one process, a temporary folder that is then the session's; on a cluster, an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("no shared folder: set spark.checkpoint.dir, or call SparkContext.setCheckpointDir, with a path that the driver and all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_OWN: list[str] = []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Deletes the tables that were written for queries so far. Call it when their results have been read, in a session
    that goes on; what was made of them can't be read any more."""
    while _OWN:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_OWN.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. release() deletes what is there, or the JVM as it ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again, which cuts its lineage."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
