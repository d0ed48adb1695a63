"""Suppression: findings that comments or a baseline accept are dropped by anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE, WHOLE_FILE = r"#\s*codeloom:\s*ignore(?:-file)?(?:\[([^\]]*)\])?", r"#\s*codeloom:\s*ignore-file\b"


def evidence_hash(detector: str | Column = "detector", evidence: str | Column = "evidence") -> Column:
    return F.substring(F.sha2(F.concat(detector, F.lit("\0"), evidence), 256), 1, 12)


def inline_ignores(comments: DataFrame) -> DataFrame:
    """path, line (null: the whole file), name (null: all detectors) from comments (path, line, text)."""
    found = comments.where(F.col("text").rlike(INLINE))
    whole = found.where(F.col("text").rlike(WHOLE_FILE)).select("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("name"))
    names = F.filter(F.transform(F.split(F.regexp_extract("text", INLINE, 1), ","), lambda n: F.trim(n)), lambda n: n != "")
    lines = found.where(~F.col("text").rlike(WHOLE_FILE)).select("path", "line", F.explode_outer(names).alias("name"))
    return whole.unionByName(lines)


#: Widths of the bins that lines are joined by. A finding's are the least that are wider than it is long, so it lies in
#: two of them at most.
WIDTHS = tuple(64 << 4 * level for level in range(7))


def unsuppressed(findings: DataFrame, ignores: DataFrame, baseline: DataFrame | None = None, rel_path: Column | None = None) -> DataFrame:
    """findings without those of an ignored file, those with an ignored line between line and end_line, and those of
    the baseline (detector, rel_path, line, evidence_hash)."""
    # the accepting sides are hashed, so findings, of which there are far more, are neither sorted nor held
    files = ignores.where("line is null").select(F.col("path").alias("file")).distinct().hint("shuffle_hash")
    at = ignores.where("line is not null").select("path", F.col("line").alias("at"), "name").distinct()
    left = findings.join(files, "file", "left_anti")
    end = F.coalesce("end_line", "line")
    width = F.coalesce(*[F.when(end - F.col("line") < w, F.lit(w)) for w in WIDTHS])
    bins = at.withColumn("of", F.explode(F.array(*map(F.lit, WIDTHS)))).withColumn("bin", F.floor(F.col("at") / F.col("of"))).hint("shuffle_hash")
    for edge in (F.col("line"), end):
        inside = (F.col("file") == F.col("path")) & (width == F.col("of")) & (F.floor(edge / width) == F.col("bin"))
        inside &= F.col("at").between(F.col("line"), end) & (F.col("name").isNull() | (F.col("name") == F.col("detector")))
        left = left.join(bins, inside, "left_anti")
    if baseline is None:
        return left
    key = left.withColumns({"rel_path": F.col("file") if rel_path is None else rel_path, "evidence_hash": evidence_hash()})
    return key.join(baseline.hint("shuffle_hash"), ["detector", "rel_path", "line", "evidence_hash"], "left_anti").select(findings.columns)


def baseline_of(findings: DataFrame, rel_path: Column) -> DataFrame:
    return findings.select("detector", rel_path.alias("rel_path"), "line", evidence_hash().alias("evidence_hash")).distinct().orderBy("detector", "rel_path", "line", "evidence_hash")
