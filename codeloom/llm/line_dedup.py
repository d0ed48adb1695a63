"""Line dedup by winnowing, in DataFrame operations only.

A document's content lines (those not blank) have a hash each. Every window of `run` consecutive content lines selects
its least hash, the rightmost of equals, as fingerprint, so any shared run of at least `run` lines shares one: windows
with the same lines select the same one, at the same place in them. Positions of fingerprints that stand at one place
only are left out. Of the others, each of the `run` windows around a position is joined with the first place that has a
window of the same lines, by two hashes of all of them: so fingerprints select what is compared, and the windows' own hashes
decide. Windows that overlap extend the match both ways, and the lines so covered go.

No pairs of positions are made: a position meets one first position for each of the `run` windows around it. What
very many documents share is one row of the table of first positions, and joined where its positions are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written


def fingerprints(docs: DataFrame, run: int) -> DataFrame:
    """Selected positions: doc (struct that orders and identifies documents), at (content line), fp, and the windows
    around it (place of the first line; two hashes of its lines)."""
    content = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = docs.select("doc", content.alias("content"))
    hashed = lines.select("doc", F.transform("content", lambda x: F.xxhash64(x)).alias("h"), F.transform("content", lambda x: F.xxhash64(F.lit(7), x)).alias("g")).where(F.size("h") >= run)

    def chosen(s):
        # the least hash, and of equals the one that stands last
        return -F.array_min(F.transform(F.slice("h", s + 1, run), lambda x, j: F.struct(x.alias("fp"), (-(s + j)).alias("at"))))["at"]

    def window(s):
        return F.struct(s.alias("place"), F.xxhash64(F.slice("h", s + 1, run)).alias("w1"), F.xxhash64(F.slice("g", s + 1, run)).alias("w2"))

    selected = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), chosen))
    at = hashed.select("doc", "h", "g", selected.alias("at"))

    def around(p):
        return F.transform(F.sequence(F.greatest(p - (run - 1), F.lit(0)), F.least(p, F.size("h") - run)), window)

    rows = at.select("doc", F.explode(F.transform("at", lambda p: F.struct(p.alias("at"), F.get("h", p).alias("fp"), around(p).alias("windows")))).alias("x"))
    return rows.select("doc", "x.at", "x.fp", "x.windows")


def repeated_runs(docs: DataFrame, run: int) -> DataFrame:
    """Windows of `run` content lines that also occur earlier, in order of document and place: doc, place. Every line of
    such a window, and only such lines, repeat a run."""
    every = written(fingerprints(docs, run), "positions")
    of_fp = every.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("a"), F.max(F.struct("doc", "at")).alias("b"))
    recurring = written(of_fp.where("a < b").select("fp", "n"), "recurring")
    joined = hot_join(every, recurring, ["fp"])
    windows = written(joined.select(F.explode("windows").alias("w"), "doc").select("w.w1", "w.w2", F.struct("doc", "w.place").alias("at")), "windows")
    of_window = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    first = written(of_window.where("first < last").select("w1", "w2", "n", "first"), "first")
    return hot_join(windows, first, ["w1", "w2"]).where("at > first").select("at.doc", "at.place")


def line_dedup(docs: DataFrame, run: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_lines, n_removed, removed (numbers of the
    lines, from 0), kept_text (the other lines).

    Lines end at "\\n" and are compared, by 128 bits of hashes, without spaces at either end. Blank lines are neither
    compared nor removed. A run of at least `run` content lines that occurred earlier (in a document with a smaller
    doc_id, or further up) is removed; shorter repeats stay. Null texts have no lines and come back as ''. Rows with
    equal doc_id and text count as one document; a null doc_id sorts first. The work on a text grows with its lines,
    however many. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("doc", F.struct("doc_id", F.xxhash64("text").alias("of")))
    places = repeated_runs(docs, run).groupBy("doc").agg(F.collect_set("place").alias("places"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + run - 1)))))
    gone = places.select(F.col("doc.doc_id").alias("gone_doc"), F.col("doc.of").alias("gone_of"), covered.alias("gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_doc"]) & (docs["doc.of"] == gone["gone_of"]), "left")
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    numbers = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    # inline() keeps both arrays from being made again for every entry that is looked up in them
    split = joined.select("doc_id", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.inline(F.array(F.struct(lines.alias("lines"), numbers.alias("numbers")))))
    out = split.select("doc_id", "lines", F.transform("gone", lambda p: F.get("numbers", p)).alias("removed"))
    left = F.array_except(F.sequence(F.lit(0), F.greatest(F.size("lines"), F.lit(1)) - 1), "removed")
    kept = F.when(F.size("removed") == 0, F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", F.array_join(kept, "\n").alias("kept_text"))
