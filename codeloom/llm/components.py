"""Connected components of a graph of any size, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written


def _stars(pairs: DataFrame) -> DataFrame:
    """Each node u's neighbours v linked to the least of them and u; pairs (u, v), a written table or near one, has each
    link as often as wanted. The neighbours of a node that very many have stay where they are."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return hot_join(pairs, least, ["u"]).drop("n")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for every node of links (a, b)."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        rows, nodes = links.agg(F.count("*"), F.count_distinct("u")).first()
        if rows == nodes and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            # every u has one v, which is no u: these are stars
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = _stars(written(large, "large-stars"))
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = written(small, "links")
