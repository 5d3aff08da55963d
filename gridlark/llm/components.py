"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.stores import Scratch

PART_LINKS = 200_000


def components(links: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(node, component) for the nodes of links (u, v): component is the smallest node reachable.

    Each round points every larger neighbour of a node to its smallest one, then
    each node to its smallest neighbour; the links shrink to stars in a logarithmic
    number of rounds.  Rows with a null end, loops and repeats are ignored.  A node's
    links never meet in one row, and joins on a node of many links can be split.
    With `work` the tables, the result's too, are its owner's to drop.
    """
    stored = (work or Scratch(links.sparkSession, "components")).stored
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # small tables are kept in few files: one for every PART_LINKS links
    parts = edges.count() // PART_LINKS + 1
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).coalesce(parts), "least")
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", "m")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = stored(small.coalesce(parts), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
