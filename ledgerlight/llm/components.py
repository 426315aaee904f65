"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour (Kiveris et al., 2014) and is written to
the shared folder, so no lineage builds up and a lost executor costs one round. Minima are
pre-aggregated before they are shuffled; links of a hot node are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, the node counted."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger to the smaller node; all smaller neighbours of a node are linked to the smallest."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable, for nodes that have a link and aren't the smallest.

    ``links`` holds pairs (a, b) of longs with a > b. Nodes that are missing here are their own component.
    """
    now = stored(links.select("a", "b").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
        now = stored(_small_star(_large_star(now)), "links")
