"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import write_table


def _written(edges: DataFrame, seen_as) -> tuple[DataFrame, int]:
    """The written edges, and a number that is observed while they are written."""
    seen = Observation()
    table = write_table(edges.observe(seen, seen_as.alias("n")), "links")
    return table, seen.get["n"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it can reach.

    Each round does a large star (every larger neighbour of a node moves to the node's smallest
    neighbour) and a small star (every smaller neighbour does), which ends after a number of rounds
    that grows with the logarithm of the longest path.  An edge becomes one edge in each step, so the
    table never grows.  A node with many larger neighbours, as a hub is, is one row in the minimum,
    summed before the shuffle, and one key of a join that Spark may split, as both of its sides are read from
    files; no neighbour list is built.  Every round is written to the shared folder.  Links with a null end and loops don't count.
    """
    edges, open_ = _written(links.where("a is not null and b is not null and a <> b")
                            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                            F.count(F.lit(1)))
    while open_:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("v"), F.least("u", "low").alias("low"))
        low = write_table(low, "low")
        large = edges.join(low, "v").withColumn("least", F.min("low").over(Window.partitionBy("u")))
        smallest = F.col("low") == F.col("least")
        moved = large.select(F.when(smallest, F.col("u")).otherwise(F.col("low")).alias("u"), F.col("least").alias("v"),
                             ((F.col("low") != F.col("v")) | ~smallest).alias("changed"))
        edges, open_ = _written(moved, F.count_if("changed"))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(edges.select("v", "v").distinct())
