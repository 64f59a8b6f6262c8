"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled


def components(links: DataFrame) -> DataFrame:
    """``a, b`` to ``node, component``: the smallest node reachable, for each node that has a link.

    A round links every larger neighbour of a node to its smallest one, then every smaller one. Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one step. Rounds grow with the logarithm of the nodes.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settled(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = settled(small, "small-star")
        same = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
