"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long); component is the smallest node reachable.

    Each round rewires every node to the smallest neighbour it knows, first the larger neighbours, then the smaller
    ones; the number of rounds grows with the logarithm of the longest path. A round is written to the shared
    checkpoint folder. Self-links are ignored.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(smallest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(smallest.select("hi", F.col("m").alias("lo"))).distinct())
        edges = written(small, "links")
        state = tuple(edges.agg(F.count("*"), F.sum("hi"), F.sum("lo"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
        before = state
