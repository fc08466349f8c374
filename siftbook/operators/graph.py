"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.session import shared_folder


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its lowest node.

    Alternates two steps until no edge changes: each node's higher neighbours are linked to its
    lowest neighbour, then its lower neighbours are. The number of edges never grows, the lowest
    neighbour is an aggregate that combines before the shuffle, and the number of rounds grows with
    the logarithm of the longest chain. Loops and null ends are ignored; no edges give no rows.
    """
    shared_folder(edges.sparkSession)
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = ends.filter(edges[a].isNotNull() & edges[b].isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint()
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        higher = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lowest = higher.groupBy("u").agg(F.min("v").alias("low"))
        lower = higher.join(lowest, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = lower.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct().checkpoint()
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
