"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm import skew
from korpusmill.storage import Scratch


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the smallest node reachable, a row per node.

    Both steps take a node's least neighbour by an aggregate that combines before its shuffle and join it back; nodes with
    very many links get theirs by broadcast, so that their links stay where they are. Every step is saved. Links of a
    node with itself and repeated links change nothing; null ends are left out; without links the result is empty.
    """
    a, b = F.col("a"), F.col("b")
    edges = scratch.save(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _digest(edges)
    n = F.count(F.lit(1)).alias("n")
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = 2 * before[0]  # at most
        small = nodes * 24 <= skew.SMALL_BYTES
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), n)
        least = least if small else scratch.save(least, "least")
        large = skew.join_unique(both, least, ["u"], "n", row_bytes=24, at_most=nodes).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        fewest = large.groupBy("u").agg(F.min("v").alias("m"), n)
        fewest = fewest if small else scratch.save(fewest, "fewest")
        next_ = skew.join_unique(large, fewest, ["u"], "n", row_bytes=24, at_most=nodes).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_ = scratch.save(next_.unionByName(fewest.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(edges, large, *([] if small else [least, fewest]))
        edges, now = next_, _digest(next_)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
