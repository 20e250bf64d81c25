"""Connected components by alternating large-star and small-star steps.

Every step sends each vertex's neighbours to the least vertex known; a few rounds leave
every vertex one edge to the least vertex of its component. A vertex with very many
neighbours is met through ``lookup_hot``, so its edges stay spread over all partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import lookup_hot, staged, unstaged


def _with_least(edges: DataFrame, total: int, itself: bool) -> DataFrame:
    """(a, b, m): m is the least of a's neighbours, and of a itself where ``itself``."""
    least = F.least(F.col("a"), F.min("b")) if itself else F.min("b")
    groups = edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("degree"))
    return lookup_hot(edges, groups, "a", "degree", total, F.xxhash64("b"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of the edges (a, b); the component is the least
    vertex. Loops and repeated edges change nothing; no edges give no rows."""
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_with_least(both, 2 * now[0], True).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        last, large = edges, staged(large, "edges")
        small = _with_least(large, max(1, now[0]), False)
        edges = staged(small.select("a", F.col("m").alias("b"))
                       .unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(),
                       "edges")
        unstaged(last, large)
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
