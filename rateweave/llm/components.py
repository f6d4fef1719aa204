"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; ``component`` is the least node reachable.

    Links have no direction; repeated links, loops and links with a null end change nothing. An empty table gives an
    empty one. Steps go on until a pair of them leaves the edges as they are, at most a logarithmic number of times;
    each pair of steps is written to the shared folder, so that a lost executor costs the retry of some tasks. A node's
    neighbours are never gathered: minima are taken before the shuffle, and joins on a hot node are split at run time.
    """
    edges = saved(links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = saved(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
