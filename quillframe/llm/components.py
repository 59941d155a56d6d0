"""Connected components by alternating large-star and small-star steps on a table of links.

Every step is a grouped minimum and a join on the same key, so a hub's links are combined
before the shuffle and its join can be split by adaptive execution; nothing is collected but
two numbers by which convergence is seen. State between steps is a checkpoint in the shared
folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return sym.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x"))
    spread = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spread.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links: u, v (long). Returns node, root: the smallest node reachable, for every node of a link but the roots.

    Null ends and loops are no links; repeated links count once. Without links the result is empty.
    """
    edges = cut(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    before = None
    for _ in range(most_rounds):
        edges = cut(small_star(large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
