"""Connected components of an edge table in rounds of large-star and small-star steps.

Every step is an aggregate and a join on shuffled keys, so a node with very many edges
is combined before the shuffle and split by the skew join.  A round is written to the
shared folder; the rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the least node.

    Nodes may have any type with an order.  Self-loops give a component of one; edges
    with a null end are left out, repeated edges count once, no edges give no rows.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    links = edges.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links, seen = stored(links, "links"), None
    while True:
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = stored(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    inner = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    alone = loops.join(inner.select("node").union(roots.select("node")), "node", "left_anti")
    return inner.union(roots).union(alone.withColumn("component", F.col("node")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node's neighbourhood."""
    both = links.select("v", "u").union(links.select(F.col("u"), F.col("v")).toDF("v", "u"))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    moved = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.where("v <> u").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    moved = links.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
