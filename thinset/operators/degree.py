"""Degree counting and degree capping on an edge table ``(a, b, sim)``, a < b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import save_measured, save_packed, small
from .similarity import above, both_ways, strong_links


def node_degrees(edges: DataFrame) -> DataFrame:
    """Neighbours per node (nodes without edges do not appear)."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes per degree, isolated nodes included."""
    degrees = nodes.select("id").join(node_degrees(edges), "id", "left")
    return degrees.groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(
        F.count("*").alias("nodes")
    )


def top_neighbors(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Neighbours of each node by similarity; ``place`` 1 is the closest."""
    by_sim = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    links = both_ways(edges) if k is None else strong_links(edges, k, both=True)
    placed = links.withColumn("place", F.row_number().over(by_sim))
    return placed if k is None else placed.filter(F.col("place") <= k)


def cap_degree_mutual(edges: DataFrame, max_degree: int) -> DataFrame:
    """Edges that are among the ``max_degree`` strongest of both their ends."""
    return (
        top_neighbors(edges, max_degree)
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.max("sim").alias("sim"), F.count("*").alias("_ends"))
        .filter("_ends = 2")
        .drop("_ends")
    )


def _crowded(edges: DataFrame, cap: int) -> DataFrame:
    return node_degrees(edges).filter(F.col("degree") > cap)


def _within(node: str, cut: str) -> str:
    """SQL: does a link to ``node`` stand at or before a cut ``(sim, id)``?  No cut keeps all."""
    return f"({cut} IS NULL OR sim > {cut}.sim OR (sim = {cut}.sim AND {node} <= {cut}.id))"


def cap_degree(edges: DataFrame, max_degree: int, ranked: list[int] | None = None) -> DataFrame:
    """Degree cap in which nodes drop their weakest surplus edges in id order.

    A node with a lower id drops first, so a later node may keep an edge it
    would otherwise have lost.  What a node drops is told by one cut, the last
    link it keeps.  The cuts are the fixpoint of "rank the links that lower ends
    leave, cut behind the cap-th": decisions depend on lower ids only, so the
    fixpoint is unique and is the sequential outcome.  A round ranks the frontier
    alone, nodes for which a cut of the last round gave or took a link; all
    others are settled for now.  ``ranked`` receives the nodes ranked per round.

    Only nodes above the cap take part, and only their cuts travel.
    The edges are read more than once: pass a saved table, not a computation.
    """
    cap = int(max_degree)
    edges = edges.select("a", "b", "sim")
    if not _crowded(edges, cap).limit(1).count():
        return edges
    if above(edges, cap):
        # Sure losses first (see similarity.py): leaves at most n * cap edges.
        rest = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
        edges = save_packed(strong_links(edges, cap, both=False).withColumn("_place", F.row_number().over(rest))
                            .filter(F.col("_place") <= cap).drop("_place"))
    none = F.lit(None).cast("struct<sim: double, id: long>")
    state, seen = save_measured(
        _crowded(edges, cap).select("id", none.alias("cut"), none.alias("old"), F.lit(True).alias("moved")),
        rows=F.count("*"),
    )
    busy = seen["rows"]
    if not busy:
        return edges
    held = save_packed(both_ways(edges).join(small(state.select(F.col("id").alias("a")), busy), "a", "left_semi"))
    # Links whose other end decides earlier; their fate is what changes a ranking.
    below = held.filter("b < a")

    # Ranking stops at the cap, so a hub is cut down before it is shuffled.
    order = Window.partitionBy("a").orderBy(F.col("there").desc(), F.col("sim").desc(), "b")
    last = F.expr(f"max(CASE WHEN _place = {cap} AND there THEN struct(sim, b AS id) END) AS _new")
    touched = held.withColumn("there", F.lit(True))
    while True:
        best = touched.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= cap)
        news = best.groupBy(F.col("a").alias("id")).agg(last, F.lit(True).alias("_at"))
        state, seen = save_measured(
            state.join(news, "id", "left")
            .selectExpr("id", "CASE WHEN _at THEN _new ELSE cut END AS cut", "cut AS old", "_at")
            .selectExpr("*", "NOT (cut <=> old) AS moved"),
            moved=F.count(F.when(F.col("moved"), 1)), ranked=F.count("_at"),
        )
        state = state.drop("_at")
        if ranked is not None:
            ranked.append(seen["ranked"])
        if not seen["moved"]:
            break
        cuts = small(state.selectExpr("id AS b", "cut", "old"), busy)
        moved = small(state.filter("moved").selectExpr("id AS b", "cut", "old"), seen["moved"])
        changed = below.join(moved, "b").filter(f"{_within('a', 'cut')} <> {_within('a', 'old')}")
        touched = (
            held.join(small(changed.select("a").distinct(), busy), "a", "left_semi").join(cuts, "b", "left")
            .selectExpr("a", "b", "sim", f"(b > a OR {_within('a', 'cut')}) AS there")
        )
    low = small(state.selectExpr("id AS a", "cut AS _low"), busy)
    high = small(state.selectExpr("id AS b", "cut AS _high"), busy)
    kept = f"{_within('b', '_low')} AND {_within('a', '_high')}"
    return edges.join(low, "a", "left").join(high, "b", "left").filter(kept).select("a", "b", "sim")
