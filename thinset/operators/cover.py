"""Greedy maximum coverage on a graph, many picks per round.

The rule: again and again take the uncovered node with the most uncovered nodes
in its closed neighbourhood (ties: earliest node order) and cover them.

Gains only ever fall, so a node that has the best priority among all nodes it
shares an uncovered node with will be picked whatever happens elsewhere.  Every
round picks all such nodes at once; sorting the picks by (gain, order) gives the
very sequence of the one-at-a-time rule.  The gains are a table of the uncovered
nodes, changed after each step by the links of the nodes it covered.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import save_measured, save_packed, save_packed_measured, small, with_position
from .links import Links

# Most links (about 100 MB with indexes) one task may finish on its own.
GROUP_LINKS = 2_000_000
# Links are written anew when less than this share of them is left.
STALE_SHARE = 4
# Leading nodes are a share of all nodes, but at least a few; steps of leading nodes
# follow a round that picked less than a share of their number.
FEW_SHARE = 16
LEADER_STEPS = 8
LEADER_SHARE = 16
MIN_LEADERS = 1024

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def node_order(
    nodes: DataFrame, firsts: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Tie-break position ``ord`` of every node (other columns stay).

    A node enters the graph when it is first met: at its own turn, or earlier as
    a neighbour of a node with a lower id, closest neighbours first.
    """
    if firsts is None:
        return with_position(nodes, ["id"], "ord", rows)
    keyed = nodes.join(firsts, "id", "left").select(
        *nodes.columns,
        F.coalesce("first_a", "id").alias("_turn"),
        F.col("first_a").isNotNull().cast("int").alias("_met"),
        F.coalesce(-F.col("first_sim"), F.lit(0.0)).alias("_far"),
    )
    placed = with_position(keyed, ["_turn", "_met", "_far", "id"], "ord", rows)
    return placed.drop("_turn", "_met", "_far")


class Cover:
    """Finished rounds of a cover; the picks are only written when asked for."""

    def __init__(self, order: DataFrame, n: int, k: int):
        self.order, self.n, self.k = order, n, k
        self.picked: list[DataFrame] = []   # (u, p): pick and its priority, per step
        self.chosen = 0     # picks that cover at least one neighbour
        self.gained = 0     # nodes those picks cover
        self.exhausted = True

    def add(self, picked: DataFrame, chosen: int, gained: int | None) -> None:
        self.picked.append(picked.select("u", "p"))
        self.chosen += chosen
        self.gained += gained or 0

    def settled(self, best_left: int) -> bool:
        """Are the first k picks certain, given the best priority still around?"""
        if self.chosen < self.k:
            return False
        # Gains only fall, so later picks cannot beat what is left now.
        return self._picked().filter(F.col("p") > best_left).count() >= self.k

    def _picked(self) -> DataFrame:
        empty = self.order.select(F.col("ord").alias("u"), F.col("ord").alias("p")).limit(0)
        return reduce(DataFrame.unionByName, self.picked) if self.picked else empty

    def _all(self, edges: DataFrame) -> DataFrame:
        chosen = self._picked().select(F.expr(f"p div {self.n}").alias("gain"), F.col("u").alias("ord"))
        if not self.exhausted or self.chosen >= self.k:
            return chosen
        # Whatever no pick covers stands alone and covers itself.
        taken = small(self.order.join(chosen.select("ord"), "ord", "left_semi").select("id"),
                      self.chosen)
        reached = (
            taken.unionByName(edges.join(taken.withColumnRenamed("id", "a"), "a", "left_semi")
                              .select(F.col("b").alias("id")))
            .unionByName(edges.join(taken.withColumnRenamed("id", "b"), "b", "left_semi")
                         .select(F.col("a").alias("id")))
        )
        alone = self.order.join(reached, "id", "left_anti")
        return chosen.unionByName(alone.select(F.lit(1).cast("long").alias("gain"), "ord"))

    def totals(self) -> dict:
        """Number of picks kept and nodes they cover."""
        if self.exhausted and self.chosen <= self.k:
            alone = min(self.k - self.chosen, self.n - self.gained)
            return {"picks": self.chosen + alone, "covered": self.gained + alone}
        best = self._ranked(None).agg(F.count("*").alias("picks"), F.sum("gain").alias("covered"))
        return best.first().asDict()

    def _ranked(self, edges: DataFrame | None) -> DataFrame:
        order = [F.col("gain").desc(), F.col("ord")]
        return with_position(self._all(edges), order, "pick_rank", self.n).filter(
            F.col("pick_rank") < self.k
        )

    def picks(self, edges: DataFrame) -> DataFrame:
        """``(id, gain, pick_rank)``, ranks from 1."""
        return (
            self.order.join(small(self._ranked(edges), self.k), "ord")
            .select("id", "gain", (F.col("pick_rank") + 1).alias("pick_rank"))
        )


def run_cover(
    edges: DataFrame, nodes: DataFrame, k: int, order: DataFrame | None = None,
    n: int | None = None, max_degree: int | None = None, largest_group: int | None = None,
) -> Cover:
    """Rounds of the cover over undirected ``(a, b)`` edges; self-loops are implied.

    ``order`` holds ``id`` and ``ord``.  If it also holds a column ``grp`` that no
    edge crosses, groups are independent of each other: if even the biggest
    (``largest_group`` nodes) is sure to fit into one task, each group is finished
    in a task of its own, side by side.
    """
    n = nodes.count() if n is None else n
    order = node_order(nodes, None, n) if order is None else order
    # One whole number holds a priority: higher gain first, then lower order.
    if (n + 1) * n >= 2**63:
        raise OverflowError("too many nodes for a 64-bit priority")
    near = small(order.withColumnsRenamed({"id": "a", "ord": "oa"}), n)
    far = small(order.select(F.col("id").alias("b"), F.col("ord").alias("ob")), n)
    ordered = edges.select("a", "b").join(near, "a").join(far, "b")
    cover = Cover(order, n, k)

    if "grp" in order.columns:
        if largest_group is None:
            largest_group = order.groupBy("grp").count().agg(F.max("count")).first()[0]
        widest = min(largest_group - 1, max_degree or largest_group)
        if largest_group * widest <= 2 * GROUP_LINKS:
            found, seen = save_measured(
                ordered.select("grp", "oa", "ob").groupBy("grp")
                .applyInArrow(_group_task(n, k), "u long, p long"),
                chosen=F.count("*"), gained=F.sum(F.expr(f"p div {n}")),
            )
            cover.add(found, seen["chosen"], seen["gained"])
            cover.exhausted = True
            return cover

    both = F.explode(F.array(F.struct(F.col("oa").alias("u"), F.col("ob").alias("v")),
                             F.struct(F.col("ob").alias("u"), F.col("oa").alias("v"))))
    links, seen = save_packed_measured(ordered.select(both.alias("_l")).select("_l.*"), rows=F.count("*"))
    if seen["rows"]:
        _rounds(links, seen["rows"], cover)
    return cover


def _group_task(n: int, k: int):
    """Cover of one bounded group: repeated best pick, gains kept up to date."""

    def pick(links: pa.Table) -> pa.Table:
        left, right = links.column("oa").to_numpy(), links.column("ob").to_numpy()
        names, flat = np.unique(np.concatenate([left, right, right, left]), return_inverse=True)
        half = len(flat) // 2
        tail, head = flat[:half], flat[half:]
        by_tail = np.argsort(tail, kind="stable")
        head = head[by_tail]
        start = np.searchsorted(tail[by_tail], np.arange(len(names) + 1))

        def around(node):
            return head[start[node] : start[node + 1]]

        rank = n - 1 - names
        value = (np.diff(start) + 1) * n + rank
        picks: list[int] = []
        values: list[int] = []
        while len(picks) < k:
            best = int(value.argmax())
            if value[best] < 2 * n:  # only lone nodes are left
                break
            picks.append(int(names[best]))
            values.append(int(value[best]))
            fresh = [x for x in (best, *around(best).tolist()) if value[x] >= 0]
            for node in fresh:
                value[node] = -1
            for node in fresh:
                near = around(node)
                value[near[value[near] >= 0]] -= n
        return pa.table({"u": pa.array(picks, pa.int64()), "p": pa.array(values, pa.int64())})

    return pick


def _priority(gain, node, n: int):
    return gain * F.lit(n) + F.lit(n - 1) - node


def _leader_task(n: int, k: int, bar: int):
    """Picks among a bounded set of leading nodes while they beat the ``bar``.

    Every other node's priority is at most the bar and can only fall, so up to
    there these are the picks of the whole graph.
    """

    def pick(links: pa.Table) -> pa.Table:
        tail, head = links.column("u").to_numpy(), links.column("v").to_numpy()
        leaders = np.unique(tail)
        nodes = np.unique(np.concatenate([tail, head]))
        owner = np.searchsorted(leaders, np.concatenate([tail, leaders]))
        member = np.searchsorted(nodes, np.concatenate([head, leaders]))

        def grouped(keys, values, size):
            order = np.argsort(keys, kind="stable")
            start = np.searchsorted(keys[order], np.arange(size + 1))
            return values[order], start

        covers, cover_at = grouped(owner, member, len(leaders))
        owners, owner_at = grouped(member, owner, len(nodes))
        spot = np.searchsorted(nodes, leaders)
        value = np.diff(cover_at) * n + (n - 1 - leaders)
        open_ = np.ones(len(nodes), dtype=bool)
        picks: list[int] = []
        values: list[int] = []
        while len(picks) < k:
            best = int(np.where(open_[spot], value, -1).argmax())
            if not open_[spot[best]] or value[best] <= bar or value[best] < 2 * n:
                break
            picks.append(int(leaders[best]))
            values.append(int(value[best]))
            near = covers[cover_at[best] : cover_at[best + 1]]
            for node in near[open_[near]]:
                open_[node] = False
                value[owners[owner_at[node] : owner_at[node + 1]]] -= n
        # The picks with their priorities, and every node they cover.
        covered = nodes[~open_].tolist()
        return pa.table({"u": pa.array(picks + covered, pa.int64()),
                         "p": pa.array(values + [None] * len(covered), pa.int64())})

    return pick


class Open:
    """Nodes not covered yet that still have such a neighbour, with their gains.

    The links stay as they were written.  When nodes get covered, only the links of
    those nodes are read to lower the gains of the nodes around them; the links are
    written anew each time most of them have become links of covered nodes.
    """

    def __init__(self, links: DataFrame, stored: int, n: int):
        self.links, self.stored, self.n = links, stored, n
        self._measure(links.groupBy("u").agg((F.count("*") + 1).alias("gain")))

    def _measure(self, gains: DataFrame) -> None:
        gains = gains.filter("gain > 1").select("u", "gain", _priority(F.col("gain"), F.col("u"), self.n).alias("p"))
        self.nodes, seen = save_measured(
            gains, rows=F.count("*"), best=F.max("p"), most=F.max("gain"),
            left=F.coalesce(F.sum(F.col("gain") - 1), F.lit(0)))
        self.rows, self.best, self.most, left = (seen[name] for name in ("rows", "best", "most", "left"))
        if self.rows and left * STALE_SHARE < self.stored:
            there = small(self.nodes.select("u"), self.rows)
            self.links = save_packed(self.links.join(there, "u", "left_semi")
                              .join(there.withColumnRenamed("u", "v"), "v", "left_semi"))
            self.stored = left

    def scores(self) -> DataFrame:
        return small(self.nodes.select("u", "p"), self.rows)

    def cover(self, covered: DataFrame, rows: int) -> None:
        """Take ``covered`` nodes (u), at most ``rows`` of them, out of the state."""
        covered = small(covered, rows)
        lost = self.links.join(covered, "u").groupBy(F.col("v").alias("u")).agg(F.count("*").alias("_lost"))
        gain = F.col("gain") - F.coalesce("_lost", F.lit(0))
        self._measure(self.nodes.join(covered, "u", "left_anti").join(lost, "u", "left")
                      .select("u", gain.alias("gain")))


def _rounds(links: DataFrame, size: int, cover: Cover) -> None:
    """Alternate between picks all over the graph and steps of leading nodes.

    Steps of leaders go first if they are likely to make all the picks, and follow a
    round that picked few nodes; a graph with a huge hub only has rounds.
    """
    state = Open(links, size, cover.n)
    leading = cover.k <= _leader_count(state)
    while state.rows:
        if leading:
            for _ in range(LEADER_STEPS):
                if state.rows and state.most <= GROUP_LINKS:
                    _leader_step(state, cover)
                    if state.rows and cover.settled(state.best):
                        cover.exhausted = False
                        return
        if not state.rows:
            return
        picked = _best_around(state, cover)
        if state.rows and cover.settled(state.best):
            cover.exhausted = False
            return
        leading = picked * FEW_SHARE < _leader_count(state)


def _leader_count(state: Open) -> int:
    return max(1, min(GROUP_LINKS // max(1, state.most or 1), max(MIN_LEADERS, state.n // LEADER_SHARE)))


def _leader_step(state: Open, cover: Cover) -> None:
    """One step for dense graphs, where few nodes are best in their surroundings.

    A bounded number of leaders, with at most ``GROUP_LINKS`` links between them,
    go to one task, which makes picks until it reaches the best node left outside.
    """
    wanted = _leader_count(state)
    low = state.nodes.orderBy(F.col("p").desc()).limit(wanted + 1).agg(
        F.count("*").alias("c"), F.min("p").alias("p")).first()
    bar = low["p"] if low["c"] > wanted else -1
    leaders = small(state.nodes.filter(F.col("p") > bar).select("u"), wanted)
    there = small(state.nodes.select(F.col("u").alias("v")), state.rows)
    around = state.links.join(leaders, "u").join(there, "v", "left_semi").select("u", "v")
    found, seen = save_measured(
        around.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(
            _leader_task(cover.n, cover.k, bar), "u long, p long"),
        chosen=F.count("p"), gained=F.sum(F.expr(f"p div {cover.n}")), rows=F.count("*"),
    )
    cover.add(found.filter("p IS NOT NULL"), seen["chosen"], seen["gained"])
    # A pick is also among the nodes it covers.
    state.cover(found.filter("p IS NULL").select("u"), seen["rows"])


def _best_around(state: Open, cover: Cover) -> int:
    """Pick every node that is best among all it shares an uncovered node with.

    Map-side combined aggregates and joins only: safe for any hub.
    """
    score, links = state.scores(), state.links
    one = small(
        links.join(score, "u").groupBy(F.col("v").alias("u")).agg(F.max("p").alias("_p"))
        .join(score, "u").select("u", "p", F.greatest("p", "_p").alias("m1")),
        state.rows,
    )
    two, seen = save_measured(
        links.join(one, "u").groupBy(F.col("v").alias("u")).agg(F.max("m1").alias("_m"))
        .join(one, "u").select("u", "p", "m1", (F.col("_m") <= F.col("p")).alias("picked")),
        chosen=F.count(F.when(F.col("picked"), 1)),
        gained=F.sum(F.when(F.col("picked"), F.expr(f"p div {cover.n}"))),
    )
    picked = two.filter("picked")
    cover.add(picked, seen["chosen"], seen["gained"])
    # The best priority a covered node sees next to it belongs to a pick.
    best = small(picked.select(F.col("p").alias("m1")), seen["chosen"])
    state.cover(two.join(best, "m1", "left_semi").select("u"), seen["gained"])
    return seen["chosen"]


def max_cover(
    edges: DataFrame | Links, nodes: DataFrame, k: int, order: DataFrame | None = None
) -> DataFrame:
    """Picks ``(id, gain, pick_rank)``; fewer than ``k`` if all is covered early."""
    if isinstance(edges, Links):
        return edges.cover(k, node_order(nodes) if order is None else order).picks()
    return run_cover(edges, nodes, k, order).picks(edges)


def duplicate_cover(df: DataFrame, key_cols: list[str], k: int, id_col: str = "row_id") -> DataFrame:
    """Greedy cover when only exact copies are linked: one row per copy group.

    A group of copies is a clique, so it needs no pairs: its size is the gain,
    its lowest id the pick, and bigger groups come first (ties: lower id).
    """
    groups = df.groupBy(*key_cols).agg(
        F.count("*").alias("gain"), F.min(id_col).cast("long").alias("id")
    )
    ranked = with_position(
        groups.select("id", "gain"), [F.col("gain").desc(), F.col("id")], "pick_rank"
    )
    return ranked.filter(F.col("pick_rank") < k).select(
        "id", "gain", (F.col("pick_rank") + 1).alias("pick_rank")
    )
