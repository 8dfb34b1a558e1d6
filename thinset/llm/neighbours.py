"""Approximate nearest neighbours on navigable small-world graphs, one for each shard.

Rows of equal vectors form a class that carries its smallest ids, so copies fill neither
graph nor result.  Classes are dealt by hash into shards of bounded size, and one task
builds a shard's hierarchy: every node has a highest layer drawn from a hash, a layer is
filled from the nodes of the layer above downwards, each batch of nodes finds its
neighbours by beam search on what stands there already, keeps those that are nearer to it
than to a neighbour kept before, and is added to their lists under the same rule.  The
written index holds a node in a row: ids, vector, and its neighbours in all layers as one
flat array.  Every query meets every shard; a task reads a shard's rows, then lets the
queries pass, and the shards' best are merged by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinset.llm.tables import stored
from thinset.llm.words import mix

BEST = 5
EVERY = 50            # queries are the rows whose id is divisible by this
SHARD_ROWS = 8192     # classes of a shard, on average
QUERY_ROWS = 1 << 17  # queries that pass through a task
LINKS = 16            # neighbours of a node in an upper layer; twice as many in the lowest
BUILD_WIDTH, SEARCH_WIDTH = 96, 192  # beams
BATCH = 256           # nodes or queries searched side by side
STEP = 4              # nodes of a beam expanded at a time
NODE = "dim int, shard int, node int, ids array<long>, vector array<double>, links array<int>"
HIT = "query_id long, vec_id long, score double"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int):
    """(nodes, similarities), best first, of a beam of ``width`` for each query; -1 where none.

    ``entries`` names the nodes each query sets out from (-1: none).
    """
    rows, n = len(queries), len(vectors)
    seen = np.zeros((rows, n), bool)
    ids = np.full((rows, width), -1, np.int32)
    near = np.full((rows, width), -np.inf, np.float32)
    fresh = np.zeros((rows, width), bool)

    def enter(row: np.ndarray, node: np.ndarray) -> None:
        """Put the unseen of (row, node), sorted by row, into the beams."""
        code = np.unique(row * np.int64(n) + node)
        row, node = code // n, code % n
        new = ~seen[row, node]
        row, node = row[new], node[new]
        seen[row, node] = True
        value = np.einsum("ij,ij->i", queries[row], vectors[node])
        worth = value > near[row, -1]
        row, node, value = row[worth], node[worth], value[worth]
        if not len(row):
            return
        own, first, count = np.unique(row, return_index=True, return_counts=True)
        line, place = np.repeat(np.arange(len(own)), count), np.arange(len(row)) - np.repeat(first, count) + width
        more = int(count.max())
        wide_ids = np.concatenate([ids[own], np.full((len(own), more), -1, np.int32)], 1)
        wide_near = np.concatenate([near[own], np.full((len(own), more), -np.inf, np.float32)], 1)
        wide_fresh = np.concatenate([fresh[own], np.zeros((len(own), more), bool)], 1)
        wide_ids[line, place], wide_near[line, place], wide_fresh[line, place] = node, value, True
        order = np.argsort(-wide_near, axis=1, kind="stable")[:, :width]
        ids[own] = np.take_along_axis(wide_ids, order, 1)
        near[own] = np.take_along_axis(wide_near, order, 1)
        fresh[own] = np.take_along_axis(wide_fresh, order, 1)

    row, column = np.nonzero(entries >= 0)
    enter(row, entries[row, column])
    while True:
        chosen = fresh & (np.cumsum(fresh, 1) <= STEP)
        row, column = np.nonzero(chosen)
        if not len(row):
            return ids, near
        fresh[chosen] = False
        ahead = links[ids[row, column]]
        row = np.repeat(row, ahead.shape[1])
        ahead = ahead.ravel()
        enter(row[ahead >= 0], ahead[ahead >= 0])


def spread(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, count: int) -> np.ndarray:
    """Of each row's candidates, best first, up to ``count``: those nearer to the row's own
    vector than to any kept before, then the best of the others; -1 where none."""
    own = vectors[nodes]
    between = np.matmul(own, own.transpose(0, 2, 1))
    valid = nodes >= 0
    kept = np.zeros(nodes.shape, bool)
    for j in range(nodes.shape[1]):
        free = valid[:, j] & (kept.sum(1) < count)
        kept[:, j] = free & ~(kept & (between[:, j] > near[:, j, None])).any(1)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :count]
    chosen = np.take_along_axis(nodes, order, 1)
    if chosen.shape[1] < count:
        chosen = np.concatenate([chosen, np.full((len(chosen), count - chosen.shape[1]), -1, np.int32)], 1)
    return chosen


def _mirror(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """Add each of ``nodes`` to the lists of its neighbours, which are chosen anew if full."""
    cap = links.shape[1]
    to = links[nodes].ravel()
    back = np.repeat(nodes, cap)[to >= 0]
    to = to[to >= 0]
    value = np.einsum("ij,ij->i", vectors[to], vectors[back])
    order = np.lexsort((back, -value, to))
    to, back = to[order], back[order]
    own, first, count = np.unique(to, return_index=True, return_counts=True)
    line, place = np.repeat(np.arange(len(own)), count), np.arange(len(to)) - np.repeat(first, count)
    few = place < cap
    new = np.full((len(own), cap), -1, np.int32)
    new[line[few], place[few]] = back[few]
    wide = np.concatenate([links[own], new], 1)
    twice = np.sort(wide, 1)
    again = (twice[:, 1:] == twice[:, :-1]) & (twice[:, 1:] >= 0)
    near = np.where(wide >= 0, np.einsum("id,ijd->ij", vectors[own], vectors[wide]), -np.inf)
    if again.any():  # two nodes of a batch that chose each other
        for i in np.flatnonzero(again.any(1)):
            _, firsts = np.unique(wide[i], return_index=True)
            gone = np.setdiff1d(np.arange(wide.shape[1]), firsts)
            wide[i, gone], near[i, gone] = -1, -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    wide, near = np.take_along_axis(wide, order, 1), np.take_along_axis(near, order, 1)
    full = (wide >= 0).sum(1) > cap
    links[own[~full]] = wide[~full, :cap]
    for at in range(0, int(full.sum()), BATCH):
        part = np.flatnonzero(full)[at:at + BATCH]
        links[own[part]] = spread(vectors, wide[part], near[part], cap)


def build(vectors: np.ndarray, links_above: int = LINKS, width: int = BUILD_WIDTH) -> list[np.ndarray]:
    """Neighbour arrays of all layers, lowest first; nodes of higher layers come first in ``vectors``.

    Layer i has as many rows as nodes reach it (:func:`layer_sizes`), so that a node has
    the same number in all of them.
    """
    layers: list[np.ndarray] = []
    for level, size in reversed(list(enumerate(layer_sizes(len(vectors))))):
        links = np.full((size, links_above * (2 if level == 0 else 1)), -1, np.int32)
        here = vectors[:size]
        done = 0
        while done < size:
            nodes = np.arange(done, min(size, done + BATCH), dtype=np.int32)
            mates = here[nodes] @ here[nodes].T
            np.fill_diagonal(mates, -np.inf)
            ids, near = np.tile(nodes, (len(nodes), 1)), mates
            if done:
                found, close = beam(here[:done], links[:done], here[nodes],
                                    descend(here, layers, here[nodes], done), width)
                ids, near = np.concatenate([found, ids], 1), np.concatenate([close, near], 1)
            ids = np.where(np.isfinite(near), ids, -1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :width]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            links[nodes] = spread(here, ids, near, links.shape[1])
            _mirror(here, links, nodes)
            done += len(nodes)
        layers.insert(0, links)
    return layers


def layer_sizes(n: int) -> list[int]:
    """Nodes in each layer, lowest first: every layer has a 1/LINKS part of the one below."""
    sizes = [n]
    while sizes[-1] > LINKS:
        sizes.append(sizes[-1] // LINKS)
    return sizes


def descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, limit: int) -> np.ndarray:
    """Where a search sets out from below ``layers`` (lowest first), in the first ``limit`` nodes."""
    at = np.zeros((len(queries), 1), np.int32)
    for links in reversed(layers):
        at, _ = beam(vectors[:len(links)], links, queries, at, LINKS)
        at = np.where(at < limit, at, -1)
        at[(at < 0).all(1), 0] = 0
    return at


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int = SEARCH_WIDTH):
    """(nodes, similarities), best first, of each query's beam in the lowest layer."""
    return beam(vectors, layers[0], queries, descend(vectors, layers[1:], queries, len(vectors)), width)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _index_shard(table: pa.Table) -> pa.Table:
    """Rows of one shard (dim, shard, key, ids, vector) as nodes with their neighbours."""
    key = table["key"].to_numpy().view(np.uint64)
    table = table.take(pa.array(np.argsort(mix(key), kind="stable")))  # which nodes reach higher layers
    layers = build(unit(_matrix(table["vector"])).astype(np.float32))
    flat, at = [], [0]
    for node in range(table.num_rows):
        own = [links[node] for links in layers if node < len(links)]
        flat += own
        at.append(at[-1] + sum(map(len, own)))
    links = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat)))
    return table.select(["dim", "shard"]).append_column("node", pa.array(np.arange(table.num_rows), pa.int32())) \
        .append_column("ids", table["ids"]).append_column("vector", table["vector"]).append_column("links", links)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of rows with an id and a finite vector that is not null, empty or zero."""
    vector = F.col("embedding").cast("array<double>")
    fine = "vec_id IS NOT NULL AND forall(vector, x -> coalesce(abs(x) < double('Infinity') AND NOT isnan(x), false))"
    some = "exists(vector, x -> x <> 0)"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(fine).where(some)
    return rows.withColumn("vector", F.expr("transform(vector, x -> x + 0D)")).distinct()  # -0.0 to 0.0


def build_index(rows: DataFrame, best: int = BEST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs over all usable rows, as a written table of nodes.

    A node stands for all rows of one vector and keeps their ``best`` + 1 smallest ids.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    # Spark cuts each class to these ids before the exchange and again after it.
    least = usable(rows).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= best + 1)
    classes = least.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.withColumn("key", F.xxhash64("vector")).withColumn("dim", F.size("vector")), "classes")
    count = max(1, -(-classes.count() // shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.shiftright("key", 16), F.lit(count)).cast("int"))
    nodes = dealt.select("dim", "shard", "key", "ids", "vector").groupBy("dim", "shard").applyInArrow(_index_shard, NODE)
    return stored(nodes, "graph")


def _load(rows: list[pa.RecordBatch]):
    """Ids, vectors, unit vectors and layers of a shard from its rows."""
    table = pa.Table.from_batches(rows).sort_by("node")
    exact = _matrix(table["vector"])
    sizes = layer_sizes(len(exact))
    links = table["links"].combine_chunks()
    flat, at = links.flatten().to_numpy(), links.offsets.to_numpy()
    layers, done = [], 0
    for level, size in enumerate(sizes):
        wide = LINKS * (2 if level == 0 else 1)
        layers.append(flat[at[:size, None] + np.arange(done, done + wide)])
        done += wide
    return table["ids"].combine_chunks(), exact, unit(exact).astype(np.float32), layers


def _answer(best: int, width: int):
    """Rows of a shard's nodes, followed by the queries for it, to the best of the shard."""

    def answers(shard, queries: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, exact, units, layers = shard
        norms = None
        for at in range(0, len(queries), BATCH):
            wanted, own = queries[at:at + BATCH], unit(vectors[at:at + BATCH])
            nodes, _ = search(units, layers, own.astype(np.float32), width)
            out: tuple[list, list, list] = [], [], []
            for query, vector, found in zip(wanted.tolist(), own, nodes):
                found = found[found >= 0][:4 * best + 8]
                score = unit(exact[found]) @ vector
                hits = [(-s, i) for s, node in zip(score.tolist(), found.tolist()) for i in ids[node].as_py() if i != query]
                for s, i in sorted(hits)[:best]:
                    out[0].append(query)
                    out[1].append(i)
                    out[2].append(-s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, name = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "part", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                piece, kind = batch.slice(a, b - a), keys[a, 3]
                if tuple(keys[a, :3]) != name:
                    held, shard, name = [], None, tuple(keys[a, :3])
                if kind == 0:
                    held.append(piece.select(["node", "ids", "vector", "links"]))
                elif held or shard:
                    if shard is None:
                        shard, held = _load(held), []
                    yield from answers(shard, piece.column("query").to_numpy(), _matrix(piece.column("vector")))

    return answer


def nearest(rows: DataFrame, best: int = BEST, every: int = EVERY, shard_rows: int = SHARD_ROWS,
            width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for the ids divisible by ``every``.

    Nearness is the cosine in double precision, ties go to the smaller vec_id.  A null,
    empty or zero vector, one with a null or non-finite component, and a row without id
    take no part.  Rows that repeat id and vector count once; a row is never its own
    query's neighbour, nor is another vector under the same id.  Vectors of different
    length are not compared.  Other columns are not looked at.
    """
    index = build_index(rows, best, shard_rows)
    queries = usable(rows).where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("dim", F.size("vector"))
    queries = stored(queries, "queries")
    shards = index.groupBy("dim", "shard").agg(F.count("*").alias("size"))
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    # One row for each shard; a query goes to every shard of its length.
    names = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = queries.join(names, "dim").select(
        "dim", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), F.col("vec_id").alias("query"), F.lit(None).cast("int").alias("node"),
        F.lit(None).cast("array<long>").alias("ids"), "vector", F.lit(None).cast("array<int>").alias("links"))
    nodes = index.select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("query"), "node", "ids", "vector", "links")
    key = ["dim", "shard", "part"]
    met = nodes.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind")
    hits = met.mapInArrow(_answer(best, width), HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("query_id", "rank", "vec_id", "score")
