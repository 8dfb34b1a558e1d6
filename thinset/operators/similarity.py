"""Pairs of similar vectors, one block of rows against a stream of later ones.

Rows lie in blocks of bounded size, each a range of ids inside its label (and pivot
cell); a label with a third of all rows only has more blocks.  A task holds one block
and lets a bounded number of blocks with higher ids pass, so a pair is met by its lower
row alone, and that row's best ``D`` pairs so far are its state:

* ``EDGE`` rows - pairs at or above the floor.  With a degree cap D only the D
  strongest per lower id survive, which loses nothing: neighbours with a higher
  id cannot have dropped the edge before the lower id takes its turn, so an edge
  beaten by D of them is certain to go.  The states of a row's tasks are cut to D once
  more before they are shuffled together: at most n*D edges leave this operator.
* ``FIRST`` rows - for the tie-break order: the neighbours with a lower id that
  are more similar than every neighbour before them in their block (about the logarithm
  of a block's rows, for each block met).

Inside a task, the strongest coordinates of both blocks and the length of what they
leave bound every similarity from above (Cauchy-Schwarz); where few pairs reach the
floor or their row's worst kept pair, only those are computed in full.

Optional pivots make high floors cheaper and stay exact: rows are put into the
cell of their nearest pivot, and two cells whose rows must be further apart than
the floor's angle (triangle inequality on angles) never meet.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..workspace import save, save_measured, save_packed, small
from .sampling import lot

EDGE, FIRST = 0, 1
MAX_PIVOTS = 64
# Memory of one block of unit vectors, fewest rows worth a block, most blocks that rows
# are dealt into where memory allows, blocks that pass through a task, and cells of the
# product a task looks at in one go.
BLOCK_BYTES = 64 << 20
SMALL_BLOCK = 1024
MOST_BLOCKS = 48
PASSING = 16
SLICE_CELLS = 1 << 18
# Pairs a task holds, and rows it returns at a time.
STATE_PAIRS = 1 << 21
OUT_ROWS = 1 << 16
# Pairs a task gives out in one order of similarity.
RUN_PAIRS = 1 << 21
# Largest cap for which tasks cut links before the exchange.
FEW_LINKS = 256
# Share of the coordinates that bound a similarity, and of the pairs above which the
# whole product is cheaper than the pairs one by one.
HEAD_SHARE = 4
FEW_PAIRS = 32
AXES_SAMPLE = 1000
PAIR_SCHEMA = "kind int, a long, b long, sim double"

# Task functions travel by value: executors need numpy and Arrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unit_rows(column) -> np.ndarray:
    """Arrow list column -> matrix of unit vectors in double; zero stays zero."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(values) == 0:
        return np.zeros((0, 1))
    if values.null_count:
        raise ValueError("null embedding")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(values), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0.0, 1.0, norms)[:, None]


def _records(r: np.ndarray, c: np.ndarray, sim: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which hits (by row, in id order) are more similar than all before them in their column.

    ``best`` holds the columns' highest so far and is raised.
    """
    new = np.zeros(len(r), dtype=bool)
    cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
    for begin, end in zip(np.append(0, cuts), np.append(cuts, len(r))):
        column, shown = c[begin:end], sim[begin:end]
        higher = shown > best[column]
        new[begin:end] = higher
        best[column[higher]] = shown[higher]
    return new


class Strongest:
    """The ``cap`` best pairs of each row so far; mergeable, and bounded in memory."""

    def __init__(self, rows: int, floor: float, cap: int | None):
        self.cap, self.rows = cap, rows
        self.least = np.full(rows, floor)     # what a pair of the row has to reach
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.kept.append((row, other, sim))
        self.size += len(row)

    def cut(self) -> None:
        """Keep the best of each row (ties: lower id) and raise its bound."""
        row, other, sim = (np.concatenate(part) for part in zip(*self.kept))
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        start = np.searchsorted(row, np.arange(self.rows + 1))
        place = np.arange(len(row)) - start[row]
        best = place < self.cap
        last = place == self.cap - 1
        self.least[row[last]] = sim[last]
        self.kept = [(row[best], other[best], sim[best])]
        self.size = int(best.sum())

    def taken(self):
        """(row, other, similarity) kept so far; the bounds stay."""
        if self.cap is not None and self.kept:
            self.cut()
        out = [np.concatenate(part) for part in zip(*self.kept)] if self.kept else None
        self.kept, self.size = [], 0
        return out


class Run:
    """Pairs to be given out in order of similarity, a bounded number at a time.

    All pairs at or above a floor are many more than the rows.  Equal similarities side by
    side pack into about a byte each where they are written; in order of ids they take eight.
    """

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, low: np.ndarray, high: np.ndarray, sim: np.ndarray) -> None:
        self.pairs.append((low, high, sim))
        self.size += len(sim)

    def taken(self):
        """Bounded pieces (low, high, similarity) of all that was added."""
        if self.size:
            low, high, sim = (np.concatenate(part) for part in zip(*self.pairs))
            self.pairs, self.size = [], 0
            order = np.argsort(sim, kind="stable")
            for start in range(0, len(order), OUT_ROWS):
                part = order[start : start + OUT_ROWS]
                yield low[part], high[part], sim[part]


def _similarities(left, right, least: np.ndarray, digits: int | None):
    """(row, column, similarity) of the pairs that may reach their row's ``least``.

    ``left`` and ``right`` are pairs of matrices: whole rows, and their strongest
    coordinates with the length of the rest.
    """
    slack = (0.5 * 10.0 ** -digits if digits is not None else 0.0) + 1e-9
    rows, short = left
    others, other_short = right
    if short.shape[1] < rows.shape[1]:
        hope = short @ other_short.T >= (least - slack)[:, None]
        if np.count_nonzero(hope) * FEW_PAIRS < hope.size:
            r, c = _places(hope)
            sim = np.einsum("ij,ij->i", rows[r], others[c])
            return r, c, sim if digits is None else np.round(sim, digits)
    # Only what may reach the bound is rounded and compared with it.
    whole = rows @ others.T
    r, c = _places(whole >= (least - slack)[:, None])
    sim = whole[r, c]
    if digits is not None:
        sim = np.round(sim, digits)
    fits = sim >= least[r]
    return r[fits], c[fits], sim[fits]


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every true cell, by row."""
    return np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))


def _panel_task(floor: float, cap: int | None, digits: int | None, with_first: bool, axes: np.ndarray):
    """Rows sorted by (task, chunk, role, id): the block a task holds, then those that pass."""

    def halves(column):
        rows = unit_rows(column)[:, axes]
        head = rows[:, : max(1, rows.shape[1] // HEAD_SHARE)]
        rest = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", rows, rows) - np.einsum("ij,ij->i", head, head)))
        return rows, np.concatenate([head, rest[:, None]], axis=1)

    def table(kind, low, high, sim):
        columns = [pa.array(np.full(len(low), kind), pa.int32()), pa.array(low, pa.int64()),
                   pa.array(high, pa.int64()), pa.array(sim, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "sim"])

    def met(ids, held, state, passing, names, run):
        """Let ``passing`` rows meet the held block, a bounded number of cells at a time."""
        height = max(1, SLICE_CELLS // max(1, len(names)))
        best = np.full(len(names), -np.inf)
        for start in range(0, len(ids), height):
            part = slice(start, start + height)
            r, c, sim = _similarities(tuple(m[part] for m in held), passing, np.full(len(ids[part]), floor)
                                      if with_first else state.least[part], digits)
            fits = (sim >= floor) & (ids[part][r] < names[c])
            r, c, sim = r[fits], c[fits], sim[fits]
            if with_first:
                new = _records(r, c, sim, best)
                yield table(FIRST, ids[part][r[new]], names[c[new]], sim[new])
            if cap is None:  # nothing to choose from, so only what is put in order is held back
                run.add(ids[part][r], names[c], sim)
                if run.size >= RUN_PAIRS:
                    yield from (table(EDGE, *out) for out in run.taken())
                continue
            enough = sim >= state.least[part][r]
            state.add(r[enough] + start, names[c[enough]], sim[enough])
            if state.size > STATE_PAIRS:
                state.cut()
            if state.size > STATE_PAIRS:
                yield from flush(ids, state)

    def flush(ids, state):
        if out := state.taken():
            for start in range(0, len(out[0]), OUT_ROWS):
                row, other, sim = (part[start : start + OUT_ROWS] for part in out)
                yield table(EDGE, ids[row], other, sim)

    def multiply(batches):
        task, waiting, held, ids, state, run = None, [], None, None, None, Run()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("task", "chunk", "role")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if begin == end:
                    continue
                piece, (name, role) = batch.slice(begin, end - begin), (tuple(keys[begin, :2]), keys[begin, 2])
                if name != task:
                    if state is not None:
                        yield from flush(ids, state)
                    task, waiting, held, ids, state = name, [], None, None, None
                if role == 0:
                    waiting.append(piece)
                    continue
                if state is None:
                    if not waiting:
                        continue
                    block = pa.Table.from_batches(waiting).combine_chunks()
                    ids, held = block.column("id").to_numpy(), halves(block.column("vec"))
                    state, waiting = Strongest(len(ids), floor, cap), []
                yield from met(ids, held, state, halves(piece.column("vec")), piece.column("id").to_numpy(), run)
        if state is not None:
            yield from flush(ids, state)
        yield from (table(EDGE, *out) for out in run.taken())

    return multiply


def _placed(rows: DataFrame, floor: float, pivots: int) -> tuple[DataFrame, dict]:
    """Add cell and angle to the cell's pivot; also return which cells may meet."""
    if pivots < 2:
        return rows.withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0)), {}
    # At most MAX_PIVOTS vectors come to the driver.
    chosen = rows.orderBy(lot("pivot", "id"), "id").limit(min(pivots, MAX_PIVOTS))
    centre = np.array([row["vec"] for row in chosen.select("vec").collect()], dtype=np.float64)
    norms = np.linalg.norm(centre, axis=1, keepdims=True)
    centre = centre / np.where(norms == 0.0, 1.0, norms)

    @F.pandas_udf("cell int, angle double")
    def nearest(vec):
        import pandas as pd

        cosine = unit_rows(pa.array(vec)) @ centre.T
        cell = cosine.argmax(axis=1)
        angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle})

    apart = np.arccos(np.clip(centre @ centre.T, -1.0, 1.0))
    table = {
        (c, d): float(apart[c, d]) if c != d else 0.0
        for c in range(len(centre)) for d in range(len(centre))
    }
    return rows.withColumn("_near", nearest("vec")).select("*", "_near.*").drop("_near"), table


def _block_rows(vectors: DataFrame, vec_col: str, rows: int, block_rows: int | None) -> int:
    """Rows of a block: as many as memory allows, since every row is sent once per
    block it meets, but few enough to give all cores a block.

    A wished ``block_rows`` holds until it makes more than ``MOST_BLOCKS`` blocks: what
    is sent would grow with the square of the rows."""
    first = vectors.select(F.size(vec_col)).first()
    most = max(SMALL_BLOCK, BLOCK_BYTES // (8 * max(1, first[0] if first else 1)))
    if block_rows:
        return max(block_rows, min(most, math.ceil(rows / MOST_BLOCKS)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, max(SMALL_BLOCK, math.ceil(rows / (2 * cores)))))


def _strong_axes(rows: DataFrame) -> np.ndarray:
    """Coordinates by falling sum of squares over a bounded sample.

    Their order only decides how close the bounds come, never what is found.
    """
    sample = [row["vec"] for row in rows.select("vec").limit(AXES_SAMPLE).collect()]
    if not sample:
        return np.zeros(0, dtype=np.int64)
    return np.argsort(-np.square(np.array(sample, dtype=np.float64)).sum(axis=0), kind="stable")


def similar_pairs(
    vectors: DataFrame, floor: float, *, id_col: str = "row_id", vec_col: str = "embedding",
    label_col: str | None = None, max_degree: int | None = None, digits: int | None = None,
    with_first: bool = False, block_rows: int | None = None, pivots: int = 0,
) -> DataFrame:
    """``(kind, a, b, sim)`` with ``a < b`` for pairs with cosine >= ``floor``.

    ``label_col`` restricts pairs to equal labels (a null label matches nothing).
    ``digits`` rounds similarities before the comparison.
    """
    if not isinstance(vectors.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        raise TypeError(f"{id_col} has to be a whole number")
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(
        label.alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")
    ).filter(F.col("grp").isNotNull())
    rows, apart = _placed(rows, floor, pivots)
    n = rows.count()
    height = _block_rows(vectors, vec_col, n, block_rows)
    # A part of the range sort is a block, or several where labels or cells meet in it.
    rows = save(rows.repartitionByRange(max(1, math.ceil(n / height)), "grp", "cell", "id")
                .withColumn("part", F.spark_partition_id()))
    block = ["grp", "cell", "part"]
    blocks, seen = save_measured(
        rows.groupBy(*block).agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                 F.max("angle").alias("reach"))
        .withColumn("block", F.monotonically_increasing_id()),
        rows=F.count("*"),
    )
    few = small(blocks, seen["rows"])
    other = few.select("grp", *[F.col(c).alias(f"{c}2") for c in ("cell", "part", "block", "high", "reach")])
    meets = F.col("high2") > F.col("low")
    if apart:
        # Rounding lifts a similarity by half a unit of the last digit at most.
        lowest = floor - (0.5 * 10.0 ** -digits if digits is not None else 0.0)
        widest = math.acos(max(-1.0, min(1.0, lowest))) + 1e-6
        gap = F.create_map(*[
            item for (c, d), angle in apart.items()
            for item in (F.lit(c * MAX_PIVOTS + d), F.lit(angle))
        ])[F.col("cell") * MAX_PIVOTS + F.col("cell2")]
        meets = meets & ((F.col("cell") == F.col("cell2"))
                         | (gap - F.col("reach") - F.col("reach2") <= F.lit(widest)))
    # A row for each two blocks that meet: far fewer than there are rows to be sent.
    chunk = F.floor(F.col("part2") / PASSING)
    routes, seen = save_measured(
        blocks.join(other, "grp").filter(meets).select(
            *block, "cell2", "part2", F.col("block").alias("task"), chunk.alias("chunk")),
        rows=F.count("*"),
    )
    # Each block is held by as many tasks as it meets chunks of blocks.
    holds = small(routes.select(*block, "task", "chunk").distinct(), seen["rows"])
    passes = small(routes.select("grp", F.col("cell2").alias("cell"), F.col("part2").alias("part"), "task", "chunk"),
                   seen["rows"])
    role = lambda place, value: rows.join(place, block).select(
        "task", "chunk", F.lit(value).alias("role"), "id", "vec")
    sent = role(holds, 0).unionByName(role(passes, 1))
    work = _panel_task(floor, max_degree, digits, with_first, _strong_axes(rows))
    found = sent.repartition("task", "chunk").sortWithinPartitions("task", "chunk", "role", "id").mapInArrow(work, PAIR_SCHEMA)
    if with_first:
        found = save_packed(found)  # read once for each kind
    if max_degree is None:
        return found
    if with_first and not above(found.filter(F.col("kind") == EDGE), max_degree):
        return found  # no cut needed, and none computed for every reader
    # All but the best around the lower id are cut off on both sides of the exchange.
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    edges = found.filter(F.col("kind") == EDGE).withColumn("_place", place)
    edges = edges.filter(F.col("_place") <= max_degree).drop("_place")
    return save_packed(edges).unionByName(found.filter(F.col("kind") == FIRST)) if with_first else edges


def above(edges: DataFrame, cap: int) -> bool:
    """Is there a lower id with more than ``cap`` pairs?"""
    return bool(edges.groupBy("a").agg(F.count("*").alias("_c")).filter(F.col("_c") > cap).limit(1).count())


def cosine_edges(vectors: DataFrame, floor: float, **options) -> DataFrame:
    """Similarity graph as an edge table ``(a, b, sim)``, ``a < b``, no self-loops."""
    return similar_pairs(vectors, floor, **options).select("a", "b", "sim")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two directed rows, from one pass over the edges."""
    there = F.struct("a", "b", "sim")
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    return edges.select(F.explode(F.array(there, back)).alias("_e")).select("_e.*")


def _cut_task(cap: int, both: bool):
    """Links of a task without those that ``cap`` stronger ones around their node beat.

    Holds a bounded number of links; what is left of them is given out where a cut no
    longer makes room.
    """

    def table(a, b, sim):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    def rank(sim):
        return np.where(np.isnan(sim), np.inf, sim)  # Spark sorts NaN above all numbers

    def cut(held):
        a, b, sim = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((b, -rank(sim), a))
        a, b, sim = a[order], b[order], sim[order]
        nodes, start = np.unique(a, return_index=True)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        best, last = place < cap, place == cap - 1
        least = np.full(len(nodes), -np.inf)
        least[np.searchsorted(nodes, a[last])] = rank(sim[last])
        return [(a[best], b[best], sim[best])], int(best.sum()), (nodes, least)

    def keep(batches):
        held, size, bounds = [], 0, None
        for batch in batches:
            columns = [batch.column(name) for name in ("a", "b", "sim")]
            if any(column.null_count for column in columns):
                rows = pa.Table.from_batches([batch])
                full = pa.Table.from_batches([batch]).drop_null()
                odd = rows.filter(pc.or_(pc.is_null(rows["sim"]), pc.or_(pc.is_null(rows["a"]), pc.is_null(rows["b"]))))
                yield from odd.to_batches()
                if both:
                    yield from odd.select(["b", "a", "sim"]).rename_columns(["a", "b", "sim"]).to_batches()
                columns = [full.column(name).combine_chunks() for name in ("a", "b", "sim")]
            a, b, sim = (column.to_numpy(zero_copy_only=False) for column in columns)
            for x, y in ((a, b), (b, a)) if both else ((a, b),):
                fits = slice(None)
                if bounds is not None:
                    nodes, least = bounds
                    at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
                    fits = (nodes[at] != x) | (rank(sim) >= least[at])
                held.append((x[fits], y[fits], sim[fits]))
                size += len(held[-1][0])
            if size > STATE_PAIRS:
                held, size, bounds = cut(held)
                if size > STATE_PAIRS // 2:
                    for start in range(0, size, OUT_ROWS):
                        yield table(*(part[start : start + OUT_ROWS] for part in held[0]))
                    held, size = [], 0
        if size:
            held, size, _ = cut(held)
            for start in range(0, size, OUT_ROWS):
                yield table(*(part[start : start + OUT_ROWS] for part in held[0]))

    return keep


def strong_links(edges: DataFrame, cap: int, both: bool) -> DataFrame:
    """Links ``(a, b, sim)`` that may be among the ``cap`` strongest around ``a``.

    Every task drops what it can prove to be beaten, before anything is sorted or
    shuffled; ``both`` looks at each edge from both ends.
    """
    types = [edges.schema[name].dataType for name in ("a", "b", "sim")]
    links = edges.select("a", "b", "sim")
    if not 0 < cap <= FEW_LINKS or types != [T.LongType(), T.LongType(), T.DoubleType()]:
        return both_ways(links) if both else links
    return links.mapInArrow(_cut_task(cap, both), "a long, b long, sim double")


def first_seen(firsts: DataFrame, theta: float) -> DataFrame:
    """Lowest-id neighbour at ``theta`` and its similarity, per node that has one."""
    return (
        firsts.filter(F.col("sim") >= theta)
        .groupBy("b")
        .agg(F.min("a").alias("first_a"), F.min_by("sim", "a").alias("first_sim"))
        .withColumnRenamed("b", "id")
    )
