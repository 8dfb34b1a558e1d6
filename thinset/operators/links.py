"""Similarity graphs told by their vectors: links are computed where they are asked for.

The pairs above a threshold grow with the square of the rows.  A cover asks little of
them: how many links a node has, the links of a few leading nodes, and how many links
each node has into a set of newly covered ones.  All three are sums over products of
stored tiles of vectors, so no pair is ever written or shuffled, and what a cover costs
besides its vectors are a few narrow numbers a row.

Rows lie sorted by (label, id) in files of the shared folder, a tile each.  The driver
holds their ids, labels and state (some 60 bytes a row; a table for which that is much
has more products than any cluster computes); tasks read the tiles they multiply.

A degree cap in id order needs no pairs either.  A node tells by one cut, the last link
it keeps, what it drops (see degree.py); a link is there if it stands before the cuts
of both its ends.  The cuts are found as there, by rounds over the nodes of the frontier.
"""

from __future__ import annotations

import math
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import new_path
from .similarity import unit_rows

# Fewer possible links than this are stored as edges, and more picks than this are made
# by the rounds over stored edges.
STORED_LINKS = 1 << 20
MOST_PICKS = 4096
# Most rows and bytes of a tile, most tiles a task holds, tasks a core for a pass over all.
TILE_ROWS = 4096
TILE_BYTES = 8 << 20
LEAST_ROWS = 256
SPAN_TILES = 24
TASKS_A_CORE = 3
# Cells of a product looked at in one go, links one task holds for its nodes, links of
# leading nodes that come to the driver, and most leading nodes.
CELLS = 1 << 19
HELD_LINKS = 1 << 21
LEADER_LINKS = 1 << 22
LEADERS = 8192

# Task functions travel by value: executors need numpy and Arrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lowest(bound: float, digits: int | None, above: bool = False) -> float:
    """The least number that is at ``bound`` (or ``above`` it) once it is rounded."""
    if digits is None:
        return float(np.nextafter(bound, np.inf)) if above else bound
    fits = (lambda x: np.round(x, digits) > bound) if above else (lambda x: np.round(x, digits) >= bound)
    low, high = bound - 2.0 * 10.0 ** -digits, bound + 2.0 * 10.0 ** -digits
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def _write_task(folder: str):
    """Write each partition (one tile, sorted) as ids, local label numbers and vectors."""

    def write(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        ids = _whole(table["id"]).to_numpy()
        group = _whole(table["grp"])
        codes = group.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.float64)
        # A null label is NaN here and so equal to nothing.
        turns = np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])]).astype(np.int64)
        vec = _whole(table["vec"])
        if vec.null_count:
            raise ValueError("null embedding")
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)
        width = flat.reshape(len(ids), -1).shape[1]
        store, root = fs.FileSystem.from_uri(folder)
        name = f"tile-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/{name}") as out:
            for part in (ids, turns, flat):
                out.write(np.ascontiguousarray(part).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(ids)]), pa.array([width]), pa.array([str(flat.dtype)]),
             _whole(table["part"])[:1], group[:1], group[-1:]],
            ["name", "rows", "width", "kind", "part", "first", "last"])

    return write


def _whole(column):
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _tile(folder: str, name: str, rows: int, width: int, kind: str):
    """Unit vectors of a stored tile."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as stream:
        raw = stream.read_at(rows * width * np.dtype(kind).itemsize, 16 * rows)
    flat = pa.array(np.frombuffer(raw, kind))
    return unit_rows(pa.FixedSizeListArray.from_arrays(flat, width)) if rows else np.zeros((0, width))


class _Reader:
    """What a task knows: where tiles lie, and the labels of all rows."""

    def __init__(self, folder, tiles, start, codes, bound, digits):
        self.folder, self.tiles, self.start, self.codes = folder, tiles, start, codes
        self.bound, self.digits = bound, digits

    def load(self, t):
        return _tile(self.folder, *self.tiles[t])

    def span(self, t):
        return int(self.start[t]), int(self.start[t + 1])

    def products(self, rows, left, cols, right, told=False):
        """(rows, which of ``cols`` they link with, the similarity of given cells), slice by slice.

        Products are made in single precision, and once more in double where its error
        leaves them undecided; all in double if the similarity of most links is ``told``.
        """
        if not len(rows) or not len(cols):
            return
        codes, others = self.codes[rows], self.codes[cols]
        mixed = codes.min() != codes.max() or others.min() != others.max() or codes[0] != others[0]
        slack = (left.shape[1] + 8) * 2.0 ** -24
        sure, hope = np.float32(self.bound + slack), np.float32(self.bound - slack)
        short = left if told else left.astype(np.float32)
        wide = right.T if told else np.ascontiguousarray(right.T, np.float32)
        height = max(1, CELLS // len(cols))
        for at in range(0, len(rows), height):
            part = slice(at, at + height)
            whole, own = short[part] @ wide, left[part]
            if told:
                hit = whole >= self.bound
            else:
                hit = whole >= sure
                r, c = _hits((whole >= hope) ^ hit)
                hit[r, c] = np.einsum("ij,ij->i", own[r], right[c]) >= self.bound
            if mixed:
                hit &= codes[part][:, None] == others[None, :]

            def similarity(r, c, whole=whole, own=own):
                return self.rounded(whole[r, c] if told else np.einsum("ij,ij->i", own[r], right[c]))

            yield rows[part], hit, similarity

    def rounded(self, sim):
        return sim if self.digits is None else np.round(sim, self.digits)


def _there(cuts, u, v, sim):
    """Do links stand before the cuts of both their ends?"""
    least, last = cuts
    keep = (sim > least[u]) | ((sim == least[u]) & (v <= last[u]))
    return keep & ((sim > least[v]) | ((sim == least[v]) & (u <= last[v])))


def _counted(hit, axis: int):
    return np.add.reduce(hit.view(np.uint8), axis=axis, dtype=np.uint32).astype(np.int32)


def _hits(hit):
    return np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))


def _count_task(shared):
    """Links of each row, and its first lower neighbour, over the pairs of two spans of tiles."""

    def count(task):
        view, cuts, with_first = shared.value
        reader = _Reader(*view)
        (i0, i1), (j0, j1) = task
        begin, middle = int(reader.start[i0]), int(reader.start[j0])
        low = np.zeros(int(reader.start[i1]) - begin, np.int32)
        high = low if i0 == j0 else np.zeros(int(reader.start[j1]) - middle, np.int32)
        first = np.full(len(high), -1, np.int64)
        close = np.zeros(len(high))
        held = [(t, reader.load(t)) for t in range(i0, i1)]
        for j in range(j0, j1):
            b, e = reader.span(j)
            right = next((m for t, m in held if t == j), None) if i0 == j0 else reader.load(j)
            for i, left in held:
                if i > j:
                    continue
                ib, ie = reader.span(i)
                # Rows are sorted by label: the rest of either tile cannot match.
                r0, r1 = ib + np.searchsorted(reader.codes[ib:ie], [reader.codes[b], reader.codes[e - 1] + 1])
                c0, c1 = b + np.searchsorted(reader.codes[b:e], [reader.codes[ib], reader.codes[ie - 1] + 1])
                cols = np.arange(c0, c1)
                others = right[c0 - b : c1 - b]
                for rows, hit, told in reader.products(
                        np.arange(r0, r1), left[r0 - ib : r1 - ib], cols, others, cuts is not None):
                    if i == j:
                        hit &= cols[None, :] > rows[:, None]
                    above, across = slice(rows[0] - begin, rows[-1] + 1 - begin), slice(c0 - middle, c1 - middle)
                    if with_first:
                        new = np.flatnonzero((first[across] < 0) & hit.any(axis=0))
                        place = hit[:, new].argmax(axis=0)
                        first[c0 - middle + new] = rows[place]
                        close[c0 - middle + new] = told(place, new)
                    if cuts is None:
                        low[above] += _counted(hit, 1)
                        high[across] += _counted(hit, 0)
                        continue
                    r, c = _hits(hit)
                    keep = _there(cuts, rows[r], cols[c], told(r, c))
                    low[above] += np.bincount(r[keep], minlength=len(rows)).astype(np.int32)
                    high[across] += np.bincount(c[keep], minlength=len(cols)).astype(np.int32)
        found = (middle, first, close) if with_first else None
        return [(begin, low)] + ([(middle, high)] if i0 != j0 else []), found

    return count


def _asked(reader, rows, asked):
    """(rows, left, asked rows, right) for a tile's ``rows`` and all ``asked`` rows of their labels."""
    t = int(np.searchsorted(reader.start, rows[0], side="right")) - 1
    left = reader.load(t)[rows - int(reader.start[t])]
    codes = reader.codes[rows]
    asked = asked[(reader.codes[asked] >= codes.min()) & (reader.codes[asked] <= codes.max())]
    tiles = np.searchsorted(reader.start, asked, side="right") - 1
    for u in np.unique(tiles):
        cols = asked[tiles == u]
        yield left, cols, reader.load(u)[cols - int(reader.start[u])]


def _lost_task(shared):
    """Number of links of each row into the asked rows."""

    def lost(rows):
        view, cuts, asked = shared.value
        reader = _Reader(*view)
        out = np.zeros(len(rows), np.int64)
        for left, cols, right in _asked(reader, rows, asked):
            at = 0
            for part, hit, told in reader.products(rows, left, cols, right, cuts is not None):
                if cuts is None:
                    if len(np.intersect1d(part, cols, assume_unique=True)):
                        hit &= part[:, None] != cols[None, :]
                    out[at : at + len(part)] += _counted(hit, 1)
                else:
                    r, c = _hits(hit)
                    keep = _there(cuts, part[r], cols[c], told(r, c)) & (part[r] != cols[c])
                    out[at : at + len(part)] += np.bincount(r[keep], minlength=len(part))
                at += len(part)
        return rows, out

    return lost


def _links_task(shared):
    """Links between rows and asked rows."""

    def links(rows):
        view, cuts, asked = shared.value
        reader = _Reader(*view)
        found = []
        for left, cols, right in _asked(reader, rows, asked):
            for part, hit, told in reader.products(rows, left, cols, right, cuts is not None):
                r, c = _hits(hit)
                u, v = part[r], cols[c]
                keep = u != v
                if cuts is not None:
                    keep &= _there(cuts, u, v, told(r, c))
                place = np.searchsorted(asked, cols).astype(np.int16)  # few values: sorting is fast
                found.append((place[c[keep]], u[keep].astype(np.int32)))
        return found

    return links


def _rank_task(shared):
    """The cap-th best link of each row that lower ends leave; -inf where there are fewer."""

    def rank(rows):
        view, cuts, cap = shared.value
        reader = _Reader(*view)
        least, last = cuts
        everything = np.arange(len(reader.codes))
        found = []
        for left, cols, right in _asked(reader, rows, everything):
            at = 0
            for part, hit, told in reader.products(rows, left, cols, right, True):
                r, c = _hits(hit)
                u, v, sim = part[r], cols[c], told(r, c)
                keep = (v > u) | ((v < u) & ((sim > least[v]) | ((sim == least[v]) & (u <= last[v]))))
                found.append((r[keep] + at, v[keep], sim[keep]))
                at += len(part)
        new, spot = np.full(len(rows), -np.inf), np.full(len(rows), -1, np.int64)
        if found:
            r, v, sim = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((v, -sim, r))
            r, v, sim = r[order], v[order], sim[order]
            start = np.searchsorted(r, np.arange(len(rows) + 1))
            full = np.flatnonzero(np.diff(start) >= cap)
            new[full], spot[full] = sim[start[full] + cap - 1], v[start[full] + cap - 1]
        return rows, new, spot

    return rank


def _touched_task(shared):
    """Rows above an asked row that gave or took a link when its cut moved."""

    def touched(rows):
        view, (least, last), (old_least, old_last), asked = shared.value
        reader = _Reader(*view)
        out = np.zeros(len(rows), bool)
        for left, cols, right in _asked(reader, rows, asked[asked < rows[-1]]):
            at = 0
            for part, hit, told in reader.products(rows, left, cols, right, True):
                r, c = _hits(hit)
                u, v, sim = part[r], cols[c], told(r, c)
                now = (sim > least[v]) | ((sim == least[v]) & (u <= last[v]))
                was = (sim > old_least[v]) | ((sim == old_least[v]) & (u <= old_last[v]))
                out[at + r[(now != was) & (v < u)]] = True
                at += len(part)
        return rows[out]

    return touched


class LinkGraph:
    """Vectors in tiles; the links at or above any threshold are computed when asked for."""

    def __init__(self, vectors: DataFrame, n: int, *, id_col: str, vec_col: str, label_col: str | None, digits: int | None):
        if not isinstance(vectors.schema[id_col].dataType, (T.LongType, T.IntegerType)):
            raise TypeError(f"{id_col} has to be a whole number")
        self.spark, self.digits = vectors.sparkSession, digits
        self.cores = self.spark.sparkContext.defaultParallelism
        label = F.col(label_col) if label_col else F.lit(0)
        rows = vectors.select(label.alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        rows = rows.filter(F.col("id").isNotNull())
        wide = vectors.select(F.size(vec_col)).first()
        most = max(LEAST_ROWS, min(TILE_ROWS, TILE_BYTES // (8 * max(1, wide[0] if wide else 1))))
        height = max(LEAST_ROWS, min(most, math.ceil(n / (2 * self.cores))))
        self.folder = new_path(self.spark, "tiles")
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root)
        kind = rows.schema["grp"].dataType.simpleString()
        tiles = (
            rows.repartitionByRange(max(1, math.ceil(n / height)), "grp", "id")
            .withColumn("part", F.spark_partition_id()).sortWithinPartitions("grp", "id")
            .mapInArrow(_write_task(self.folder),
                        f"name string, rows long, width long, kind string, part int, first {kind}, last {kind}")
            .collect()
        )
        tiles.sort(key=lambda tile: tile["part"])
        self.tiles = [(t["name"], t["rows"], t["width"], t["kind"]) for t in tiles]
        self.start = np.concatenate([[0], np.cumsum([t["rows"] for t in tiles])]).astype(np.int64)
        ids, codes, base, before = [], [], 0, None
        for t in tiles:
            with store.open_input_file(f"{root}/{t['name']}") as stream:
                named = np.frombuffer(stream.read_at(16 * t["rows"], 0), np.int64)
            ids.append(named[: t["rows"]])
            same = before is not None and before == t["first"] or before != before and t["first"] != t["first"]
            base += 0 if not codes or same else 1
            codes.append(named[t["rows"] :] + base)
            base, before = int(codes[-1][-1]), t["last"]
        self.ids, self.codes = np.concatenate(ids), np.concatenate(codes)
        self.n = len(self.ids)
        self.distinct = self.n == n == len(np.unique(self.ids))
        self.cuts: tuple[float, int, tuple] | None = None  # lowest threshold they hold for, cap, cuts
        self.rounds: list[int] = []  # nodes ranked in each round of a cap

    # ---- passes over the tiles ------------------------------------------------

    def _view(self, theta: float) -> tuple:
        return self.folder, self.tiles, self.start, self.codes, lowest(theta, self.digits), self.digits

    def _run(self, task, value, work):
        if not work:
            return
        context = self.spark.sparkContext
        shared = context.broadcast(value)
        try:
            yield from context.parallelize(work, len(work)).map(task(shared)).collect()
        finally:
            shared.destroy()

    def _dealt(self, rows: np.ndarray, most: int | None = None) -> list[np.ndarray]:
        """Rows (ascending) dealt over tasks, none across two tiles."""
        tiles = np.searchsorted(self.start, rows, side="right") - 1
        size = max(1, math.ceil(len(rows) / (TASKS_A_CORE * self.cores)))
        size = min(size, most or size)
        return [part for t in np.unique(tiles)
                for whole in [rows[tiles == t]] for part in np.array_split(whole, math.ceil(len(whole) / size))]

    def degrees(self, theta: float, cuts=None, with_first: bool = True):
        """Links of each row; and its lowest lower neighbour (or -1) with its similarity."""
        count = len(self.tiles)
        wide = max(1, min(SPAN_TILES, math.ceil(count / 4), math.ceil(count / math.sqrt(2 * TASKS_A_CORE * self.cores))))
        spans = [(t, min(t + wide, count)) for t in range(0, count, wide)]
        ends = [(self.codes[self.start[a]], self.codes[self.start[b] - 1]) for a, b in spans]
        work = [(x, y) for i, x in enumerate(spans) for j, y in enumerate(spans) if i <= j and ends[j][0] <= ends[i][1]]
        degree = np.zeros(self.n, np.int64)
        first, close = np.full(self.n, self.n, np.int64), np.zeros(self.n)
        for counts, firsts in self._run(_count_task, (self._view(theta), cuts, with_first), work):
            for begin, part in counts:
                degree[begin : begin + len(part)] += part
            if firsts:
                begin, row, sim = firsts
                here = slice(begin, begin + len(row))
                better = (row >= 0) & (row < first[here])
                first[here][better], close[here][better] = row[better], sim[better]
        return degree, np.where(first < self.n, first, -1), close

    def _lost(self, theta, cuts, rows, asked):
        out = np.zeros(self.n, np.int64)
        for part, lost in self._run(_lost_task, (self._view(theta), cuts, asked), self._dealt(rows)):
            out[part] = lost
        return out

    def _around(self, theta, cuts, rows, asked):
        """(place in ``asked``, other row) for the links of ``asked`` rows to ``rows``, by place."""
        found = [x for part in self._run(_links_task, (self._view(theta), cuts, asked), self._dealt(rows)) for x in part]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, v = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(u, kind="stable")
        return u[order], v[order]

    # ---- degree cap -----------------------------------------------------------

    def capped(self, theta: float, cap: int, degree: np.ndarray):
        """Cuts (similarity, last row) of all nodes at ``theta``; -inf and -1 where nothing is cut."""
        least, last = np.full(self.n, -np.inf), np.full(self.n, -1, np.int64)
        crowded = degree > cap
        frontier = np.flatnonzero(crowded)
        most = max(1, HELD_LINKS // int(degree.max()))
        while len(frontier):
            self.rounds.append(len(frontier))
            new, spot = least.copy(), last.copy()
            value = (self._view(theta), (least, last), cap)
            for rows, sim, at in self._run(_rank_task, value, self._dealt(frontier, most)):
                new[rows], spot[rows] = sim, at
            moved = np.flatnonzero((new != least) | (spot != last))
            old, (least, last) = (least, last), (new, spot)
            if not len(moved):
                break
            above = np.flatnonzero(crowded)
            value = (self._view(theta), (least, last), old, moved)
            found = list(self._run(_touched_task, value, self._dealt(above[above > moved[0]])))
            frontier = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.cuts = (theta, cap, (least, last))
        return least, last

    # ---- cover ----------------------------------------------------------------

    def order(self, first: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Tie-break position of every row, as in ``cover.node_order``."""
        met = first >= 0
        turn = np.where(met, self.ids[first], self.ids)
        place = np.empty(self.n, np.int64)
        place[np.lexsort((self.ids, np.where(met, -close, 0.0), met, turn))] = np.arange(self.n)
        return place

    def at(self, theta: float) -> Links:
        return Links(self, theta, *self.degrees(theta))

    def cover(self, theta: float, k: int, cap: int | None = None) -> LinkCover:
        """Greedy cover of ``k`` picks over the (capped) links at or above ``theta``."""
        # A cap and a threshold commute: cuts hold for all thresholds above theirs.
        cuts = self.cuts[2] if self.cuts is not None and self.cuts[0] <= theta and self.cuts[1] == cap else None
        degree, first, close = self.degrees(theta, cuts)
        place = self.order(first, close)
        if cap is not None and cuts is None and degree.max() > cap:
            cuts = self.capped(theta, cap, degree)
            degree = self.degrees(theta, cuts, with_first=False)[0]
        return self.picked(theta, k, cuts, degree, place)

    def picked(self, theta: float, k: int, cuts, degree: np.ndarray, place: np.ndarray) -> LinkCover:
        """Again and again the free row of most free links (ties: earliest place), with its links."""
        gain, free = degree + 1, np.ones(self.n, bool)
        picks: list[tuple[int, int]] = []
        while len(picks) < k and free.any():
            rows = np.flatnonzero(free)
            rows = rows[np.lexsort((place[rows], -gain[rows]))]
            if gain[rows[0]] == 1:  # only lone nodes are left
                picks += [(int(row), 1) for row in rows[: k - len(picks)]]
                break
            self._step(theta, cuts, k, rows, gain, free, place, picks)
        return LinkCover(self, picks)

    def _step(self, theta, cuts, k, rows, gain, free, place, picks) -> None:
        """Picks among the leading nodes until they fall behind the best node outside.

        Gains only fall, so up to there these are the picks of the whole graph.
        """
        most = max(1, min(LEADERS, int(np.searchsorted(np.cumsum(gain[rows[:LEADERS]]), LEADER_LINKS, side="right"))))
        leaders = np.sort(rows[:most])
        bar = (int(gain[rows[most]]), -int(place[rows[most]])) if most < len(rows) else (0, 0)
        open_rows = np.sort(rows)
        tail, head = self._around(theta, cuts, open_rows, leaders)
        start = np.searchsorted(tail, np.arange(len(leaders) + 1))
        now = gain[leaders].copy()
        covered: list[np.ndarray] = []
        while len(picks) < k:
            best = np.flatnonzero(now == now.max())
            best = best[place[leaders[best]].argmin()]
            node = int(leaders[best])
            if now[best] < 2 or (int(now[best]), -int(place[node])) < bar:
                break
            near = head[start[best] : start[best + 1]]
            fresh = np.append(near[free[near]], node)
            picks.append((node, len(fresh)))
            covered.append(fresh)
            free[fresh] = False
            new = np.zeros(self.n, bool)
            new[fresh] = True
            now -= np.bincount(tail[new[head]], minlength=len(leaders))
            now[~free[leaders]] = -1
        rows = open_rows[free[open_rows]]
        if covered and len(rows) and len(picks) < k:
            gain[rows] -= self._lost(theta, cuts, rows, np.sort(np.concatenate(covered)))[rows]


class Links:
    """The links of a graph at one threshold, in the place of an edge table."""

    def __init__(self, graph: LinkGraph, theta: float, degree: np.ndarray, first: np.ndarray, close: np.ndarray):
        self.graph, self.theta, self.degree, self.first, self.close = graph, theta, degree, first, close

    def first_seen(self) -> DataFrame:
        """As ``similarity.first_seen``: lowest-id neighbour and its similarity, per node that has one."""
        ids, met = self.graph.ids, self.first >= 0
        return self.graph.spark.createDataFrame(pa.table(
            {"id": ids[met], "first_a": ids[self.first[met]], "first_sim": self.close[met]}))

    def cover(self, k: int, order: DataFrame) -> LinkCover:
        """Greedy cover with the positions of ``order`` (id, ord)."""
        told = order.select("id", "ord").toArrow()
        ids, place = told["id"].to_numpy(), np.empty(self.graph.n, np.int64)
        place[np.argsort(self.graph.ids)] = told["ord"].to_numpy()[np.argsort(ids)]
        return self.graph.picked(self.theta, k, None, self.degree, place)


class LinkCover:
    """A finished cover."""

    def __init__(self, graph: LinkGraph, picks: list[tuple[int, int]]):
        self.graph, self.chosen = graph, picks

    def totals(self) -> dict:
        return {"picks": len(self.chosen), "covered": sum(gain for _, gain in self.chosen)}

    def picks(self, edges=None) -> DataFrame:
        """``(id, gain, pick_rank)``, ranks from 1."""
        rows = [(int(self.graph.ids[row]), int(gain), rank) for rank, (row, gain) in enumerate(self.chosen, 1)]
        return self.graph.spark.createDataFrame(rows, "id long, gain long, pick_rank long")


def linked(
    vectors: DataFrame, k: int, *, id_col: str, vec_col: str, label_col: str | None, digits: int | None,
    cap: int | None = None, n: int | None = None, largest: int | None = None,
) -> LinkGraph | None:
    """The graph of ``vectors`` if its links may be too many to store, for few enough picks.

    None also where ids repeat or are missing: stored edges tell how often a link counts.
    """
    if n is None:
        sizes = vectors.groupBy(*[label_col] if label_col else []).count()
        n, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    widest = min((largest or n or 1) - 1, cap or n or 0)
    if k > MOST_PICKS or (n or 0) * widest <= STORED_LINKS:
        return None
    graph = LinkGraph(vectors, n, id_col=id_col, vec_col=vec_col, label_col=label_col, digits=digits)
    return graph if graph.distinct else None
