"""Coverage sampling: search the similarity threshold whose greedy cover of k
rows reaches a wanted share of the table, and return those rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, norm
from ..workspace import save, save_measured, save_ranged, small
from .cover import duplicate_cover, node_order, run_cover
from .degree import cap_degree
from .links import linked
from .similarity import EDGE, FIRST, MAX_PIVOTS, first_seen, similar_pairs

ROWS_PER_PIVOT = 20_000
SHALLOW = 2  # passes over all pairs that go no deeper than their probe
PROBE_SCHEMA = "probe int, threshold double, coverage double, picks long, covered long"


@dataclass
class CoverageResult:
    """Outcome of a search; ``threshold`` is the one whose picks are returned."""

    picks: DataFrame
    threshold: float
    coverage: float
    n_picks: int
    probes: list[tuple[float, float]] = field(default_factory=list)
    sizes: list[tuple[int, int]] = field(default_factory=list)  # picks and covered rows of each probe

    def probe_table(self) -> DataFrame:
        """One row per probe: ``probe`` (from 1), ``threshold``, ``coverage``, ``picks``, ``covered``."""
        rows = [(i, *probe, *size) for i, (probe, size) in enumerate(zip(self.probes, self.sizes), 1)]
        return self.picks.sparkSession.createDataFrame(rows, PROBE_SCHEMA)


class SimilarityGraph:
    """Edges and first-neighbour records down to some floor, written once.

    Dropping weak edges by a degree cap and by a threshold commute, so every
    probe at or above the floor only filters these two tables.  Both lie sorted by
    similarity: a probe reads the files and row groups above its threshold.
    """

    def __init__(self, vectors, floor, max_degree, label_col, id_col, vec_col, digits,
                 block_rows, pivots):
        self.floor, self.cap = floor, max_degree
        found = similar_pairs(
            vectors, floor, id_col=id_col, vec_col=vec_col, label_col=label_col,
            max_degree=max_degree, digits=digits, with_first=True,
            block_rows=block_rows, pivots=pivots,
        )
        self.edges = save_ranged(cap_degree(found.filter(F.col("kind") == EDGE), max_degree), "sim")
        self.firsts = save_ranged(found.filter(F.col("kind") == FIRST).drop("kind"), "sim")

    def cover(self, nodes: DataFrame, n: int, largest: int | None, theta: float, k: int):
        order = save(node_order(nodes, first_seen(self.firsts, theta), n))
        edges = self.edges.filter(F.col("sim") >= theta)
        return run_cover(edges, nodes, k, order, n, self.cap, largest), edges


def unit_key(vec_col: str, id_col: str):
    """Direction of a vector, rounded so that copies compare equal.

    A zero vector is similar to nothing, not even another one: its key is its id.
    """
    return F.when(norm(vec_col) > 0, _direction(vec_col)), F.when(norm(vec_col) == 0, F.col(id_col))


def _direction(vec_col: str):
    return let(
        F.struct(F.col(vec_col).alias("x"), norm(vec_col).alias("n")),
        lambda v: F.transform(
            v["x"],
            lambda x: F.round(x.cast("double") / F.when(v["n"] == 0, 1.0).otherwise(v["n"]), 9)
            + F.lit(0.0),
        ),
    )


def coverage_search(
    vectors: DataFrame, k: int, coverage: float = 0.9, *, label_col: str | None = None,
    sim_lb: int = 707, max_degree: int | None = None, id_col: str = "row_id",
    vec_col: str = "embedding", epsilon: float | None = None, digits: int | None = None,
    block_rows: int | None = None, pivots: int | None = None,
) -> CoverageResult:
    """Bisect the threshold (in thousandths) until the cover of ``k`` picks comes
    within ``epsilon`` (default 50/n) of ``coverage``.

    The last probe's picks are returned.  At least one probe is always made.
    """
    nodes = vectors.select(F.col(id_col).cast("long").alias("id"))
    largest = None
    if label_col:
        nodes = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("grp"))
        n, largest = nodes.groupBy("grp").count().agg(F.sum("count"), F.max("count")).first()
    else:
        n = nodes.count()
    if not n or k <= 0:
        raise ValueError("coverage search needs rows and a positive k")
    if coverage < k / n:
        keyed = vectors.select(F.col(id_col).alias("row_id"), F.struct(*[
            part.alias(name) for name, part in zip(("way", "own"), unit_key(vec_col, id_col))]).alias("_dir"))
        picks, seen = save_measured(
            duplicate_cover(keyed, ["_dir"], k), rows=F.count("*"), covered=F.sum("gain")
        )
        share = (seen["covered"] or 0) / n
        return CoverageResult(picks, 1.0, share, seen["rows"], [(1.0, share)],
                              [(seen["rows"], seen["covered"] or 0)])

    slack = 50 / n if epsilon is None else epsilon
    cap = int(max_degree) if max_degree else int(2 * n * coverage / k)
    cells = min(MAX_PIVOTS, n // ROWS_PER_PIVOT) if pivots is None else pivots
    low, high, probe = sim_lb, 1000, (1000 + sim_lb) / 2
    graph, passes, probes, sizes = None, 0, [], []
    # Links that are too many to store are computed for each probe.
    links = linked(vectors, k, id_col=id_col, vec_col=vec_col, label_col=label_col, digits=digits,
                   cap=cap, n=n, largest=largest)
    while True:
        theta = probe / 1000
        if not links and (graph is None or theta < graph.floor):
            # The first passes are only as deep as their probe needs; should the search
            # go lower still, one more covers all thresholds it can ask for.
            floor = theta if passes < SHALLOW else sim_lb / 1000
            passes += 1
            graph = SimilarityGraph(
                vectors, floor, cap, label_col, id_col, vec_col, digits, block_rows, cells
            )
        cover, edges = (links.cover(theta, k, cap), None) if links else graph.cover(nodes, n, largest, theta, k)
        seen = cover.totals()
        reached = seen["covered"] / n
        probes.append((theta, reached))
        sizes.append((seen["picks"], seen["covered"]))
        enough = reached >= coverage
        low, high = (probe, high) if enough else (low, probe)
        # Full coverage with picks to spare never ends the search: it goes on stricter.
        spare = enough and coverage == 1.0 and seen["picks"] < k
        judged = 0.0 if spare else reached
        if abs(judged - coverage) <= slack or high - low <= 1:
            return CoverageResult(cover.picks(edges), theta, judged, seen["picks"], probes, sizes)
        probe = (high + low) / 2


def sample_acs(
    df: DataFrame, k: int, embeddings: DataFrame | None = None, label_col: str | None = "label",
    coverage: float = 0.9, sim_lb: int = 0, max_degree: int | None = None,
    id_col: str = "row_id", vec_col: str = "embedding", **search,
) -> DataFrame:
    """At most ``k`` rows whose similarity neighbourhoods cover the table.

    Vectors come from ``embeddings`` (joined by id) or from ``df`` itself.
    ``label_col=None`` lets rows of different labels cover each other.
    """
    source = df
    if embeddings is not None:
        names = [id_col] + ([label_col] if label_col else [])
        source = df.select(*names).join(embeddings.select(id_col, vec_col), id_col)
        source = save(source)
    n = source.count()
    if k > n:
        return df
    cap = max_degree if max_degree else int(5 * n * coverage / k)
    found = coverage_search(
        source, k, coverage, label_col=label_col, sim_lb=sim_lb, max_degree=cap,
        id_col=id_col, vec_col=vec_col, **search,
    )
    return df.join(small(found.picks.select(F.col("id").alias(id_col)), k), id_col, "left_semi")
