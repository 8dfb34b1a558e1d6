import numpy as np
import pytest
import sequential as seq
from pyspark.sql import functions as F

from thinset.operators import cover, coverage, degree, similarity
from thinset.operators.coverage import coverage_search, sample_acs


def clustered(n, seed, classes=3, dim=4):
    """Few whole-number coordinates: many equal similarities and equal vectors.
    Class 0 holds more than a third of the rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 4, size=(n, dim))
    labels = np.where(rng.random(n) < 0.4, 0, rng.integers(0, classes, n))
    return vectors.tolist(), labels.tolist()


def frame(spark, vectors, labels, parts=3):
    rows = [(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>, label int").repartition(parts)


def pair_set(links):
    return {(i, j): s for i, near in links.items() for j, s in near.items() if i < j}


def edge_set(df):
    return {(r.a, r.b): r.sim for r in df.select("a", "b", "sim").collect()}


def nodes_of(df, with_group=False):
    cols = [F.col("row_id").alias("id")] + ([F.col("label").alias("grp")] if with_group else [])
    return df.select(*cols)


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("block_rows,pivots", [(4096, 0), (7, 0), (9, 5)])
def test_edges_match_all_pairs(spark, labelled, block_rows, pivots):
    vectors, labels = clustered(60, 1)
    links, _ = seq.graph(seq.similarities(vectors), 0.6, labels if labelled else None)
    found = similarity.cosine_edges(
        frame(spark, vectors, labels), 0.6, label_col="label" if labelled else None, digits=6,
        block_rows=block_rows, pivots=pivots,
    )
    assert found.count() == len(pair_set(links))
    assert edge_set(found) == pair_set(links)


def test_null_labels_and_zero_vectors(spark):
    rows = [(0, [1.0, 0.0], None), (1, [1.0, 0.0], None), (2, [0.0, 0.0], 1), (3, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int")
    assert similarity.cosine_edges(df, 0.1, label_col="label").count() == 0
    assert edge_set(similarity.cosine_edges(df, 0.5)) == {(0, 1): 1.0}
    assert edge_set(similarity.cosine_edges(df, 0.0, label_col="label")) == {(2, 3): 0.0}


@pytest.mark.parametrize("limit", [1, 3, 6])
@pytest.mark.parametrize("block_rows", [4096, 8])
def test_cap_is_sequential(spark, limit, block_rows):
    vectors, labels = clustered(50, 2)
    links, _ = seq.graph(seq.similarities(vectors), 0.3)
    want = pair_set(seq.cap(links, limit))
    df = frame(spark, vectors, labels)
    pairs = similarity.similar_pairs(df, 0.3, digits=6, max_degree=limit, block_rows=block_rows)
    got = degree.cap_degree(pairs.filter(F.col("kind") == similarity.EDGE), limit)
    assert edge_set(got) == want
    # capping first and thresholding later is the same as the other way round
    tighter, _ = seq.graph(seq.similarities(vectors), 0.7)
    assert edge_set(got.filter("sim >= 0.7")) == pair_set(seq.cap(tighter, limit))
    most = degree.node_degrees(got).agg(F.max("degree")).first()[0]
    assert most <= limit
    mutual = edge_set(degree.cap_degree_mutual(pairs.filter(F.col("kind") == similarity.EDGE), limit))
    assert set(mutual) <= set(want)


@pytest.mark.parametrize("block_rows,pivots", [(7, 0), (50, 0), (9, 4)])
def test_only_the_strongest_leave(spark, monkeypatch, block_rows, pivots):
    """At most D pairs of a row, the very best ones, also when states are cut and flushed early."""
    vectors, labels = clustered(70, 8)
    links, _ = seq.graph(seq.similarities(vectors), 0.2)
    best = {}
    for a, near in links.items():
        upper = sorted((-s, b) for b, s in near.items() if b > a)[:4]
        best.update({(a, b): -s for s, b in upper})
    monkeypatch.setattr(similarity, "STATE_PAIRS", 20)
    monkeypatch.setattr(similarity, "PASSING", 2)
    pairs = similarity.similar_pairs(frame(spark, vectors, labels), 0.2, digits=6, max_degree=4,
                                     block_rows=block_rows, pivots=pivots)
    assert pairs.count() == len(best) and edge_set(pairs) == best


def test_bounds_from_strong_axes():
    """Pairs below the bound are skipped, none at or above it."""
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(300, 32)) * np.r_[np.full(4, 5.0), np.full(28, 0.3)]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    head = rows[:, :8]
    short = np.c_[head, np.sqrt(np.maximum(0, 1 - (head ** 2).sum(axis=1)))]
    least = np.full(300, 0.97)
    hope = (short @ short.T >= 0.97).mean()
    r, c, sim = similarity._similarities((rows, short), (rows, short), least, 6)
    want = np.round(rows @ rows.T, 6)
    hit = sim >= 0.97
    assert hope * similarity.FEW_PAIRS < 1
    assert set(zip(r[hit].tolist(), c[hit].tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want >= 0.97))))


def test_cap_ranks_the_frontier_only(spark):
    vectors, labels = clustered(80, 9)
    links, _ = seq.graph(seq.similarities(vectors), 0.3)
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in pair_set(links).items()], "a long, b long, sim double")
    ranked = []
    assert edge_set(degree.cap_degree(edges, 3, ranked)) == pair_set(seq.cap(links, 3))
    assert len(ranked) > 3 and ranked[-1] < ranked[0] / 4 and sum(ranked[1:]) < len(ranked[1:]) * ranked[0] / 2


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_node_order_is_first_meeting(spark, block_rows):
    vectors, labels = clustered(50, 3)
    _, order = seq.graph(seq.similarities(vectors), 0.8, labels)
    df = frame(spark, vectors, labels)
    pairs = similarity.similar_pairs(
        df, 0.5, label_col="label", digits=6, with_first=True, max_degree=2, block_rows=block_rows
    )
    firsts = similarity.first_seen(pairs.filter(F.col("kind") == similarity.FIRST), 0.8)
    for rows in (None, 50):
        placed = cover.node_order(nodes_of(df), firsts, rows).collect()
        assert [r.id for r in sorted(placed, key=lambda r: r.ord)] == order
        assert sorted(r.ord for r in placed) == list(range(50))


@pytest.mark.parametrize("form", ["rounds", "leaders", "both", "group"])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_cover_is_greedy(spark, monkeypatch, form, k):
    vectors, labels = clustered(60, 4)
    links, order = seq.graph(seq.similarities(vectors), 0.85, labels)
    want = seq.cover(links, order, k)
    if form == "rounds":
        monkeypatch.setattr(cover, "GROUP_LINKS", 0)
        monkeypatch.setattr(cover, "STALE_SHARE", 1)
    if form == "leaders":
        monkeypatch.setattr(cover, "MIN_LEADERS", 5)
        monkeypatch.setattr(cover, "FEW_SHARE", 0)
    if form == "both":
        monkeypatch.setattr(cover, "LEADER_STEPS", 1)
        monkeypatch.setattr(cover, "MIN_LEADERS", 3)
        monkeypatch.setattr(cover, "STALE_SHARE", 10**9)
    df = frame(spark, vectors, labels)
    edges = spark.createDataFrame([(a, b) for a, b in pair_set(links)], "a long, b long")
    ords = spark.createDataFrame(
        [(v, place, labels[v]) for place, v in enumerate(order)], "id long, ord long, grp int"
    )
    if form != "group":
        ords = ords.drop("grp")
    state = cover.run_cover(edges, nodes_of(df), k, ords)
    picks = sorted(state.picks(edges).collect(), key=lambda r: r.pick_rank)
    assert [(r.id, r.gain) for r in picks] == want
    assert [r.pick_rank for r in picks] == list(range(1, len(want) + 1))
    assert state.totals() == {"picks": len(want), "covered": sum(g for _, g in want)}
    chosen = {r.id for r in picks}
    assert not any(a in chosen and b in chosen for a, b in pair_set(links))


SHAPES = {
    "triangle": (3, [(0, 1), (0, 2), (1, 2)]),
    "star": (5, [(0, 4), (1, 4), (2, 4), (3, 4)]),
    "path": (4, [(0, 1), (1, 2), (2, 3)]),
    "two stars": (8, [(0, 1), (0, 2), (0, 3), (4, 5), (4, 6), (4, 7)]),
    "alone": (3, []),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_hand_made_graphs(spark, shape):
    n, pairs = SHAPES[shape]
    links = {i: {} for i in range(n)}
    for a, b in pairs:
        links[a][b] = links[b][a] = 1.0
    nodes = spark.range(n)
    edges = spark.createDataFrame(pairs, "a long, b long")
    for k in (1, 2, n):
        want = seq.cover(links, list(range(n)), k)
        got = sorted(cover.max_cover(edges, nodes, k).collect(), key=lambda r: r.pick_rank)
        assert [(r.id, r.gain) for r in got] == want


@pytest.mark.parametrize("labelled,coverage,k,limit", [
    (True, 0.9, 12, 30), (False, 0.9, 4, 30), (False, 0.6, 6, 4), (True, 1.0, 50, 40),
])
def test_search_follows_the_bisection(spark, labelled, coverage, k, limit):
    rng = np.random.default_rng(5)
    vectors, labels = rng.normal(size=(90, 5)).round(2).tolist(), rng.integers(0, 3, 90).tolist()
    sim = seq.similarities(vectors)
    probes, picks = seq.search(sim, k, coverage, limit, labels if labelled else None, slack=0.03)
    found = coverage_search(
        frame(spark, vectors, labels), k, coverage, label_col="label" if labelled else None,
        sim_lb=0, max_degree=limit, digits=6, block_rows=25, epsilon=0.03,
    )
    assert len(probes) > 1 and found.probes == probes
    got = sorted(found.picks.collect(), key=lambda r: r.pick_rank)
    assert [(r.id, r.gain) for r in got] == picks
    assert found.threshold == probes[-1][0]


def test_probes_prune_the_stored_edges(spark):
    """A probe's filter reaches the files, which hold disjoint ranges of similarity."""
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(120, 5)).tolist(), [0] * 120)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        graph = coverage.SimilarityGraph(df, 0.0, 30, None, "row_id", "embedding", 6, 40, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = graph.edges.filter("sim >= 0.5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sim,0.5)" in plan
    ranges = sorted((r.low, r.high) for r in graph.edges.groupBy(F.input_file_name()).agg(
        F.min("sim").alias("low"), F.max("sim").alias("high")).collect())
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("n", [55, 56])
def test_small_tables_make_one_probe(spark, n):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(n, 4)).round(2).tolist()
    found = coverage_search(frame(spark, vectors, [0] * n), 5, 0.9, sim_lb=0)
    assert len(found.probes) >= 1 and found.n_picks == 5


def test_duplicates_when_k_exceeds_the_target(spark):
    vectors = [[1.0, 2.0], [2.0, 4.0], [3.0, 1.0], [0.5, 1.0], [3.0, 1.0], [-1.0, 0.0]]
    found = coverage_search(frame(spark, vectors, [0] * 6), 5, 0.5)
    assert [(r.id, r.gain) for r in sorted(found.picks.collect(), key=lambda r: r.pick_rank)] == [
        (0, 3), (2, 2), (5, 1)
    ]
    assert (found.threshold, found.coverage) == (1.0, 1.0)


def test_sample_acs_is_partition_independent(spark):
    rng = np.random.default_rng(7)
    vectors, labels = rng.normal(size=(150, 6)).tolist(), rng.integers(0, 3, 150).tolist()
    results = [
        {r.row_id for r in sample_acs(frame(spark, vectors, labels, parts), 20, block_rows=size).collect()}
        for parts, size in ((1, 4096), (16, 20))
    ]
    assert results[0] == results[1] and 0 < len(results[0]) <= 20


def test_pivots_keep_rounded_pairs(spark):
    """Rounding may lift a pair to the floor; blocks that hold such pairs are not skipped."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(20, 8))
    vectors = np.repeat(base, 4, axis=0) + rng.normal(scale=2e-4, size=(80, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "row_id long, embedding array<double>")
    plain = similarity.cosine_edges(frame, 1.0, digits=6, pivots=0, block_rows=16)
    routed = similarity.cosine_edges(frame, 1.0, digits=6, pivots=60, block_rows=16)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, routed.collect())) != []


def test_zero_vectors_are_no_copies(spark):
    rows = [(i, [0.0, 0.0]) for i in range(3)] + [(3, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    way, own = coverage.unit_key("embedding", "row_id")
    keys = frame.select("row_id", way.alias("w"), own.alias("o")).collect()
    assert len({(tuple(r.w or ()), r.o) for r in keys}) == 5
