"""What keeps tasks and stored tables small must not change what is found."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sequential
from tests.llm import brute
from thinset import workspace
from thinset.llm import jaccard, urls
from thinset.operators import coverage, links, similarity
from thinset.sources import catalogues, files
from workload import queries


def vectors(spark, n, seed=3):
    rows = np.random.default_rng(seed).normal(size=(n, 6))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "row_id long, embedding array<double>")


def test_small_blocks_grow_with_the_table(spark):
    df = vectors(spark, 4)
    assert similarity._block_rows(df, "embedding", 500, 90) == 90
    assert 100_000 / similarity._block_rows(df, "embedding", 100_000, 90) <= similarity.MOST_BLOCKS


def test_uncapped_pairs_are_not_held_back(monkeypatch):
    def add(*_):
        raise AssertionError("pairs held")

    monkeypatch.setattr(similarity.Strongest, "add", add)
    flat = np.random.default_rng(1).normal(size=(8, 4))
    zero = [0] * 8
    batch = pa.RecordBatch.from_arrays(
        [pa.array(zero), pa.array(zero), pa.array([0] * 4 + [1] * 4), pa.array(list(range(8))),
         pa.array(flat.tolist())], ["task", "chunk", "role", "id", "vec"])
    found = list(similarity._panel_task(-1.0, None, 6, False, np.arange(4))([batch]))
    assert sum(map(len, found)) == 16


@pytest.mark.parametrize("both", [True, False])
def test_links_are_cut_before_the_exchange(monkeypatch, both):
    monkeypatch.setattr(similarity, "STATE_PAIRS", 300)
    made = np.random.default_rng(5)
    links = [(int(a), int(b), float(s)) for a, b, s in zip(
        made.integers(0, 6, 900), made.integers(6, 40, 900), made.integers(0, 20, 900) / 20)]
    names = ["a", "b", "sim"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links[i:i + 60])], names)
               for i in range(0, 900, 60)]
    found = [tuple(row.values()) for out in similarity._cut_task(3, both)(batches) for row in out.to_pylist()]
    assert len(found) < len(links)

    def best(rows):
        around = {}
        for a, b, s in rows:
            around.setdefault(a, []).append((-s, b))
        return {a: sorted(x)[:3] for a, x in around.items()}

    assert best(found) == best(links + [(b, a, s) for a, b, s in links] if both else links)


def test_second_pass_is_as_deep_as_its_probe(spark, monkeypatch):
    floors = []

    class Graph(coverage.SimilarityGraph):
        def __init__(self, rows, floor, *more):
            floors.append(floor)
            super().__init__(rows, floor, *more)

    monkeypatch.setattr(coverage, "SimilarityGraph", Graph)
    coverage.coverage_search(vectors(spark, 40), 12, 0.6, sim_lb=0, epsilon=0.2)
    assert floors[:2] == [0.5, 0.25] or floors == [0.5]
    coverage.coverage_search(vectors(spark, 40), 2, 0.9, sim_lb=0, epsilon=0.0)
    assert floors[-3:] == [0.5, 0.25, 0.0]


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(workspace, "PART_ROWS", 100)
    parts = workspace.dealt(spark.range(3000), "id")
    assert parts.rdd.getNumPartitions() == 30 and parts.count() == 3000


def test_blank_lines_are_counted_by_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RUN_LINES", 3)
    wanted, sentence = [], 0
    for name in ("a", "b"):
        lines = []
        for length in (2, 7, 0, 1, 4):
            for place in range(length):
                lines.append(f"{name}{length}{place} O")
                wanted.append((sentence, place, f"{name}{length}{place}"))
            lines.append("")
            sentence += 1
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        sentence += 1
    found = files.load_bio_tokens(spark, str(tmp_path))
    assert "_run" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(row)[:3] for row in found.collect()) == wanted


def test_addresses_are_stored_before_they_are_used_again(spark, monkeypatch):
    read = []
    real = urls.components
    monkeypatch.setattr(urls, "components", lambda edges: read.extend(edges.inputFiles()) or real(edges))
    pages = spark.createDataFrame(
        [(1, "http://www.a.net/x#y", ""), (2, "https://a.net/x", "")], "page_id long, url string, html string")
    rows = urls.judge_urls(pages).select("page_id", "verdict").orderBy("page_id").collect()
    assert [tuple(row) for row in rows] == [(1, "block"), (2, "block")]
    assert read and all("/aliases-" in path for path in read)


def test_prompt_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    dealt = []
    monkeypatch.setattr(catalogues, "PART_FILES", 10)
    real = catalogues.dealt
    monkeypatch.setattr(catalogues, "dealt", lambda *a: dealt.append(real(*a)) or dealt[-1])
    rows = [(i, f"S{i}", i % 2, 0.0) for i in range(90)] + [(5, "S5", 1, 0.0), (None, "none", 0, 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(
        str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(
        str(tmp_path / "nation.parquet"))
    found = queries.relation_catalogue(spark, str(tmp_path))
    assert dealt[0].rdd.getNumPartitions() >= 10
    assert len(found.inputFiles()) == 90
    got = {row.pid: (row.name, row.definition, row.example_head, row.example_tail) for row in found.collect()}
    assert got == {f"P{i}": (n, f"supplies from {n}", f"S{i}", n) for i in range(90) for n in ["AB"[i % 2]]}


def test_first_pairs_do_not_grow_with_the_slices(monkeypatch):
    flat = np.random.default_rng(2).normal(size=(60, 4))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 120), pa.array([0] * 120), pa.array([0] * 60 + [1] * 60), pa.array([*range(60)] * 2),
         pa.array(flat.tolist() * 2)], ["task", "chunk", "role", "id", "vec"])

    def found(cells):
        monkeypatch.setattr(similarity, "SLICE_CELLS", cells)
        return {tuple(row.values()) for out in similarity._panel_task(0.1, None, 6, True, np.arange(4))([batch])
                for row in out.to_pylist()}

    unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    sim = np.round(unit @ unit.T, 6)
    edges = {(0, a, b, sim[a, b]) for b in range(60) for a in range(b) if sim[a, b] >= 0.1}
    firsts = {(1, a, b, sim[a, b]) for _, a, b, _ in edges
              if all(sim[a, b] > sim[x, b] for x in range(a) if sim[x, b] >= 0.1)}
    assert found(1 << 20) == found(120) == edges | firsts


def test_pairs_of_a_cover_are_stored_once(spark, tmp_path, monkeypatch):
    stored = []
    for module in (queries, similarity):
        real = module.save_packed
        monkeypatch.setattr(module, "save_packed", lambda df, *a, real=real: stored.append(df.columns) or real(df, *a))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(4).normal(size=(30, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert queries.max_cover_unlabelled(spark, str(tmp_path)).count()
    assert stored.count(["kind", "a", "b", "sim"]) == 1


def test_frequent_shingles_reach_the_driver_as_columns(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("rows as Python objects")

    rows = [(s, n) for s, n in ((7, 3), (-5, 9), (9, 3), (7, 1), (None, None))]
    scanned = spark.createDataFrame(rows, "shingle long, seen long")
    monkeypatch.setattr(type(scanned), "toPandas", whole)
    found = jaccard._frequent(scanned)
    assert found.dtype == np.int64 and found.tolist() == [9, 7, -5]
    assert not len(jaccard._frequent(scanned.where("shingle = 0")))


@pytest.mark.parametrize("whole", [True, False])
def test_sets_outside_their_group_do_not_meet_all_of_it(spark, monkeypatch, whole):
    """Copies with four changed words link with the original, with hardly another copy and not with those of a fifth."""
    made, words = np.random.default_rng(7), [f"w{i}" for i in range(150)]

    def copy(node, changes):
        at = set((5 * made.choice(np.arange(1, 29), changes, replace=False)).tolist())
        return node, " ".join(f"c{node}x{i}" if i in at else w for i, w in enumerate(words))

    docs = [copy(d, 1) for d in range(10, 110)] + [copy(d, 4) for d in range(110, 230)] + [copy(d, 7) for d in range(230, 240)]
    docs += [(5, " ".join(words))] * whole
    seen, stored = {}, jaccard.stored

    def counted(df, name):
        out = stored(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setattr(jaccard, "SHARED", jaccard.MINIMA + 1)  # the first pass finds nothing
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), boundary=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(docs)
    if whole:
        assert seen["met"] < 10 * len(docs) and seen["gathered"] > len(docs) / 2


@pytest.mark.parametrize("labelled, cap, share, k", [(False, 6, 0.5, 10), (True, 90, 0.9, 12), (True, 1_000_000, 0.5, 4)])
def test_a_search_stores_no_pairs(spark, monkeypatch, labelled, cap, share, k):
    """The shapes of acs_picks (its cap binds), acs_sample and coverage_probes."""
    def stored(*_, **__):
        raise AssertionError("pairs stored")

    monkeypatch.setattr(links, "STORED_LINKS", 0)
    monkeypatch.setattr(links, "TILE_ROWS", 20)
    monkeypatch.setattr(links, "LEAST_ROWS", 20)
    monkeypatch.setattr(links, "LEADERS", 25)
    monkeypatch.setattr(coverage, "SimilarityGraph", stored)
    made = np.random.default_rng(9)
    flat, label = made.normal(size=(90, 5)), made.integers(0, 3, 90)
    rows = [(7 * i, x.tolist(), f"l{label[i]}") for i, x in enumerate(flat)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label string").repartition(4)
    found = coverage.coverage_search(df, k, share, label_col="label" if labelled else None, sim_lb=0, max_degree=cap,
                                     epsilon=0.04, digits=6)
    probes, picks = sequential.search(sequential.similarities(flat), k, share, cap, label if labelled else None, slack=0.04)
    assert [(t, round(c, 9)) for t, c in found.probes] == [(t, round(c, 9)) for t, c in probes]
    got = [(r.id // 7, r.gain) for r in found.picks.orderBy("pick_rank").collect()]
    assert got == [(int(node), gain) for node, gain in picks]


def test_repeated_ids_keep_their_stored_links(spark, monkeypatch):
    monkeypatch.setattr(links, "STORED_LINKS", 0)
    df = vectors(spark, 30)
    options = {"id_col": "row_id", "vec_col": "embedding", "label_col": None, "digits": 6}
    assert links.linked(df, 5, **options)
    assert links.linked(df.union(df.limit(1)), 5, **options) is None
    assert links.linked(df, links.MOST_PICKS + 1, **options) is None


@pytest.mark.parametrize("bound", [0.2, 0.0, 0.25, 0.2578125])
def test_rounded_bounds_are_exact(bound):
    least, above = links.lowest(bound, 6), links.lowest(bound, 6, above=True)
    assert np.round(least, 6) >= bound > np.round(np.nextafter(least, -1), 6)
    assert np.round(above, 6) > bound >= np.round(np.nextafter(above, -1), 6)


def test_single_precision_decides_no_link():
    """Products within the error of the bound are made in double."""
    flat = np.random.default_rng(3).normal(size=(400, 8))
    unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    whole = unit @ unit.T
    bound = float(np.sort(whole[np.triu_indices(400, 1)])[-5000])
    reader = links._Reader("", [], np.array([0, 400]), np.zeros(400, np.int64), bound, None)
    rows = np.arange(400)
    for told in (False, True):
        hit = np.concatenate([hit for _, hit, _ in reader.products(rows, unit, rows, unit, told)])
        assert np.count_nonzero(np.triu(hit, 1)) in (4999, 5000, 5001)


@pytest.mark.parametrize("label_col", [None, "label"])
def test_a_cover_stores_no_pairs(spark, tmp_path, monkeypatch, label_col):
    def stored(*_, **__):
        raise AssertionError("pairs stored")

    made = np.random.default_rng(6)
    flat, label = made.normal(size=(120, 4)).astype(np.float32), made.integers(0, 3, 120)
    flat[7] = 0.0
    label = [None if i % 11 == 0 else int(x) for i, x in enumerate(label)]
    rows = [(2 * i, x.tolist(), label[i]) for i, x in enumerate(flat)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(links, "STORED_LINKS", 0)
    monkeypatch.setattr(links, "LEAST_ROWS", 25)
    monkeypatch.setattr(similarity, "similar_pairs", stored)
    found = queries._cover(spark, str(tmp_path), 0.6, 60, label_col).orderBy("pick_rank").collect()
    apart = [-1 - i if x is None else x for i, x in enumerate(label)]
    near, order = sequential.graph(sequential.similarities(flat), 0.6, apart if label_col else None)
    assert [(r.id // 2, r.gain) for r in found] == [(int(v), gain) for v, gain in sequential.cover(near, order, 60)]


def test_sure_losses_of_a_cap_are_not_stored(spark, tmp_path, monkeypatch):
    stored, real = [], queries.save_packed
    monkeypatch.setattr(queries, "save_packed", lambda df, *a: stored.append(real(df, *a)) or stored[-1])
    flat = np.random.default_rng(8).normal(size=(60, 3)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(flat)],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {(r.a, r.b, r.sim) for r in queries.sequential_cap(spark, str(tmp_path)).collect()}
    assert stored[0].groupBy("a").count().agg(F.max("count")).first()[0] <= 5
    near, _ = sequential.graph(sequential.similarities(flat), 0.05, [i % 2 for i in range(60)])
    left = sequential.cap(near, 5)
    assert found == {(a, b, s) for a in left for b, s in left[a].items() if a < b}


def test_pairs_leave_in_order_of_similarity(monkeypatch):
    """Equal similarities lie side by side, as far as a bounded run goes."""
    monkeypatch.setattr(similarity, "RUN_PAIRS", 500)
    monkeypatch.setattr(similarity, "SLICE_CELLS", 300)
    flat = np.random.default_rng(2).normal(size=(60, 4))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 120), pa.array([0] * 120), pa.array([0] * 60 + [1] * 60), pa.array([*range(60)] * 2),
         pa.array(flat.tolist() * 2)], ["task", "chunk", "role", "id", "vec"])
    found = list(similarity._panel_task(-1.0, None, 6, False, np.arange(4))([batch]))
    assert 60 * 59 / 2 / 800 < len(found) < 6
    assert all((np.diff(out["sim"].to_numpy()) >= 0).all() for out in found)
    unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    sim = np.round(unit @ unit.T, 6)
    got = {(r["a"], r["b"], round(r["sim"], 6)) for out in found for r in out.to_pylist()}
    assert got == {(a, b, round(float(sim[a, b]), 6)) for b in range(60) for a in range(b)}
