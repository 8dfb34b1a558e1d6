import hashlib

import pytest
from pyspark.sql import functions as F

from thinset import downsample, register_sampler
from thinset.operators import sampling
from thinset.plans.experiment import size_grid
from thinset.sources import tables


def lot(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def twenty(spark):
    rows = [(i, f"Sentence {i}", 0 if i < 10 else 1) for i in range(20)]
    return spark.createDataFrame(rows, "row_id long, sentence string, label int")


def ids(df, col="row_id"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.mark.parametrize("k", [0, 1, 7, 999, 1000, 5000])
@pytest.mark.parametrize("parts", [1, 16])
def test_random_is_exact(spark, k, parts):
    want = sorted(sorted(range(1000), key=lot)[:k])
    got = ids(sampling.sample_random(spark.range(1000).repartition(parts), k, 42, "id"), "id")
    assert got == want


def quotas(sizes, k):
    total = sum(sizes.values())
    base = {key: k * c // total for key, c in sizes.items()}
    rest = sorted(sizes, key=lambda key: (-(k * sizes[key] % total), key is not None, key))
    for key in rest[: k - sum(base.values())]:
        base[key] += 1
    return base


@pytest.mark.parametrize("k", [1, 10, 333, 1000])
def test_stratified_keeps_shares(spark, k):
    # one label with a third of the rows, one rare one, and rows without a label
    label = lambda i: None if i % 10 == 9 else (7 if i % 3 == 0 else (1 if i < 30 else 2))
    rows = [(i, label(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    sizes = {}
    for _, y in rows:
        sizes[y] = sizes.get(y, 0) + 1
    want = []
    for y, q in quotas(sizes, k).items():
        want += sorted((i for i, z in rows if z == y), key=lot)[:q]
    assert ids(sampling.sample_stratified(df, k, "label", 42)) == sorted(want)
    assert len(want) == k


def test_groups_stay_whole(spark):
    df = spark.createDataFrame([(g, t) for g in range(30) for t in range(g % 4 + 1)], "g long, t int")
    got = sampling.sample_groups(df, 6, "g", 1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {
        g: g % 4 + 1 for g in sorted(range(30), key=lambda g: lot(g, 1))[:6]
    }


def test_score_and_selection(spark, twenty, tmp_path):
    ranking = spark.createDataFrame(
        [(m, r, (r * step) % 20) for m, step in (("aum", 3), ("vog", 7)) for r in range(15)],
        "method string, rank long, row_id long",
    )
    tables.write_ranking(ranking, f"{tmp_path}/sst2")
    stored = tables.read_ranking(spark, f"{tmp_path}/sst2", "vog")
    want = sorted(r * 7 % 20 for r in range(5))
    assert ids(sampling.sample_score(twenty, 5, stored)) == want
    assert ids(downsample(twenty, "score", 5, ranking_path=str(tmp_path), score_method="vog")) == want
    assert ids(downsample(twenty, "score", 5, ranking_path=str(tmp_path))) == sorted(
        r * 3 % 20 for r in range(5))
    assert sampling.sample_score(twenty, 18, stored).count() == 15  # short ranking
    assert sampling.sample_score(twenty, 21, stored).count() == 20
    tables.write_selection(
        spark.createDataFrame([("acs", 2, 4), ("acs", 2, 9), ("acs", 1, 4)],
                              "method string, k int, row_id long"), f"{tmp_path}/sel")
    assert ids(downsample(twenty, "selection", 2, selection_path=f"{tmp_path}/sel")) == [4, 9]


def test_holdout(spark):
    df = spark.range(95).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))
    train, held = sampling.holdout_split(df, 0.1)
    assert ids(held) == sorted(sorted(range(95), key=lot)[:10])
    assert sorted(ids(train) + ids(held)) == list(range(95))
    train, held = sampling.holdout_split(df, 0.1, stratify="label")
    assert {r.label: r["count"] for r in held.groupBy("label").count().collect()} == {0: 4, 1: 3, 2: 3}
    assert train.count() == 85
    assert sampling.holdout_split(df.limit(10))[1] is None


def test_shuffle_is_seeded(spark):
    got = [r.id for r in sampling.shuffle_rows(spark.range(50), 5, "id").collect()]
    assert got == sorted(range(50), key=lambda i: lot(i, 5))


# ---- the contract of the dispatcher ---------------------------------------

def test_methods(twenty):
    assert downsample(twenty, "random", 5).count() == 5
    got = downsample(twenty, "stratified", 8, seed=123)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 4, 1: 4}


def test_none_and_large_sizes_return_everything(twenty):
    assert downsample(twenty, "none").count() == 20
    assert downsample(twenty, "None").count() == 20
    assert downsample(twenty, "random", 30).count() == 20
    assert downsample(twenty, "no such method", 20).count() == 20  # size is checked first


@pytest.mark.parametrize("method,k", [("unknown", 5), ("random", None), ("random", 0), ("random", 2.0)])
def test_bad_requests(twenty, method, k):
    with pytest.raises(ValueError):
        downsample(twenty, method, k)


def test_own_sampler_and_failures(twenty):
    register_sampler("first", lambda df, k, *, start=0, **_: df.filter(F.col("row_id").between(start, start + k - 1)))
    assert ids(downsample(twenty, "first", 3, start=2)) == [2, 3, 4]

    def broken(df, k, **_):
        raise RuntimeError("no")

    def missing(df, k, **_):
        raise NotImplementedError

    register_sampler("broken", broken)
    register_sampler("missing", missing)
    with pytest.raises(RuntimeError):
        downsample(twenty, "broken", 3)
    assert downsample(twenty, "broken", 3, on_error="return_input").count() == 20
    with pytest.raises(NotImplementedError):
        downsample(twenty, "missing", 3, on_error="return_input")


def test_size_grid():
    assert size_grid(1100, 11) == list(range(100, 1101, 100))
    assert size_grid(105, 11) == [100, 100, 101, 102, 102, 102, 103, 104, 104, 104, 105]
