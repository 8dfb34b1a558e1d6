"""Periodic runs, nearest neighbours and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from thinset.llm import lexical, neighbours, repeats
from thinset.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def runs_of(words):
    """(start, length, period) of every run, period by period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        begin = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                length = i + q - begin
                if length >= max(6, 4 * q) and all(
                        any(words[j] != words[j + r] for j in range(begin, begin + length - r)) for r in range(1, q)):
                    out.append((begin, length, q))
                begin = i + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def run_row(doc_id, text):
    words = brute.SPACE_WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


@tables
def test_runs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(run_row(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000)
    whole = {r[0] for r in want}
    got = QUERIES["op11_runs"](spark, FOLDER).collect()
    assert len(got) == docs.count()
    assert sorted(tuple(r) for r in got if r.doc_id in whole) == want
    assert sum(r[1] > 0 for r in want) > 20


def test_run_finder():
    rng = random.Random(5)
    for _ in range(150):
        parts = []
        for _ in range(rng.choice([1, 4])):
            n, k = rng.choice([0, 1, 6, 30, 90]), rng.choice([1, 2, 3])
            words = [rng.randrange(k) for _ in range(n)]
            if n > 20:
                a, p = rng.randrange(n // 3), rng.randrange(1, n // 5)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                words += (words[a:a + p] * 5 + [9]) * 5
            parts.append(words)
        offsets = np.cumsum([0, *map(len, parts)])
        got = repeats.find_runs(np.array(sum(parts, []), np.int64), offsets).tolist()
        assert [tuple(r) for r in got] == [(i, *run) for i, words in enumerate(parts) for run in runs_of(words)]


def test_runs_edges(spark):
    ten = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(1, "a b " * 5000), (1, "a b " * 5000), (2, None), (3, ""), (4, " \t"), (None, "x " * 6), (5, "x x x x x"),
            (6, "É é É é É é É é"), (7, "a a a a a a a a a a a a")]
    rows += [(i, " ".join(str(j) for j in range(50))) for i in ten]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("own")).withColumn("n", F.lit(1))
    got = sorted((tuple(r) for r in repeats.run_digests(docs).drop("n_words").collect()), key=str)
    assert [r for r in got if r[0] != 1] == sorted((run_row(*r) for r in rows if r[0] != 1), key=str)
    assert [r[1:6] for r in got if r[0] == 1] == [(1, 0, 10000, 2, 5000000)] * 2
    assert repeats.run_digests(docs.limit(0)).count() == 0
    assert sum(r[0] in ten and r[1] > 0 for r in got) > 0


def cosines(rows, queries, best):
    """query -> the nearest (vec_id, score), all pairs."""
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    out = {}
    for q in queries:
        score = matrix @ matrix[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:best]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@tables
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_neighbours(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = cosines(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = QUERIES["op12_neighbours"](spark, folder).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((q, i + 1) for q in want for i in range(5))
    vectors = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v in rows}
    for r in got:
        assert r.score == pytest.approx(vectors[r.query_id] @ vectors[r.vec_id], abs=1e-12)
    found = sum(r.vec_id in dict(want[r.query_id]) for r in got)
    assert found >= 0.97 * len(got)


def test_neighbours_shards(spark):
    """Clusters of near copies and copies over several shards; the graph still finds nearly all."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 24))
    vectors[300:900] = vectors[0] + 0.02 * rng.normal(size=(600, 24))
    vectors[900:1200] = vectors[1]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    want = cosines(rows, range(0, 1500, 50), 5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, shard_rows=200).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    near = [(q, i) for q, hits in want.items() for i, _ in hits]
    assert len(got) == len(near) and sum(pair in found for pair in near) >= 0.95 * len(near)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1000] == [1, 900, 901, 902, 903]
    index = neighbours.build_index(frame, shard_rows=200)
    assert index.agg(F.sum(F.size("ids"))).first()[0] == 1200 - 1 + 6 and index.select("shard").distinct().count() == 6
    assert index.agg(F.min(F.size("links"))).first()[0] == 2 * neighbours.LINKS


def test_neighbours_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 0.0]), (50, [1e-300, 1e-300]), (8, [1e300, 1e300]), (8, [1e300, 1e300]),
            (100, [1.0, 2.0, 3.0]), (150, [0.0, 0.0]), (9, [0.0, 1.0]), (10, [-0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumn("shard", F.lit("own")).withColumn("ids", F.lit(1)).withColumn("score", F.lit("own"))
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in neighbours.nearest(frame).collect()}
    half = round(math.sqrt(0.5), 9)
    assert got == {(0, 1): (1, 1.0), (0, 2): (8, half), (0, 3): (50, half), (0, 4): (9, 0.0), (0, 5): (10, 0.0),
                   (50, 1): (8, 1.0), (50, 2): (0, half), (50, 3): (1, half), (50, 4): (9, half), (50, 5): (10, half)}
    assert neighbours.nearest(frame.limit(0)).count() == 0


def ranked(docs, items, best=10):
    """Contract of the ranked search, every document scored."""
    fold = lambda text: TERM.findall((text or "").translate(brute.LOW))
    counts = [(d, Counter(fold(text))) for d, text in docs]
    counts = [(d, c) for d, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(fold(text))
    out = []
    for item, terms in asked.items():
        hits = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) *
                        (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(hits)[:best], 1)]
    return sorted(out, key=str)


@tables
def test_lexical(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = ranked(docs, items)
    assert sorted(map(tuple, QUERIES["op13_lexical"](spark, FOLDER).collect()), key=str) == want


def test_lexical_shards(monkeypatch):
    """Shards of any size and bars carried on give the same rows; ties by id."""
    rng = np.random.default_rng(4)
    docs, width = 300, 12
    held = rng.random((docs, width)) < 0.4
    doc, term = np.nonzero(held)
    impact = rng.integers(0, 4, len(doc)) * 10
    ids = list(range(0, 2 * docs, 2))
    score = np.zeros(docs, np.int64)
    for d, t, i in zip(doc, term, impact):
        score[d] += i if t < 8 else 0
    order = [(int(d), int(score[d])) for d in np.lexsort((np.arange(docs), -score)) if score[d] > 0]
    shard = lexical.Shard(ids, term, doc, impact.astype(np.int64), width)
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    for count in (1, 7, 50, 400):
        assert shard.best(np.arange(8), count, 0) == order[:count]
    bar = order[20][1]
    assert shard.best(np.arange(8), 50, bar) == [x for x in order[:50] if x[1] >= bar]


def test_lexical_edges(spark, monkeypatch):
    rows = [(5, "Alpha beta"), (1, "alpha BETA"), (1, "alpha BETA"), (None, "alpha beta"), (2, None), (3, ""), (4, "--- !"),
            (6, "gamma " * 30000 + "delta"), (7, "ÀB àB naïve"), (8, "x1 y_2")] + [(20 + i, "alpha") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("n", F.lit("own")).withColumn("score", F.lit("own")).withColumn("terms", F.lit(0))
    asked = [(1, "alpha beta"), (1, "delta"), (2, None), (3, ""), (None, "alpha"), (4, "àB x1 2"), (5, "nowhere"), (6, "alpha")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = ranked(rows, asked)
    got = lambda: sorted(map(tuple, lexical.rank_documents(docs, items).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    assert got() == want
    assert lexical.rank_documents(docs.limit(0), items).count() == lexical.rank_documents(docs, items.limit(0)).count() == 0
