"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import io
import itertools
import random
import zipfile
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thinset.llm import archives, chat, components, decontaminate, dedup, jaccard, licenses, mixing, secrets, toxicity, urls
from thinset.workspace import new_path

LONG = "word number one two three four five six seven eight " * 20_000
DOCS = [(1, "Alpha beta GAMMA delta epsilon zeta", "en", "a", 5), (1, "Alpha beta GAMMA delta epsilon zeta", "en", "a", 5),
        (2, "alpha beta gamma delta epsilon zeta", None, "a", 5), (3, None, "en", None, None), (4, "", None, "b", 0),
        (None, "alpha", "en", "b", 1), (None, None, None, None, None), (5, LONG, "en", "a", 1), (6, " \t\n", "en", "b", 3),
        (7, "ÀÉ ŸÜ ß İi ﬀ 中文 word", "xx", "b", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = [(1, "https://m.a.example.net/en/1?x#y", "<p>same</p>"), (2, "HTTP://A.Example.NET/fr/1", "<p>same</p>"),
         (3, None, None), (4, "no scheme", ""), (5, "x://h.org/fr/", None), (None, "https://b.example.com/de/", "<p>same</p>"),
         (6, "https://www.q.example.com/fr/9", '<link rel="canonical" href="https://b.example.com/de/">'),
         (6, "https://www.q.example.com/fr/9", '<link rel="canonical" href="https://b.example.com/de/">')]
LABELS = [(i, 1, i % 2) for i in range(1, 40)] + [(None, 1, 1), (2, None, None), (3, 0, 7), (2, 1, 1), (2, 1, 0)]
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "x"), (3, ""), (1, "beta gamma delta")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("size", "copy", "moment", "matches", "score", "_row", "key", "id", "digest"):
        docs = docs.withColumn(name, F.lit("own"))
    return {"docs": docs, "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string"),
            "labels": spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"),
            "items": spark.createDataFrame(ITEMS, "item_id long, text string")}


def test_documents(spark, tables):
    docs, labels, items = tables["docs"], tables["labels"], tables["items"]
    n = len(DOCS)
    assert mixing.plan_mix(docs).count() == n
    assert [r.size for r in mixing.plan_mix(docs).where("doc_id = 7").collect()] == [7]
    found = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    assert (found[2].component_id, found[3].n_shingles, found[6].component_id, found[5].n_shingles) == (1, 0, 6, 10)
    assert found[None].component_id is None
    assert toxicity.score_documents(docs, labels).where("score BETWEEN 0 AND 1").count() == n
    got = sorted(map(tuple, licenses.scan_licenses(docs).select(F.coalesce("doc_id", F.lit(0)), "n_words").collect()))
    assert got == sorted((d or 0, brute.license_base(t)[0]) for d, t, *_ in DOCS)
    assert secrets.find_secrets(docs, secrets.train(secrets.labelled_tokens(docs))).count() == n
    assert {tuple(r) for r in decontaminate.contaminated(docs, items).select("doc_id", "item_id").collect()} == {(1, 1), (2, 1)}


def test_index(spark, tables):
    index = dedup.DigestIndex(spark, new_path(spark, "index"))
    first = [tuple(r) for r in index.ingest(tables["docs"], "one").orderBy("doc_id", "kept").collect()]
    again = [tuple(r) for r in index.ingest(tables["docs"], "one").orderBy("doc_id", "kept").collect()]
    assert first == again and index.table().count() == 6
    kept = {(r[0], r[3]) for r in first}
    assert {(1, False), (2, True), (6, True), (4, True), (3, False), (None, True), (None, False)} <= kept
    later = index.ingest(spark.createDataFrame([(9, "ALPHA"), (10, "new")], "doc_id long, text string"), "two")
    assert {(r.doc_id, r.kept, r.group_size) for r in later.collect()} == {(9, False, 2), (10, True, 1)}
    plan = index.table().join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_stages(spark, tables, tmp_path):
    tables["labels"].write.parquet(f"{tmp_path}/labels.parquet")
    tables["items"].write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (tables["docs"], tables["docs"].limit(0), spark.createDataFrame(DOCS, SCHEMA)):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert name == "mixing" or out.columns == docs.columns
            assert len(rows) <= 3 * len(DOCS)
    kept = corpus_pipeline.drop_copies(spark, tables["docs"], "").select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([None, 2, 4, 5, 6, 7], key=str)


def test_empty(spark, tables):
    docs, pages = tables["docs"].limit(0), tables["pages"].limit(0)
    labels, items = tables["labels"].limit(0), tables["items"].limit(0)
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for frame in (mixing.plan_mix(docs), jaccard.jaccard_components(docs), toxicity.score_documents(docs, labels),
                  licenses.scan_licenses(docs), decontaminate.contaminated(docs, items), urls.judge_urls(pages),
                  archives.round_trip(pages), chat.repair_roles(turns),
                  secrets.find_secrets(docs, secrets.train(secrets.labelled_tokens(docs)))):
        assert frame.count() == 0
    assert toxicity.score_documents(tables["docs"], labels).where("score = 0.5").count() == len(DOCS)


def test_pages(spark, tables):
    rows = archives.round_trip(tables["pages"]).collect()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert len(rows) == len(PAGES)
    assert {(2, "response", None), (1, "revisit", 2), (None, "revisit", 2), (5, "response", None), (4, "revisit", 5)} <= kinds
    verdict = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge_urls(tables["pages"]).collect()}
    assert verdict[6] == ("www.q.example.com", None, "block") and verdict[3] == ("", None, "allow")
    assert verdict[2] == ("a.example.net", "net/", "block") and verdict[1] == ("m.a.example.net", "example.net/en/", "allow")


@pytest.mark.parametrize("wide", [False, True])
def test_zip(wide):
    """The writer's archives open elsewhere, and other writers' stored members are found."""
    out = io.BytesIO()
    writer = archives.ZipWriter(out, zip64=wide)
    for name, data in (("a", b"x" * 10), ("b/c", b""), ("d", b"yz")):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    with zipfile.ZipFile(out) as archive:
        assert archive.testzip() is None and archive.read("d") == b"yz"
    found = archives.members(out, len(out.getvalue()))
    assert {n: out.getvalue()[a:a + s] for n, (a, s) in found.items()} == {"a": b"x" * 10, "b/c": b"", "d": b"yz"}
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as archive:
        archive.writestr("m", b"member")
        archive.comment = b"PK\x05\x06 comment"
    (at, size), = archives.members(other, len(other.getvalue())).values()
    assert other.getvalue()[at:at + size] == b"member"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m", b"member" * 50)
    with pytest.raises(ValueError):
        archives.members(packed, len(packed.getvalue()))


def _cheapest(roles):
    """Least cost over every labelling, merge and insertion, by breadth."""
    best = {chat.START: 0}
    for role in roles:
        after = defaultdict(lambda: chat.FAR)
        for state, cost in best.items():
            for r, label in enumerate(chat.ROLES, 1):
                change = 0 if role == label else chat.RELABEL
                if state == r:
                    after[r] = min(after[r], cost + change + chat.MERGE)
                reach = [(state, 0)]
                for s, c in reach:
                    if r in chat.NEXT[s]:
                        after[r] = min(after[r], cost + c + change)
                    if c < 3 * chat.INSERT:
                        reach += [(t, c + chat.INSERT) for t in chat.NEXT[s] if t != chat.SYSTEM]
        best = after
    return min(c + (0 if s == chat.ASSISTANT else chat.INSERT if s == chat.USER else 2 * chat.INSERT) for s, c in best.items())


def test_chat(spark):
    rng, turns, convs = random.Random(7), [], {}
    for conv in range(40):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.choice([1, 2, 5, 9]))]
        convs[conv] = roles
        turns += [(conv, i, r, f"t{i}") for i, r in enumerate(roles)]
    convs[99] = [rng.choice(["user", "assistant", "system"]) for _ in range(1500)]  # spans partitions
    turns += [(99, i, r, f"t{i}") for i, r in enumerate(convs[99])]
    turns += [(None, None, None, None), (None, 1, "USER ", "x")]
    rows = chat.repair_roles(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(turns)
    cost, text = defaultdict(int), defaultdict(str)
    for r in sorted(rows, key=lambda r: r.place):
        cost[r.conv_id] += r.cost
        text[r.conv_id] += r.rendered
    for conv, roles in convs.items():
        assert cost[conv] == _cheapest(roles)
        heads = [x.split("\n")[0] for x in text[conv].split("<|im_start|>")[1:]]
        body = heads[1:] if heads[0] == "system" else heads
        assert body == ["user", "assistant"] * (len(body) // 2) and text[conv].endswith(chat.CLOSE)
        assert all(f"t{i}" in text[conv] for i in range(len(roles)))


def test_distance():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 90)), rng.integers(0, 4, rng.integers(0, 120))
        row, want = list(range(len(a) + 1)), []
        for y in b:
            new = [0]
            for i, x in enumerate(a, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
            row = new
            want.append(row[-1])
        assert decontaminate.distances(a.astype(np.uint64), b.astype(np.uint64)) == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (300, 300), (None, 5), (100, 101)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 300: 300}


def test_suppression():
    hits = [(0, 10, "a", 2, 5), (0, 10, "b", 2, 6), (2, 8, "c", 3, 7), (5, 20, "d", 3, 8), (30, 31, "e", 4, 9)]
    assert [h[2] for h in licenses.suppress(hits)] == ["a", "d", "e"]
    assert all(itertools.chain(licenses.expression(t) for _, _, _, t in licenses.rules()))
