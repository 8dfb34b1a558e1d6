"""The queries on whole tables against the plain versions, and held-out accuracy."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import brute
import pytest

import corpus_pipeline
from thinset.llm import decontaminate
from thinset.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_mixing(spark):
    docs = read(spark, "documents", "doc_id", "text", "source")
    goals = brute.mix_targets(docs)
    size = {d: len(brute.SPACE_WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    rows = QUERIES["op1_mixing"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], goals[s][0])
        assert r.target == pytest.approx(goals[s][1])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        assert len(r.moments) == (r.taken // r["size"] if r["size"] else len(r.moments))
        assert all(0 <= m <= 1 for m in r.moments) and list(r.moments) == sorted(r.moments)
        taken[s] += r.taken
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - goals[s][1]) <= longest[s] for s in goals)
    again = QUERIES["op1_mixing"](spark, FOLDER).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_secrets(spark):
    want = {d: brute.base_secrets(t) for d, t in read(spark, "documents", "doc_id", "text")}
    rows = QUERIES["op2_secrets"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id][:4]
        assert set(filter(None, want[r.doc_id][4].split(","))) <= set(r.spans.split(","))


def test_warc(spark):
    rows = QUERIES["op3_warc"](spark, FOLDER).collect()
    assert sorted(tuple(r) for r in rows) == brute.archive_rows(read(spark, "pages", "page_id", "html"))


def test_urls(spark):
    urls = dict(read(spark, "pages", "page_id", "url"))
    rows = QUERIES["op4_urls"](spark, FOLDER).collect()
    assert len(rows) == len(urls)
    told = defaultdict(set)
    for r in rows:
        host, path, rule, verdict = brute.url_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None or r.verdict == verdict
        told[r.url_class].add(verdict)
    for r in rows:
        if r.rule is None:
            votes = told[r.url_class]
            assert r.verdict == ("allow" if "allow" in votes or "block" not in votes else "block")


def test_decontamination(spark):
    docs = dict(read(spark, "documents", "doc_id", "text"))
    items = dict(read(spark, "benchmark", "item_id", "text"))
    found = defaultdict(lambda: 99)
    for r in QUERIES["op6_decontamination"](spark, FOLDER).collect():
        found[r.doc_id, r.item_id] = min(found[r.doc_id, r.item_id], r.distance)
    want = {}
    for d in sorted(docs)[:40] + sorted({d for d, _ in found}):  # the plain version is slow
        for i, item in items.items():
            n = len(brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower()))
            best = brute.edit_passage(item, docs[d][:6000], decontaminate.budget(n))
            if best is not None:
                want[d, i] = best
    assert {k: v for k, v in found.items() if len(docs[k[0]]) <= 6000} == {
        k: v for k, v in want.items() if len(docs[k[0]]) <= 6000}
    assert set(want) <= set(found)


def test_toxicity(spark):
    """Held-out rows told apart: area under the curve, recall and precision."""
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    told = [(r.score, label[r.doc_id], r.predicted) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    toxic, other = [s for s, y, _ in told if y == 1], [s for s, y, _ in told if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in other)
    assert wins >= 0.95 * len(toxic) * len(other)
    hits, marked = sum(p for _, y, p in told if y == 1), sum(p for _, _, p in told)
    assert hits >= 0.85 * len(toxic) and hits >= 0.95 * marked


def test_licenses(spark):
    want = {d: brute.license_base(t) for d, t in read(spark, "documents", "doc_id", "text")}
    rows = QUERIES["op9_licenses"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_jaccard(spark, monkeypatch):
    """All documents by the least boundary and by whole lists, a part of them in other forms."""
    from thinset.llm import jaccard
    docs = read(spark, "documents", "doc_id", "text")
    for rows, boundary, block in ((docs, None, None), (docs[:400], 0, 2000), (docs[:400], 9, None)):
        if block:
            monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        found = jaccard.jaccard_components(frame, boundary=boundary).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(rows)


def test_pipeline(spark):
    """Each stage is held against a plain version of its decision on what it was given."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        assert docs.columns == columns
        kept[name] = before, {r.doc_id for r in docs.collect()}
    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for d, t in before.items():
        groups[(t or "").translate(brute.LOW)].append(d)
    assert after == {max(g) for g in groups.values()}
    before, after = kept["near_dedup"]
    assert after == {d for d, (_, least) in brute.components(list(before.items())).items() if d == least}
    before, after = kept["decontamination"]
    items = [t.lower() for (t,) in read(spark, "benchmark", "text")]
    for d in set(before) - after:
        text = " ".join(brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", before[d].lower()))
        assert any(" ".join(brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", i))[:30] in text for i in items)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert [r.moment for r in mix] == sorted(r.moment for r in mix)
    assert {r.doc_id for r in mix} <= after and all(0 <= r.copy < 3 for r in mix)
