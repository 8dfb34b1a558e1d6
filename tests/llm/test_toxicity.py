"""What the toxicity model counts: whole expressions of any length and alphabet."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from thinset.llm import toxicity

# Equal four-letter parts in another order; digits; letters of one class of bytes modulo 5.
EXPRESSIONS = [("xyzauvwbxyz", "xyzbuvwaxyz"), ("sh1t", "sh2t"), ("\u0430\u0430", "\u0435\u0435")]


@pytest.mark.parametrize("toxic, ordinary", EXPRESSIONS)
def test_expressions(spark, monkeypatch, toxic, ordinary):
    rows = [(i, f"filler {(toxic, ordinary)[i % 2]} text {i % 7}") for i in range(1, 201)] + [(300, None), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 201)], "doc_id long, toxic int")
    found = sorted(tuple(r) for r in toxicity.score_documents(docs, labels).collect())
    assert len(found) == len(rows)
    assert all(predicted == 1 - d % 2 for d, _, _, predicted in found if d < 300)
    if toxic == "sh1t":  # entries that are joined give the same scores, and whole rows are kept
        monkeypatch.setattr(toxicity, "FREQUENT", 20)
        assert sorted(tuple(r) for r in toxicity.score_documents(docs, labels).collect()) == found
        kept = sorted(r.doc_id for r in toxicity.reject_toxic(docs, labels).collect())
        assert kept == sorted(d for d, _, _, predicted in found if not predicted)


def plain_ratios(texts):
    """{(word,) or (before, word): log ratio} of one model, from the definition; ``texts`` are (words, label)."""
    n, places = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
    for words, label in texts:
        for before, word in zip(["^", *words], words):
            n[label][before, word] += 1
            places[label][word].add(before)
    D, S, M = toxicity.DISCOUNT, toxicity.SHARED, toxicity.MIXED
    vocabulary = set(places[0]) | set(places[1])
    both = {w: len(places[0][w] | places[1][w]) for w in vocabulary}
    k = [{w: len(places[c][w]) for w in vocabulary} for c in (0, 1)]
    total = sum(both.values())
    shared = {w: (max(both[w] - S, 0) + sum(min(v, S) for v in both.values()) / (len(both) + 1)) / total for w in vocabulary}
    p = [{w: (max(k[c][w] - D, 0) + sum(min(v, D) for v in k[c].values()) * shared[w]) / sum(k[c].values())
          for w in vocabulary} for c in (0, 1)]
    out = {(w,): math.log(p[1][w] / p[0][w]) if max(k[0][w], k[1][w]) > D else 0.0 for w in vocabulary}
    for before, word in set(n[0]) | set(n[1]):
        here = [[v for (h, _), v in n[c].items() if h == before] for c in (0, 1)]
        pooled = Counter()
        for c in (0, 1):
            for (h, w), v in n[c].items():
                if h == before:
                    pooled[w] += v
        x = (max(pooled[word] - S, 0) + sum(min(v, S) for v in pooled.values()) * shared[word]) / sum(pooled.values())
        if max(n[0][before, word], n[1][before, word]) > D:
            q = [(max(n[c][before, word] - D, 0) + (sum(min(v, D) for v in here[c]) + M) * x * p[c][word] / shared[word])
                 / (sum(here[c]) + M) for c in (0, 1)]
            out[before, word] = math.log(q[1] / q[0]) - out[word,]
    return {g: v for g, v in out.items() if abs(v) > 1e-6}


def test_ratios_follow_the_definition(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = [(rng.choices(words, weights=[3 + (i if label else 12 - i) for i in range(12)], k=rng.randrange(1, 25)), part, label)
             for part in (0, 1) for label in (0, 0, 1) for _ in range(12)]
    rows = spark.createDataFrame([(" ".join(w), 2 * part + label) for w, part, label in texts], "text string, kind int")
    found = toxicity.log_ratios(toxicity.count_pairs(rows)).collect()
    (_, word, history, _), = toxicity._words(pa.array([" ".join(f"{w} x" for w in words)]))
    code = dict(zip(words, word[::2]))
    code["^"] = np.uint64(toxicity._START)
    name = lambda g: int(toxicity._key(code[g[0]] if len(g) == 2 else toxicity._WORD, np.array([code[g[-1]]]))[0])
    early = {name(g): v for g, v in plain_ratios([(w, c) for w, part, c in texts if part == 0]).items()}
    late = {name(g): v for g, v in plain_ratios([(w, c) for w, _, c in texts]).items()}
    assert len(late) > 30 and {r.key for r in found} == set(early) | set(late)
    for r in found:
        assert r.early / toxicity.SCALE == pytest.approx(early.get(r.key, 0.0), abs=1e-6)
        assert r.late / toxicity.SCALE == pytest.approx(late.get(r.key, 0.0), abs=1e-6)


@pytest.mark.parametrize("frequent", [0, 15, 10**6])
def test_features(spark, frequent):
    """Sums and strongest words of texts, entries looked up or joined, equal rows once with their copies."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(10)]
    (_, word, _, _), = toxicity._words(pa.array([" ".join(words)]))
    code = dict(zip(words, word))
    value = {(w,): rng.randrange(-50, 90) for w in words[:7]}
    value.update({(a, b): rng.randrange(-50, 90) for a in words[:5] for b in words[3:] if rng.random() < 0.5})
    key = lambda g: int(toxicity._key(code[g[0]] if len(g) == 2 else toxicity._WORD, np.array([code[g[-1]]]))[0])
    ratios = spark.createDataFrame([(key(g), rng.randrange(1, 40), v) for g, v in value.items()], "key long, n long, value long")
    texts = [(i % 17, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)] + [(None, None), (99, ""), (99, "")]
    texts += texts[:3]
    model = toxicity.Model(ratios, frequent=frequent)
    assert (model.others is None) == (frequent == 10**6)
    got = sorted(((r.id, r.copies, r.total, list(r.top)) for r in model.sums(
        spark.createDataFrame(texts, "id long, text string")).collect() for _ in range(r.copies)), key=str)
    want = []
    for i, text in texts:
        each = (text or "").split()
        v = [value.get((w,), 0) + value.get((b, w), 0) for b, w in zip([None, *each], each)]
        copies = texts.count((i, text)) if frequent < 10**6 else 1
        want.append((i, copies, sum(v), sorted(v, reverse=True)[:toxicity.TOP]))
    assert got == sorted(want, key=str)
