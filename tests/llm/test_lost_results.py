"""Cases that were once lost: relative targets, counts of batches, wrapped notices, rests of runs."""

from __future__ import annotations

import random
import re
import string
import urllib.parse
from re import _constants as sre
from re import _parser

from pyspark.sql import functions as F

from thinset.llm import dedup, license_rules, licenses, secrets, urls
from thinset.workspace import new_path

TARGETS = ["/abs", "page.html", "../z", "../../../z", "./a/./b/../c?x=/../y#f", "..", ".", "?id=3", "?u=http://k/", "#top",
           "//other.org/x", "https://full.org/a/../b", "/a/./b/..", "x?../y", "..a/.b"]
PLACES = ["https://h.org/d/e/f.html?q=1#w", "http://h.org", "https://h.org/d/", "ftp://u@h.org:81/a/b/c/d"]


def test_targets(spark):
    rows = [(p, t) for p in PLACES for t in TARGETS] + [(None, "x"), ("no scheme", "x"), (PLACES[0], "mailto:a@b"), (PLACES[0], None),
                                                         (PLACES[0], "a//b")]
    frame = spark.createDataFrame(rows, "base string, target string")
    got = [r[0] for r in frame.select(urls.resolved(F.col("base"), F.col("target"))).collect()]
    # RFC 3986 keeps an empty segment, which urljoin drops.
    assert got[-5:] == [None] * 4 + ["https://h.org/d/e/a//b"]
    for (place, target), found in zip(rows, got[:-5]):
        if target.startswith("https:"):
            assert found == target
        else:  # an empty path is the root here
            page = place + "/" if place == PLACES[1] else place
            assert found == urllib.parse.urljoin(page, target), (place, target)


ALIASES = [("", "b.html", "https://x0.net/d/b.html"), ("", "../c", "https://x1.net/c"), ("", "?p=1", "https://x2.net/d/a?p=1"),
           ('<base href="https://y.net/k/">', "b", "https://y.net/k/b"), ('<base href="k/">', "b", "https://x4.net/d/k/b")]


def test_aliases(spark):
    """Each form of a target carries a verdict from one page to the other."""
    rows, rules = [], []
    for i, (head, target, other) in enumerate(ALIASES):
        rows += [(2 * i, f"https://x{i}.net/d/a", f'<head>{head}<link rel="canonical" href="{target}"></head>'), (2 * i + 1, other, None)]
        host, path = other.split("://")[1].split("/", 1)
        if "?" not in path:
            rules.append((host, "/" + path, "block"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.verdict, r.url_class) for r in urls.judge_urls(pages, rules=tuple(rules)).collect()}
    for i, (_, _, other) in enumerate(ALIASES):
        assert found[2 * i] == found[2 * i + 1] and found[2 * i][0] == ("allow" if "?" in other else "block")


def test_batches(spark):
    """Counts go on over batches, a batch told again hears the same, an index opens by its path."""
    path = new_path(spark, "index")
    index = dedup.DigestIndex(spark, path, 8)
    batches = [[(10, "Same"), (11, "same"), (12, "one")], [(20, "SAME")], [(30, "same"), (31, "same"), (32, None)], [(40, "same")]]
    told = []
    for i, rows in enumerate(batches):
        if i == 3:
            index = dedup.DigestIndex(spark, path, 8)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        told.append(sorted(tuple(r)[:4] for r in index.ingest(frame, f"b{i}").collect()))
    assert told == [[(10, 11, 2, False), (11, 11, 2, True), (12, 12, 1, True)], [(20, 11, 3, False)],
                    [(30, 11, 5, False), (31, 11, 5, False), (32, 32, 1, True)], [(40, 11, 6, False)]]
    size = index.table().count()
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r)[:4] for r in index.ingest(frame, f"b{i}").collect()) == told[i]
    assert index.table().count() == size
    every = spark.createDataFrame(sum(batches, []) + [(50, "unknown")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.decisions(every).collect()} == {
        **{d: (11, 6, d == 11) for d in (10, 11, 20, 30, 31, 40)}, 12: (12, 1, True), 32: (32, 1, True)}


def _examples(tree, limit=40):
    """Strings an expression matches, each alternative and each optional part taken and left out."""
    out = [""]
    for op, value in tree:
        if op is sre.LITERAL:
            parts = [chr(value)]
        elif op is sre.ANY:
            parts = ["\n"]
        elif op is sre.NOT_LITERAL:
            parts = ["z"]
        elif op is sre.IN:
            parts = [next(c for c in "\nabcdefghijklmnopqrstuvwxyz-0123456789" if re.match(
                "[" + "".join(_char(x) for x in value) + "]", c, re.S))]
        elif op is sre.BRANCH:
            parts = [s for branch in value[1] for s in _examples(branch)]
        elif op is sre.SUBPATTERN:
            parts = _examples(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            few, many, body = value
            parts = [s * n for n in {few, min(many, few + 1)} for s in _examples(body)]
        else:  # edges
            continue
        out = [a + b for a in out for b in parts][:limit]
    return out


def _char(item):
    op, value = item
    if op is sre.NEGATE:
        return "^"
    if op is sre.RANGE:
        return f"{re.escape(chr(value[0]))}-{re.escape(chr(value[1]))}"
    if op is sre.CATEGORY:
        return {"category_digit": r"\d", "category_word": r"\w", "category_space": r"\s"}[str(value).lower()]
    return re.escape(chr(value))


def test_keywords():
    """No rule asks for a word that a match of it may lack; gaps are line breaks here.

    One names its license besides: the wording alone is used by others too.
    """
    rules = license_rules.rules()
    scanner = licenses.Scanner(rules, licenses.BASE)
    for (_, label, keyword, text), needs in zip(rules, scanner.needs):
        compiled = licenses.expression(text)
        for example in _examples(_parser.parse(compiled.pattern, compiled.flags)):
            assert compiled.fullmatch(example), (text, example)
            assert label == "postgresql" or all(word in example for word in needs), (label, needs, example)


def test_wrapped():
    scanner = licenses.Scanner(license_rules.rules(), licenses.BASE)

    def labels(text):
        return {h[2] for h in scanner.hits(text.lower())[1]}

    notice = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public"
              " License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option)"
              " any later version.\n")
    assert labels(notice) == labels(notice.replace("\n", " ")) and "gpl-2.0-or-later" in labels(notice)
    assert "etalab-2.0" in labels("sous Licence Ouverte 2.0") and "rail" in labels("an Open RAIL-M model")
    assert "proprietary" in labels("Confidential and proprietary.\nAcme 2020.\nAll rights reserved.")
    assert "apache-2.0" in labels("Apache-2.0")


def _samples(spark, rng):
    letters = string.ascii_letters + string.digits
    words = ["".join(rng.choice(["get", "user", "name", "count", "list", "order", "item", "read", "value", "index"]) for _ in range(4))
             for _ in range(4000)]
    keys = ["".join(rng.choices(letters, k=24)) for _ in range(4000)]
    return spark.createDataFrame([(w, 0) for w in words] + [(k, 1) for k in keys], "token string, label int"), letters


def test_random_runs(spark):
    """Random strings are found, identifiers are not, and plain findings are cut out of a run."""
    rng = random.Random(5)
    samples, letters = _samples(spark, rng)
    ratios = secrets.train(samples)
    made = ["".join(rng.choices(letters, k=40)) for _ in range(100)]
    plain = ["getUserNameFromOrderList", "read_value_index_count_item", "orderItemIndexValue", "listNameValueCount"]
    docs = [(i, f"see {m} here") for i, m in enumerate(made + plain)]
    rest = "".join(rng.choices(letters, k=40))
    cut = [(200, f"{rest}/token=abcdefabcdef"), (201, f"x AKIA{'Q' * 14}/{rest}"), (202, f"{rest}/{'0123456789abcdef' * 2}/{rest[::-1]}"),
           (203, "a" * 15 + "/token=abcdefabcdef"), (204, f"é {rest}=token=abcdefabcdef {rest}")]
    frame = spark.createDataFrame(docs + cut, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.kind, s.end, s.value) for s in r.spans]
             for r in secrets.find_secrets(frame, ratios).collect()}
    assert sum([(4, 3, 44, m)] == found[i] for i, m in enumerate(made)) >= 97
    assert all(found[100 + i] == [] for i in range(len(plain)))
    for doc, text in cut:
        base = [s for s in found[doc] if s[1] < 3]
        assert base and all(text[a:b].endswith(v) for a, _, b, v in found[doc])
        taken = set().union(*(range(a, b) for a, _, b, _ in base))
        free = [m for m in re.finditer("[A-Za-z0-9+/_=-]+", "".join(" " if i in taken else c for i, c in enumerate(text)))]
        assert [s for s in found[doc] if s[1] == 3] == [(m.start(), 3, m.end(), m[0]) for m in free if len(m[0]) >= 16]
