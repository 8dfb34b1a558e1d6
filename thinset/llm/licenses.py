"""License scan by ordered signature rules.

A text is searched once for the keywords of all rules (Aho-Corasick); only rules whose
keyword occurs are tried.  Of the hits, one that lies inside a hit of the same or an
earlier rule tier is suppressed; equal places go to the earlier rule.  Phrases the
caller names as ``base`` are always reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.license_rules import rules
from thinset.llm.words import ALNUM, bounds, runs

CONFIDENCE = (1.0, 0.95, 0.9, 0.8, 0.7, 0.3)  # by tier; a base phrase has 0.9
BASE = {"gnu general public license": "gpl", "apache license": "apache",
        "cc by": "cc-by", "mit license": "mit"}
_GAP, _EDGE = "[\x00-/:-`{-\x7f]+", "[^\x00-/:-`{-\x7f]"
HIT = "array<struct<start: long, end: long, label: string, tier: int, rule: int>>"
_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                           ("tier", pa.int32()), ("rule", pa.int32())]))


def expression(text: str) -> re.Pattern:
    """A rule's expression with its short forms spelled out."""
    text = text.replace("LIC", "licen[cs]e").replace(" ", f"(?:{_GAP})")
    return re.compile(f"(?<!{_EDGE})(?:{text})(?!{_EDGE})", re.S)


def required(keyword: str, text: str) -> set[str]:
    """Words every match of a rule holds: the keyword's longest word, and the beginning
    of "license" if LIC stands outside all groups (a group may be optional)."""
    while (outside := re.sub(r"\([^()]*\)\??", "", text)) != text:
        text = outside
    return {max(keyword.split(), key=len)} | ({"licen"} if "LIC" in text and "|" not in text else set())


class Scanner:
    """Compiled rules; ``hits`` gives the detections of one lower-cased text."""

    def __init__(self, table: list[tuple[int, str, str, str]], base: dict[str, str]):
        self.rules = [(tier, label, expression(text)) for tier, label, _, text in table]
        self.base = [(label, expression(re.escape(phrase).replace("\\ ", " "))) for phrase, label in base.items()]
        # Blanks of a keyword stand for any gap, so its longest word is looked for.
        self.needs = [required(keyword, text) for _, _, keyword, text in table]
        self.needs += [set(phrase.split()) for phrase in base]
        self.keywords, self.by_key = ahocorasick.Automaton(), {}
        for i, words in enumerate(self.needs):
            self.by_key.setdefault(min(words, key=lambda w: (w == "licen", -len(w), w)), []).append(i)
        for word in set().union(*self.needs):
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def hits(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """(start, end, label, tier, rule) of the base phrases, and of the rules."""
        seen = {word for _, word in self.keywords.iter(text)} if self.needs else set()
        due = sorted(i for word in seen for i in self.by_key.get(word, ()) if self.needs[i] <= seen)
        first = len(self.rules)
        base = [(*m.span(), self.base[i - first][0], 2, first - 1 - i)
                for i in due if i >= first for m in self.base[i - first][1].finditer(text)]
        found = [(*m.span(), self.rules[i][1], self.rules[i][0], i)
                 for i in due if i < first for m in self.rules[i][2].finditer(text)]
        return sorted(base), suppress(found)


def suppress(found: list[tuple]) -> list[tuple]:
    """Hits that lie in no other hit of an earlier or the same tier, by place.

    Longer hits go first within a tier, then earlier rules, so equal places keep one.
    """
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (h[3], h[0] - h[1], h[4], h[0])):
        if not any(k[0] <= hit[0] and hit[1] <= k[1] for k in kept):
            kept.append(hit)
    return sorted(kept)


def scan_licenses(docs: DataFrame, table: list[tuple[int, str, str, str]] | None = None,
                  base: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): words, base places and detections.

    (doc_id, n_words, base: [(start, end, label, tier, rule)], base_words: [first word
    of each place], found: the same structure).  Places are code points, end exclusive.
    Null and empty texts have no words and nothing found; a text may be of any length;
    repeated rows give a row each; other columns are not read; an empty table gives no
    rows.  ``table`` and ``base`` replace the rules and the phrases.
    """
    table, base = rules() if table is None else table, BASE if base is None else base
    schema = f"doc_id long, n_words long, base {HIT}, base_words array<long>, found {HIT}"

    def as_rows(hits: list[tuple]) -> list[dict]:
        return [dict(zip(("start", "end", "label", "tier", "rule"), h)) for h in hits]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, base)
        for batch in batches:
            counts, places, words, found = [], [], [], []
            for _, data, offsets in runs(batch.column(1)):
                starts, _, before = bounds(data, offsets, ALNUM)
                counts += np.diff(before).tolist()
                body = data.tobytes()
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    text = body[a:b].decode()
                    own, other = scanner.hits(text)
                    places.append(as_rows(own))
                    found.append(as_rows(other))
                    at = [a + len(text[:h[0]].encode()) for h in own]
                    words.append((np.searchsorted(starts, at) - before[row]).tolist() if own else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(places, _HIT),
                 pa.array(words, pa.list_(pa.int64())), pa.array(found, _HIT)],
                ["doc_id", "n_words", "base", "base_words", "found"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score of :func:`scan_licenses`' detections."""
    levels = F.array(*[F.lit(c) for c in CONFIDENCE])
    own = F.transform("found", lambda h: F.element_at(levels, h["tier"].cast("int") + 1))
    labels = F.array_distinct(F.concat(F.col("base.label"), F.col("found.label")))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base_words").alias("first_word"), F.array_max("base_words").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct("base.label"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(labels)).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 0.9).otherwise(0.0),
                   F.coalesce(F.array_max(own), F.lit(0.0))).alias("score"), "found")
