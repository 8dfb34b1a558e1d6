"""Benchmark passages in documents, by pigeonhole edit matching over words.

An item of n words may differ from a passage by k = min(rate * n, n // 4 - 1) word
edits.  It is cut into k + 1 pieces, of which a passage within k edits holds one
unchanged.  A document is scanned once for the hashes of all pieces; each hit names the
place where the item would stand, and Myers' bit-parallel distance on that window
decides.  The scan moves no rows.

Words are runs of letters and digits, lower-cased, so case, spacing and punctuation
never count as edits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.tables import packed, unpacked
from thinset.llm.words import ALNUM, bounds, grams, hashes, runs, texts_of

RATE = 0.2           # edits per word of an item
PIECE = 4            # words in a piece, at least (an item of fewer words is one piece)
BLOCK_BYTES = 32 << 20  # items that one scan carries
MATCH = "array<struct<item_id: long, start: long, end: long, distance: long>>"
_TYPE = pa.list_(pa.struct([(f, pa.int64()) for f in ("item_id", "start", "end", "distance")]))


def budget(words: int, rate: float = RATE) -> int:
    """Word edits allowed for an item of so many words."""
    return max(0, min(int(rate * words), words // PIECE - 1))


def pieces(words: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` spans of near-equal length that cover the words."""
    cuts = [words * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def distances(pattern: np.ndarray, text: np.ndarray) -> list[int]:
    """Least edits between the pattern and a passage ending at each text position (Myers)."""
    n = len(pattern)
    ones, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[int, int] = defaultdict(int)
    for i, symbol in enumerate(pattern.tolist()):
        at[symbol] |= 1 << i
    plus, minus, score, out = ones, 0, n, []
    for symbol in text.tolist():
        equal = at.get(symbol, 0)
        vertical = equal | minus
        equal |= ((equal & plus) + plus ^ plus)
        up = minus | ~(equal | plus) & ones
        down = plus & equal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = down | ~(vertical | up) & ones, up & vertical
        out.append(score)
    return out


class Items:
    """Pieces of a bounded block of items, grouped by length and sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.items: list[tuple[int, np.ndarray, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in rows:
            for _, data, offsets in runs(pa.array([text]), unicode=True):
                starts, ends, _ = bounds(data, offsets, ALNUM)
                words = hashes(data, starts, ends)
            if not len(words):
                continue
            k = budget(len(words), rate)
            for a, b in pieces(len(words), k + 1):
                found[b - a].append((int(grams(words[a:b], b - a)[0]), len(self.items), a))
            self.items.append((item, words, k))
        self.tables = {}
        for length, entries in found.items():
            entries.sort()
            self.tables[length] = (np.array([e[0] for e in entries], np.uint64),
                                   np.array([e[1:] for e in entries], np.int64))

    def places(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, word of the item) of every exact piece hit."""
        for length, (keys, where) in self.tables.items():
            every = grams(words, length)
            low = np.searchsorted(keys, every)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == every)
            for position in hit.tolist():
                i = int(low[position])
                while i < len(keys) and keys[i] == every[position]:
                    yield position, int(where[i, 0]), int(where[i, 1])
                    i += 1


def _scan(items: Items):
    """Adds what a block of items matches to what earlier blocks have matched."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            for row, data, offsets in runs(texts_of(batch.column(0)), unicode=True):
                starts, ends, before = bounds(data, offsets, ALNUM)
                words = hashes(data, starts, ends)
                where: dict[tuple[int, int], set[int]] = defaultdict(set)
                for position, item, inside in items.places(words):
                    doc = int(np.searchsorted(before, position, "right")) - 1
                    where[doc, item].add(position - inside)
                for (doc, item), begins in sorted(where.items()):
                    low, high = int(before[doc]), int(before[doc + 1])
                    found[row + doc] += _verify(items.items[item], words[low:high], [b - low for b in begins])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _TYPE)], ["_row", "matches"])

    return scan


def _verify(item: tuple[int, np.ndarray, int], words: np.ndarray, begins: list[int]) -> list[dict]:
    """Passages within the budget around the expected begins; the nearest of each overlap."""
    name, pattern, k = item
    windows: list[list[int]] = []
    for begin in sorted(begins):
        low, high = max(0, begin - k), min(len(words), begin + len(pattern) + k)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    out = []
    for low, high in windows:
        best = None
        for end, score in enumerate(distances(pattern, words[low:high]), low + 1):
            if score <= k and best and end - best[0] < len(pattern) and score < best[1]:
                best = out[-1] = (end, score)
            elif score <= k and (not best or end - best[0] >= len(pattern)):
                best = (end, score)
                out.append(best)
    return [{"item_id": name, "start": max(0, end - len(pattern)), "end": end, "distance": score}
            for end, score in out]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each carried by one scan of the documents."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"),
                         F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [tuple(r) for r in part.distinct().orderBy("item_id", "text").collect()]


def find_matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` packed as ``_row`` with ``matches``: item, words from/to, distance.

    A null or empty text, an item without words and an empty table match nothing.  An
    item of fewer than eight words has to stand unchanged.  Repeated documents are
    judged each; rows that repeat an item count once; an item_id with several texts
    matches by any of them.  Texts may be of any length.  ``start`` is counted back from
    ``end`` by the item's length.
    """
    rows = packed(docs).withColumn("matches", F.array().cast(MATCH))
    kind = rows.schema["_row"].dataType.simpleString()
    for block in _blocks(items):
        scan = _scan(Items(block, rate))
        rows = rows.mapInArrow(scan, f"_row {kind}, matches {MATCH}")
    return rows


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every passage found in ``docs``."""
    narrow = docs.select("doc_id", "text")
    found = find_matches(narrow, items, rate)
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.inline("matches"))


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no passage of an item."""
    found = find_matches(docs, items, rate)
    return unpacked(found.where(F.size("matches") == 0), docs.columns)
