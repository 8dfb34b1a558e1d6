"""Periodic runs of words, found on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbour extends and that
is at least ``REPEATS`` periods and ``LEAST`` words long.  The texts of a task are
handled many at a time: one suffix array over all their words (prefix doubling, a text
never compared past its end), its inverse and the LCP values of neighbours.  For every
boundary of an LCP interval of depth l, the suffixes on its smaller side look through the
inverse array whether the suffix l words on or back stands on the other side: then two
copies of l words stand in a row and the word after them ends the period (a branching
square).  The interval's own bounds tell the same way whether two more copies stand
before it.  What is left is rotated to the left as far as the period goes and merged into
one run for each stretch.  The intervals are ranges of the array; no tree is built.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEATS, LEAST = 4, 6
BATCH_BYTES, BATCH_ROWS = 1 << 20, 512  # texts handled at a time, if more than one
CHECKED = 1 << 20                       # suffixes looked at in one step
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()),
                    ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


class SuffixArray:
    """Suffixes of many word sequences, sorted within each; ``offsets`` bound the sequences.

    ``order`` lists the suffixes, ``place`` is its inverse, and ``lcp[k]`` counts the
    words that ``order[k - 1]`` and ``order[k]`` share (0 between sequences, -1 at both
    ends of the array).
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        n = len(words)
        self.words, self.sequence = words, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.first, self.end = offsets[:-1][self.sequence], offsets[1:][self.sequence]
        key = self.sequence * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        at = np.arange(n)
        rank = np.empty(n, np.int32)
        rank[self.order] = self._heads(key[self.order], at)
        levels, width = [rank.copy()], 1
        slots = self._tied(rank[self.order], at)
        while len(slots):
            here = self.order[slots]
            ahead = here + width
            inside = ahead < self.end[here]
            after = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[here].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            self.order[slots] = here = here[by]
            heads = self._heads(key[by], slots)
            rank[here] = heads
            levels.append(rank.copy())
            slots, width = self._tied(heads, slots), width * 2
        self.place = np.empty(n, np.int64)
        self.place[self.order] = at
        self.lcp = self._shared(levels)

    @staticmethod
    def _heads(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For sorted keys, the slot at which each one's ties begin."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(new, slots, 0))

    @staticmethod
    def _tied(heads: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Slots whose suffix is not told apart yet."""
        same = np.zeros(len(heads) + 1, bool)
        same[1:-1] = heads[1:] == heads[:-1]
        return slots[same[1:] | same[:-1]]

    def _shared(self, levels: list[np.ndarray]) -> np.ndarray:
        n = len(self.order)
        lcp = np.zeros(n + 1, np.int64)
        lcp[0] = lcp[-1] = -1
        k = np.flatnonzero(levels[0][self.order[1:]] == levels[0][self.order[:-1]]) + 1
        a, b = self.order[k - 1], self.order[k]
        shared = np.zeros(len(k), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank, x, y = levels[level], a + shared, b + shared
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            shared += same.astype(np.int64) << level
        lcp[k] = shared
        return lcp

    def minima(self) -> list[np.ndarray]:
        """Least of ``lcp`` over 1, 2, 4, ... values, up to the longest stretch above 0."""
        zero = np.flatnonzero(self.lcp <= 0)
        longest = int(np.diff(zero).max(initial=1))
        table = [self.lcp]
        while 1 << len(table) <= longest:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table


def _reach_left(table: list[np.ndarray], k: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Nearest boundary before each ``k`` whose value is below ``floor``."""
    at = k.copy()
    for level in range(len(table) - 1, -1, -1):
        width = 1 << level
        far = at - width
        at = np.where((far >= 0) & (table[level][np.maximum(far, 0)] >= floor), far, at)
    return at - 1


def _reach_right(table: list[np.ndarray], k: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Nearest boundary after each ``k`` whose value is below ``floor``."""
    at = k + 1
    for level in range(len(table) - 1, -1, -1):
        values = table[level]
        fits = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] >= floor)
        at = np.where(fits, at + (1 << level), at)
    return at


def _squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of branching squares that two more copies precede."""
    table = array.minima()
    depth = array.lcp[:-1]
    length = np.zeros(len(depth), np.int64)
    length[:] = (array.end - array.first)[array.order]
    k = np.flatnonzero((depth >= 1) & (REPEATS * depth <= length))
    depth = depth[k]
    left, right = _reach_left(table, k, depth + 1), _reach_right(table, k, depth)
    smaller_left = k - left <= right - k
    low, high = np.where(smaller_left, left, k), np.where(smaller_left, k, right)
    other_low, other_high = np.where(smaller_left, k, left), np.where(smaller_left, right, k)
    ends, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.cumsum(high - low)
    row = 0
    while row < len(k):
        upto = max(row + 1, int(np.searchsorted(cuts, (cuts[row - 1] if row else 0) + CHECKED, "right")))
        count = (high - low)[row:upto]
        which = np.repeat(np.arange(row, upto), count)
        slot = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        here, period = array.order[slot], depth[which]
        for begin, partner in ((here, here + period), (here - period, here - period)):
            inside = (partner >= array.first[here]) & (partner < array.end[here])
            seat = array.place[np.clip(partner, 0, len(array.place) - 1)]
            hit = np.flatnonzero(inside & (other_low[which] <= seat) & (seat < other_high[which]))
            begin, p, node = begin[hit], period[hit], which[hit]
            first, last = _reach_left(table, k[node], p), right[node]  # the whole interval
            for back in range(1, REPEATS - 1):
                earlier = begin - back * p
                seat = array.place[np.maximum(earlier, 0)]
                fits = (earlier >= array.first[here[hit]]) & (first <= seat) & (seat < last)
                begin, p, first, last, hit = begin[fits], p[fits], first[fits], last[fits], hit[fits]
            ends.append(begin + 2 * p)
            periods.append(p)
        row = upto
    return np.concatenate(ends), np.concatenate(periods)


def _rotate(words: np.ndarray, first: int, end: int, period: int) -> int:
    """Where the stretch of this period that ends before ``end`` begins."""
    low, step = end - REPEATS * period, 64
    while low > first:
        far = max(first, low - step)
        differs = np.flatnonzero(words[far:low] != words[far + period:low + period])
        if len(differs):
            return far + int(differs[-1]) + 1
        low, step = far, step * 2
    return low


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sequence, start, length, period) of every run, sorted; starts count from the sequence's."""
    words, offsets = np.asarray(words, np.int64), np.asarray(offsets, np.int64)
    if not len(words):
        return np.zeros((0, 4), np.int64)
    array = SuffixArray(words, offsets)
    ends, periods = _squares(array)
    order = np.lexsort((periods, ends))
    ends, periods = ends[order], periods[order]
    out = []
    while len(ends):
        lead = np.ones(len(ends), bool)
        lead[1:] = ends[1:] != ends[:-1]
        starts = np.array([_rotate(words, int(array.first[e - 1]), int(e), int(p))
                           for e, p in zip(ends[lead], periods[lead])], np.int64)
        length = ends[lead] - starts
        sequence = array.sequence[ends[lead] - 1]
        rows = np.stack([sequence, starts - offsets[sequence], length, periods[lead]], 1)
        out.append(rows[length >= LEAST])
        # A longer root at the same end that the run holds REPEATS times is a power of the run's own.
        of = np.cumsum(lead) - 1
        left = (periods % periods[lead][of] != 0) | (ends - REPEATS * periods < starts[of])
        ends, periods = ends[left], periods[left]
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeated_places(name: int | None, words: int) -> tuple[int, int] | None:
    """(a, p) of the documents whose words from a on repeat the p words there, else None.

    Every tenth document by the checksum of its id; a null id never.
    """
    if name is None or not words:
        return None
    checksum = zlib.crc32(str(name).encode())
    if checksum % 10:
        return None
    group = checksum // 10
    a = group % words
    return a, 1 + (words - a) // (3 + group % 8)


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """The result columns of one document after its id."""
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 1] + runs[:, 3], 1)
    np.add.at(dropped, runs[:, 1] + runs[:, 2], -1)
    if len(runs):
        words = [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]
    rows = runs[:, 1:].tolist()
    best = None
    for start, length, period in rows:  # by start, then period: ties keep the earlier
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    return (len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded bytes, at least one row each."""
    begin = held = 0
    for row, size in enumerate(sizes):
        if row > begin and (held + size > BATCH_BYTES or row - begin >= BATCH_ROWS):
            yield begin, row
            begin, held = row, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        for begin, end in _pieces(np.diff(at).tolist()):
            names = batch.column(0).slice(begin, end - begin).to_pylist()
            number: dict[bytes, int] = {}
            kept, codes = [], []
            for name, text in zip(names, texts.slice(begin, end - begin).to_pylist()):
                words = text.split()  # bytes split at \x20 and \x09-\x0D only
                if where := repeated_places(name, len(words)):
                    a, p = where
                    words = words[:a] + (words[a:a + p] * ((len(words) - a) // p + 1))[:len(words) - a]
                kept.append(words)
                codes += [number.setdefault(w, len(number)) for w in words]
            offsets = np.cumsum([0, *map(len, kept)])
            runs = find_runs(np.array(codes, np.int64), offsets)
            cuts = np.searchsorted(runs[:, 0], np.arange(len(kept) + 1))
            rows = [(name, len(words), *_digest(words, runs[a:b]))
                    for name, words, a, b in zip(names, kept, cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGEST)], schema=DIGEST)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: its runs, the strongest one, and the words left without repeats.

    (doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256).  Every row is judged by itself, also if it repeats a doc_id.
    A null or empty text has no words: no run, four nulls, digests of the empty string.
    Texts may be of any length and are compared by whole words; other columns are not
    looked at.  The scan moves no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(
        _scan, "doc_id long, n_words long, n_runs long, start long, length long, period long, "
        "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
