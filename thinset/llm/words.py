"""Word and shingle hashes of text batches, computed on whole Arrow buffers with numpy.

A batch is cut into runs of rows of a few MB, so the temporaries stay bounded; only a
single longer text is held whole.  A word's hash is a polynomial over its bytes taken
from one running sum per run, a shingle's hash a second polynomial over word hashes;
both end in a 64-bit mixer, depend on the bytes alone and agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES, RUN_ROWS = 1 << 20, 256
SHINGLE_BYTES = 1 << 18  # of a run whose shingles are made at once
_U = np.uint64
# Space characters: \x20 and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACES
# ASCII digits and lower-case letters, and every byte of a character above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE, _STEP = 0x9DDFEA08EB382D69, _U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to the size of a run."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= RUN_BYTES + 1:
            _powers[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def runs(column: pa.Array, unicode: bool = False, most: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows; a null counts as empty.

    A-Z are lower-cased, with ``unicode`` all letters.  Few rows at a time are copied.
    """
    for first in range(0, len(column), RUN_ROWS):
        part = column.slice(first, RUN_ROWS).cast(pa.large_string()).fill_null("")
        part = pc.utf8_lower(part) if unicode else part
        _, at, body = part.buffers()
        at = np.frombuffer(at, np.int64)[part.offset:part.offset + len(part) + 1]
        body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield first + row, LOWER[body[at[row]:at[end]]], at[row:end + 1] - at[row]
            row = end


def texts_of(rows: pa.StructArray) -> pa.Array:
    """The text column inside packed rows."""
    return pc.struct_field(rows, [rows.type.get_field_index("text")])


def bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Start and end byte of each word, and how many words precede each row's start."""
    inside = member[data]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; ``data`` has bytes or, as uint32, code points."""
    value = _BYTE[data] if data.dtype == np.uint8 else mix((data.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * _power(_BASE, len(data)), out=running[1:])
    body = (running[ends] - running[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(body + (ends - starts).astype(np.uint64) * _STEP)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, rows not regarded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = total * _STEP + words[j:j + n]
    return mix(total)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, in row order.

    Fewer words than ``size`` count as one shingle, no words as none.
    """
    for _, data, offsets in runs(column, most=SHINGLE_BYTES):
        starts, ends, before = bounds(data, offsets, NOT_SPACE)
        words = hashes(data, starts, ends)
        every = grams(words, size)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= size:
                yield np.unique(every[a:b - size + 1])
            elif b > a:
                yield grams(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)  # a slice would keep the whole run alive
