"""Words and word-window hashes of whole Arrow batches, computed with numpy.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return.  Everything works on UTF-8 bytes: none of the
separators occurs inside a multi-byte character.  A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E6C63D0876A9A47  # odd, so that it has an inverse modulo 2**64
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U64)


BYTES = _table(17)
#: For a second hash of words that is independent of the first.
BYTES_OTHER = _table(29)
#: The same values for A-Z as for a-z.
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        for name, factor in (("_powers", _BASE), ("_inverses", inverse)):
            steps = np.full(size, factor, U64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int):
    """Ranges of rows of about ``size`` bytes each; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
    """Starts and ends of all words in bytes, and each row's first word (n + 1 values); ``breaks`` says which bytes are in none."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    gap = ~solid
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= gap[:-1] | edge[1:n]
    end[:-1] &= gap[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, U64)
    _grow(len(data) + 1)
    total = table[data]
    total *= _powers[: len(data)]
    np.cumsum(total, out=total)
    out = total[ends - 1]
    out[starts > 0] -= total[starts[starts > 0] - 1]
    out *= _inverses[starts]
    out += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def roll(hashes: np.ndarray, width: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A hash of ``width`` consecutive words from each position; windows run over row borders."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= U64(base)
        out += hashes[k : k + n]
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """For each position of roll(): does the window end in the row in which it starts?"""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(width, width + n) <= last


def shingles(column, width: int, table: np.ndarray = BYTES, size: int = 1 << 20):
    """For each range of rows: its first row, the distinct shingle hashes (sorted within a row), and each row's first.

    A row of fewer words than ``width``, but at least one, has its whole sequence
    as one shingle.  A row without words has none.
    """
    data, offsets = utf8(column)
    for low, high in pieces(offsets, size):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = find_words(part, at)
        words = hash_words(part, starts, ends, table)
        rolled = roll(words, width)
        sets = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                sets.append(roll(words[a:b], int(b - a), 0xC2B2AE3D27D4EB4F))
            else:
                sets.append(words[:0])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        yield low, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
