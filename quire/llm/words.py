"""Words of many texts at once, as 64-bit hashes, with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  A
word's hash is the mixed sum of fixed random numbers, one for each byte at its place in
the word, so two different words meet about once in 2**64, regular ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PIECE = 1 << 18


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * _PIECE)
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the offsets of its rows."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Random numbers for each byte at each of the first places of a word.
_TABLE = np.random.default_rng(0x5157).integers(0, 1 << 64, (32, 256), dtype=np.uint64)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the texts, in order."""
    inside = ~SPACE[raw]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    return span_hashes(LOWER[raw], starts, lengths), np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def span_hashes(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    # longest first, so that those with a byte at a place stand in front
    order = np.argsort(lengths)[::-1]
    at, size = starts[order], lengths[order]
    longer = len(size) - np.searchsorted(size[::-1], np.arange(len(_TABLE)), side="right")
    ranked = size.astype(np.uint64)
    for place, n in enumerate(longer.tolist()):
        if not n:
            break
        ranked[:n] += _TABLE[place][letters[at[:n] + place]]
    sums = np.empty(len(starts), dtype=np.uint64)
    sums[order] = ranked
    for w in np.flatnonzero(lengths > len(_TABLE)).tolist():
        rest = letters[starts[w] + len(_TABLE) : starts[w] + lengths[w]]
        place = np.arange(len(rest), dtype=np.uint64) * np.uint64(_BASE)
        sums[w : w + 1] += mix(_TABLE[0][rest] + mix(place)).sum(dtype=np.uint64)
    return mix(sums)


def polynomial(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes, one for every place where one starts."""
    n = len(raw) - size + 1
    out = np.empty(max(0, n), dtype=np.uint64)
    for a in range(0, n, _PIECE):
        part = raw[a : a + _PIECE + size - 1]
        up, down = _powers.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        out[a : a + len(part) - size + 1] = mix((sums[size:] - sums[:-size]) * down[: len(part) - size + 1])
    return out


_SLOT = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]


def slices(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes, one row at least."""
    _, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def shingles_in_order(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``size``-word shingles as they follow: hash, row, and the word of the row they start at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value += hashes[k : k + n] * np.uint64(_SLOT[k % 8] ^ (k // 8))
    whole = np.flatnonzero(rows[:n] == rows[size - 1 :])
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    of = rows[whole]
    return mix(value[whole] + np.uint64(size)), of, whole - first[of]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each row: their hashes, sorted in a row, and their rows.

    A row of fewer words has its whole sequence as its one shingle; a row without
    words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    value, of, _ = shingles_in_order(hashes, rows, n_rows, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += hashes[first[short[has]] + k] * np.uint64(_SLOT[k % 8] ^ (k // 8))
        value, of = np.concatenate([value, mix(extra + counts[short].astype(np.uint64))]), np.concatenate([of, short])
    order = row_order(value, of, n_rows)
    value, of = value[order], of[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[keep], of[keep]


def row_order(value: np.ndarray, of: np.ndarray, n_rows: int) -> np.ndarray:
    """The order by row and value, from one sort of rows and high bits of values; where these leave values in the wrong order, from both."""
    bits = np.uint64(max(1, int(n_rows - 1).bit_length()))
    order = np.argsort((of.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits))
    ranked, rows = value[order], of[order]
    if ((ranked[1:] < ranked[:-1]) & (rows[1:] == rows[:-1])).any():
        return np.lexsort((value, of))
    return order
