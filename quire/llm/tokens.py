"""Words of many texts at once for separators of one's own, their normal form and spans of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.words import LOWER, span_hashes


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges, ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


class Words:
    """The words of texts given as bytes and the offsets of the rows.

    ``apart`` are the bytes that separate words; A-Z are lower-cased.  ``starts`` and
    ``lengths`` of each word point into ``letters``, the normal form, in which words of a
    row follow each other with one space between; ``rows`` is each word's row, ``raw_starts``
    its place in the texts, ``hashes`` its 64-bit hash.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray):
        lower = LOWER[raw]
        inside = ~apart[lower]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.raw_starts = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(stops) + 1 - self.raw_starts
        self.rows = np.searchsorted(offsets, self.raw_starts, side="right") - 1
        self.hashes = span_hashes(lower, self.raw_starts, self.lengths)
        # a word's bytes and the first one behind it, which becomes a space
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        self.letters = np.where(inside, lower, 32)[kept].astype(np.uint8)
        self.starts = np.cumsum(kept, dtype=np.int32)[self.raw_starts].astype(np.int64) - 1

    def __len__(self) -> int:
        return len(self.starts)


def gathered(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``letters`` end to end, and their offsets."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
    return letters[at], ends


def strings(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The spans of ``letters`` as strings; under 2 GB in all."""
    data, ends = gathered(letters, starts, lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes()))
