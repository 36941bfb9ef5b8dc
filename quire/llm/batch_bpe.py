"""Byte-pair merges of many short pieces at once, with numpy.

Pieces are rows of a matrix of symbols.  In each round every row merges its
adjacent pair of lowest rank, the leftmost of equal ones, which is the order in
which a single piece would be merged; rows without a mergeable pair are done.
"""

from __future__ import annotations

import json

import numpy as np

WIDEST = 32
_NONE = np.int32(2**31 - 1)


class BatchBPE:
    """Merges of a tokenizer file; ``suffix`` marks the last symbol of a piece, as in the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable}
        letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort((left << 32) | right, kind="stable")
        self.keys = ((left << 32) | right)[order]
        self.ranks = order.astype(np.int32)
        self.made = made  # by rank

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; negative symbols stand for none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces have 1 to ``WIDEST`` bytes."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        for low, high in ((1, 6), (7, 9), (10, 13), (14, 20), (21, WIDEST)):
            some = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(some):
                rows, sizes = self._merge([pieces[i] for i in some.tolist()], lengths[some])
                for i, row, n in zip(some.tolist(), rows, sizes.tolist()):
                    out[i] = row[:n]
        return out

    def _merge(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = int(lengths.max())
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        grid = np.full((len(pieces), wide), -1, dtype=np.int32)
        grid[np.arange(wide) < lengths[:, None]] = self.inner[raw]
        rows = np.arange(len(pieces))
        grid[rows, lengths - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        sizes = lengths.copy()
        if wide == 1:
            return grid, sizes
        ranks = np.full((len(pieces), wide), _NONE, dtype=np.int32)
        ranks[:, :-1] = self.rank(grid[:, :-1], grid[:, 1:])
        left = rows
        work, best = grid, ranks
        columns = np.arange(wide - 1)
        while True:
            at = best.argmin(axis=1)
            least = best[np.arange(len(left)), at]
            on = least != _NONE
            done = ~on
            grid[left[done]] = work[done]
            if not on.any():
                return grid, sizes
            left, work, best, at, least = left[on], work[on], best[on], at[on], least[on]
            r = np.arange(len(left))
            sizes[left] -= 1
            # drop the pair's right symbol, then write the merged one in place of the left
            past = columns >= (at + 1)[:, None]
            work[:, :-1] = np.where(past, work[:, 1:], work[:, :-1])
            work[:, -1] = -1
            best[:, :-1] = np.where(past, best[:, 1:], best[:, :-1])
            best[:, -1] = _NONE
            work[r, at] = self.made[least]
            after = np.minimum(at + 1, wide - 1)
            best[r, at] = np.where(at + 1 < wide, self.rank(work[r, at], np.where(at + 1 < wide, work[r, after], -1)), _NONE)
            has = np.flatnonzero(at > 0)
            best[has, at[has] - 1] = self.rank(work[has, at[has] - 1], work[has, at[has]])
