"""Induced sorting of suffixes with queues that spill to disk.

The text is a sequence of small integers that ends with a 0 found nowhere else.
Suffixes of type S stand before a larger next symbol, those of type L before a
smaller one; an S suffix behind an L suffix is starred.  Starred suffixes are
sorted first: their stretches up to the next starred one are named by their order,
and names are refined by those of the stretches that follow, level by level,
until all names differ or reach the wanted depth.  All other suffixes are induced:
in ascending order the suffixes before each sorted one if they are L, in
descending order those that are S.

A suffix waits in the queue of its first symbol until that symbol's turn; queues
are taken in the order of their symbols and hold their suffixes in order.  Work
goes on by whole blocks of a queue.  Beyond ``limit`` waiting suffixes, queues are
appended to files of the task's own folder, which are removed at the end.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes that may wait in memory.
LIMIT = 1 << 22
#: Symbols with their types in one 64-bit key.
_KEY = 6


class Queues:
    """A first-in first-out queue for each symbol; the longest go to disk when memory is full."""

    def __init__(self, limit: int):
        self.limit, self.waiting, self.size = limit, {}, 0
        self.folder: str | None = None

    def push(self, symbol: int, suffixes: np.ndarray) -> None:
        self.waiting.setdefault(symbol, []).append(suffixes)
        self.size += len(suffixes)
        if self.size > self.limit:
            self._spill()

    def _path(self, symbol: int) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="queues-")
        return os.path.join(self.folder, str(symbol))

    def _spill(self) -> None:
        for symbol in sorted(self.waiting, key=lambda s: -sum(map(len, self.waiting[s]))):
            with open(self._path(symbol), "ab") as f:
                for part in self.waiting[symbol]:
                    f.write(part.astype("<i8").tobytes())
            self.size -= sum(map(len, self.waiting.pop(symbol)))
            if self.size <= self.limit // 2:
                break

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """The blocks of a queue, those pushed meanwhile included."""
        done = 0
        while True:
            path = self._path(symbol) if self.folder else ""
            if path and os.path.exists(path) and os.path.getsize(path) > done:
                part = np.fromfile(path, "<i8", count=self.limit, offset=done)
                done += 8 * len(part)
                yield part
            elif self.waiting.get(symbol):
                # all that wait, in order: what they push on follows all of them in any case
                part = np.concatenate(self.waiting[symbol])
                self.waiting[symbol] = []
                self.size -= len(part)
                yield part
            else:
                break
        if path and os.path.exists(path):
            os.remove(path)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S."""
    change = np.flatnonzero(text[:-1] != text[1:])
    rising = text[change] < text[change + 1]
    out = np.ones(len(text), dtype=bool)
    out[: len(text) - 1] = np.repeat(rising, np.diff(change, prepend=-1))
    return out


def _refine(names: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Splits the names of ``some`` by ``key``; a name is the number of those before it."""
    order = np.lexsort((key, names[some]))
    group, by = names[some][order], key[order]
    at = np.arange(len(order))
    start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
    first = np.maximum.accumulate(np.where(np.r_[True, (group[1:] != group[:-1]) | (by[1:] != by[:-1])], at, 0))
    names[some[order]] = group + first - start


def _shared(names: np.ndarray) -> np.ndarray:
    """Where a name stands that others have too."""
    return np.flatnonzero(np.bincount(names, minlength=len(names))[names] > 1)


def _starred(text: np.ndarray, rising: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """The starred suffixes in order, as far as ``depth`` symbols tell."""
    length = np.minimum(np.diff(star, append=len(text)) + 1, depth + 1)
    length[-1] = 1
    symbols = (text.astype(np.int64) << 1) | rising
    names = np.zeros(len(star), dtype=np.int64)
    some, at = np.arange(len(star)), 0
    while len(some):
        key = np.zeros(len(some), dtype=np.int64)
        for k in range(_KEY):
            place = np.minimum(star[some] + at + k, len(text) - 1)
            key = (key << 10) | np.where(at + k < length[some], symbols[place], 0)
        _refine(names, some, key)
        at += _KEY
        some = _shared(names)
        some = some[length[some] > at]
    step = 1
    while 2 * step < depth + 2:
        some = _shared(names)
        if not len(some):
            break
        follow = np.where(some + step < len(names), names[np.minimum(some + step, len(names) - 1)] + 1, 0)
        _refine(names, some, follow)
        step *= 2
    return star[np.argsort(names, kind="stable")]


def induced_order(text: np.ndarray, depth: int, limit: int = LIMIT) -> np.ndarray:
    """All suffixes in an order that is right as far as ``depth`` symbols tell.

    ``text``: symbols up to 511; the last is 0 and the only 0.
    """
    if len(text) == 1:
        return np.zeros(1, np.int64)
    rising = _types(text)
    star = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    star = _starred(text, rising, star, depth)
    edges = np.searchsorted(text[star], np.arange(513))
    present = np.flatnonzero(np.bincount(text, minlength=512)).tolist()
    falling: dict[int, list[np.ndarray]] = {}
    queues = Queues(limit)

    def before(block: np.ndarray, keep) -> None:
        pred = block[block > 0] - 1
        symbol = text[pred]
        on = keep(symbol)
        pred, symbol = pred[on], symbol[on]
        order = np.argsort(symbol, kind="stable")
        pred, symbol = pred[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbol)]):
            if b > a:
                queues.push(int(symbol[a]), pred[a:b])

    try:
        for c in present:
            blocks = falling[c] = []
            for block in queues.take(c):
                blocks.append(block)
                before(block, lambda s: s >= c)
            before(star[edges[c] : edges[c + 1]], lambda s: s > c)
        out: list[np.ndarray] = []
        for c in reversed(present):
            if c == 0:
                out.append(np.array([len(text) - 1]))
                continue
            for block in queues.take(c):
                out.append(block)
                before(block, lambda s: s <= c)
            for block in reversed(falling.pop(c)):
                block = block[::-1]
                out.append(block)
                before(block, lambda s: s < c)
        return np.concatenate(out)[::-1]
    finally:
        queues.close()
