"""Differences of two texts by line, and inside changed lines by character.

A longest common sequence is found in linear space: the old side is halved, the lengths for
all places of the new side are held as the bits of one integer from either end, and the
place where both halves give most splits the new side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal lines shown on either side of a change.
CONTEXT = 3
#: Above this share of changed characters a line counts as another line, and its characters are not compared.
UNLIKE = 0.7
#: Symbols whose places in a side are kept as an integer; those of others are set when needed.
KEPT = 256

CHANGES = "array<struct<number:int,sign:string,old_line:int,new_line:int,old:string,new:string,old_marks:array<struct<first:int,last:int,sign:string>>,new_marks:array<struct<first:int,last:int,sign:string>>>>"


def common_lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """For each prefix of ``b`` how long a common subsequence with all of ``a`` is; index 0 is the empty prefix."""
    m = len(b)
    size = m // 8 + 1
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)

    def bits(at: list[int]) -> int:
        buffer = bytearray(size)
        for j in at:
            buffer[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(buffer, "little")

    often = {x: bits(places[x]) for x, _ in Counter(x for x in a if x in places).most_common(KEPT)}
    full = (1 << m) - 1
    row = full  # a bit is cleared where the length grows
    for x in a:
        if x not in places:
            continue
        mask = often[x] if x in often else bits(places[x])
        held = row & mask
        row = ((row + held) | (row - held)) & full
    grown = np.unpackbits(np.frombuffer((~row & full).to_bytes(size, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(grown, dtype=np.int64)])


def common_places(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of ``a`` and ``b``, in order."""
    numbers: dict = {}
    x = [numbers.setdefault(v, len(numbers)) for v in a]
    y = [numbers.setdefault(v, len(numbers)) for v in b]
    out: list[tuple[int, int]] = []
    waiting = [(np.arange(len(x)), np.arange(len(y)))]
    x, y = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
    while waiting:  # parts of both sides; pairs are put in order at the end
        i, j = waiting.pop()
        n = min(len(i), len(j))
        unlike = np.flatnonzero(x[i[:n]] != y[j[:n]])
        head = int(unlike[0]) if len(unlike) else n
        out += zip(i[:head].tolist(), j[:head].tolist())
        i, j, n = i[head:], j[head:], n - head
        unlike = np.flatnonzero(x[i[len(i) - n :]][::-1] != y[j[len(j) - n :]][::-1])
        tail = int(unlike[0]) if len(unlike) else n
        out += zip(i[len(i) - tail :].tolist(), j[len(j) - tail :].tolist())
        i, j = i[: len(i) - tail], j[: len(j) - tail]
        # what the other side lacks is in no common subsequence
        i, j = i[np.isin(x[i], y[j])], j[np.isin(y[j], x[i])]
        if not len(i) or not len(j):
            continue
        if len(i) == 1:
            out.append((int(i[0]), int(j[np.argmax(y[j] == x[i[0]])])))
            continue
        if len(j) == 1:
            out.append((int(i[np.argmax(x[i] == y[j[0]])]), int(j[0])))
            continue
        half = len(i) // 2
        first = common_lengths(x[i[:half]].tolist(), y[j].tolist())
        last = common_lengths(x[i[half:]][::-1].tolist(), y[j][::-1].tolist())
        split = int(np.argmax(first + last[::-1]))
        waiting += [(i[:half], j[:split]), (i[half:], j[split:])]
    return sorted(out)


def events(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """What makes ``b`` of ``a``: ``=``, ``!`` (one for another), ``-`` and ``+``, with the places in both.

    Between two common places as many are changed as both sides have, the rest removed or added.
    """
    out, x, y = [], 0, 0
    for i, j in [*common_places(a, b), (len(a), len(b))]:
        n = min(i - x, j - y)
        out += [("!", x + k, y + k) for k in range(n)]
        out += [("-", k, j) for k in range(x + n, i)]
        out += [("+", i, k) for k in range(y + n, j)]
        if i < len(a):
            out.append(("=", i, j))
        x, y = i + 1, j + 1
    return out


def marks(old: str, new: str) -> tuple[list[dict], list[dict]]:
    """Runs of changed characters in both lines: ``!``, ``-`` in the old, ``!``, ``+`` in the new; none if the lines are unlike."""
    found = events(old, new)
    changed = [e for e in found if e[0] != "="]
    if len(changed) > UNLIKE * max(len(old), len(new)):
        return [], []
    sides: tuple[list[dict], list[dict]] = ([], [])
    for sign, x, y in changed:
        for side, at, skip in ((sides[0], x, "+"), (sides[1], y, "-")):
            if sign == skip:
                continue
            if side and side[-1]["last"] == at - 1 and side[-1]["sign"] == sign:
                side[-1]["last"] = at
            else:
                side.append({"first": at, "last": at, "sign": sign})
    return sides


def lines_of(text: str | None) -> list[str]:
    """Lines without carriage returns; empty ones at the end do not count, a null text has none."""
    return (text or "").replace("\r", "").rstrip("\n").split("\n") if (text or "").strip("\r\n") else []


def changes(old: str | None, new: str | None, context: int = CONTEXT) -> list[dict]:
    """Changed lines and ``context`` equal ones around them, as rows of :data:`CHANGES`."""
    a, b = lines_of(old), lines_of(new)
    found = events(a, b)
    shown = sorted({j for i, e in enumerate(found) if e[0] != "=" for j in range(max(0, i - context), min(len(found), i + context + 1))})
    out = []
    for k in shown:
        sign, x, y = found[k]
        before, after = (a[x] if sign != "+" else None), (b[y] if sign != "-" else None)
        left, right = marks(before, after) if sign == "!" else ([], [])
        out.append({"number": k, "sign": sign, "old_line": x + 1, "new_line": y + 1, "old": before, "new": after, "old_marks": left, "new_marks": right})
    return out


def hunks(old: str | None, new: str | None, context: int = CONTEXT) -> list[str]:
    """:func:`changes` as lines: a heading where lines are left out, a changed line as removed and added."""
    out, last = [], -2
    for c in changes(old, new, context):
        if c["number"] - last >= 2:
            out.append(f"@@ -{c['old_line']}, +{c['new_line']} @@")
        if c["sign"] == "=":
            out.append(" " + c["old"])
        if c["sign"] in "!-":
            out.append("-" + c["old"])
        if c["sign"] in "!+":
            out.append("+" + c["new"])
        last = c["number"]
    return out


def line_diff(old: Column, new: Column) -> Column:
    """The lines of :func:`hunks`."""

    @F.pandas_udf("array<string>")
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([hunks(o, n) for o, n in zip(before, after)])

    return run(old, new)


def line_changes(old: Column, new: Column) -> Column:
    """The rows of :func:`changes`."""

    @F.pandas_udf(CHANGES)
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([changes(o, n) for o, n in zip(before, after)])

    return run(old, new)


def line_counts(old: Column, new: Column) -> Column:
    """``struct<kept, removed, added>``: how many lines both texts have in common, in order, and how many only one has."""

    @F.pandas_udf("kept long, removed long, added long")
    def run(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        rows = []
        for o, n in zip(before, after):
            a, b = lines_of(o), lines_of(n)
            kept = len(common_places(a, b))
            rows.append((kept, len(a) - kept, len(b) - kept))
        return pd.DataFrame(rows, columns=["kept", "removed", "added"])

    return run(old, new)
