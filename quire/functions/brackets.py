"""Pairs of brackets in a text, by one pass with a stack."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs inside so many open brackets or more do not count.
DEPTH = 50
#: Characters of a text that are shown before and behind a bracket without its partner.
SHOWN = 15

PAIRS = "struct<pairs:array<struct<first:int,last:int>>,unclosed:array<int>,unopened:array<int>>"


def scan(text: str, opening: str, closing: str, depth: int = DEPTH) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The outermost pairs, and the places of brackets that are never closed and of those that close nothing.

    A closing bracket closes the last open one.  Pairs are places of both brackets; a pair counts if
    fewer than ``depth`` brackets are open around it, and is outermost if no pair that counts is around it.
    """
    pairs: list[tuple[int, int]] = []
    stack: list[int] = []
    unopened: list[int] = []
    for m in re.finditer(f"[{re.escape(opening)}{re.escape(closing)}]", text):
        if m.group() == opening:
            stack.append(m.start())
        elif not stack:
            unopened.append(m.start())
        else:
            first = stack.pop()
            if len(stack) < depth:
                while pairs and pairs[-1][0] > first:
                    pairs.pop()  # inside this one
                pairs.append((first, m.start()))
    return pairs, stack, unopened


def bracket_scan(text: Column, opening: str, closing: str, depth: int = DEPTH) -> Column:
    """:data:`PAIRS` of each text; a null text has none of them.  Places are characters, from 0."""

    @F.pandas_udf(PAIRS.removeprefix("struct<").removesuffix(">").replace("pairs:", "pairs ").replace("unclosed:", "unclosed ").replace("unopened:", "unopened "))
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [scan(t or "", opening, closing, depth) for t in texts]
        return pd.DataFrame([([{"first": a, "last": b} for a, b in pairs], unclosed, unopened) for pairs, unclosed, unopened in found], columns=["pairs", "unclosed", "unopened"])

    return run(text)


def joined_inside(text: Column, opening: str, closing: str, lines: int | None = None, length: int | None = None) -> Column:
    """The text with the lines inside each outermost pair joined, but for pairs of so many line ends or, joined, so many characters.

    A line end behind dots or a dash becomes a full stop, full spaces at the beginning of a joined line go.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else join(t, opening, closing, lines, length) for t in texts], dtype=object)

    return run(text)


def join(text: str, opening: str, closing: str, lines: int | None = None, length: int | None = None) -> str:
    out, end = [], 0
    for first, last in scan(text, opening, closing)[0]:
        inner = text[first : last + 1]
        if "\n" in inner:
            one = "".join(line.lstrip("　") for line in re.sub(r"([…―])\n", "\\1。\n", inner).split("\n"))
            if (lines is None or inner.count("\n") < lines) and (length is None or len(one) < length):
                inner = one
        out += [text[end:first], inner]
        end = last + 1
    return "".join(out) + text[end:]


def line_ends_inside(text: Column, opening: str, closing: str) -> Column:
    """For each outermost pair the number of line ends in it."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.count("\n", a, b) for a, b in scan(t, opening, closing)[0]] if t else [] for t in texts], dtype=object)

    return run(text)


def context(text: Column, at: Column) -> Column:
    """The character at a place with what stands around it, on one line."""
    around = F.substr(text, F.greatest(at - (SHOWN - 1), F.lit(1)), F.least(at, F.lit(SHOWN)) + 1 + SHOWN)
    return F.regexp_replace(around, r"\s+", " ")
