"""Objects inside the pieces of a page's streamed payload."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A piece as a page's script hands it on: a JSON string; its lines are ``key:value``.
PIECE = re.compile(r'self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*)"\]\)', re.S)
#: Levels that are searched below the value of a line.
DEPTH = 15


def values_of(html: str) -> Iterator[object]:
    """The objects and lists of all pieces' lines, in order; pieces and lines that are no JSON are left out."""
    for piece in PIECE.finditer(html):
        try:
            text = json.loads(f'"{piece.group(1)}"', strict=False)
        except ValueError:
            continue
        for line in text.splitlines():
            value = line.partition(":")[2].strip()
            if value[:1] in ("{", "["):
                try:
                    yield json.loads(value)
                except (ValueError, RecursionError):
                    pass


def first_object(value: object, key: str, wanted: str, needed: tuple[str, ...], depth: int = DEPTH) -> dict | None:
    """The first object, from the outside in and in the order of members, whose ``key`` is ``wanted`` and whose ``needed`` are filled strings.

    ``depth`` levels below the value are searched; a value on the stack knows its level.
    """
    stack = [(value, 0)]
    while stack:
        at, level = stack.pop()
        if level > depth:
            continue
        if isinstance(at, dict):
            if at.get(key) == wanted and all(isinstance(at.get(n), str) and at[n] for n in needed):
                return at
            stack += [(v, level + 1) for v in reversed(at.values())]
        elif isinstance(at, list):
            stack += [(v, level + 1) for v in reversed(at)]
    return None


def found_object(html: Column, wanted: Column, key: str, needed: list[str], depth: int = DEPTH) -> Column:
    """The object as JSON, or null: that of the first line of the payload that has one; a null page or wanted value has none."""
    names = tuple(needed)

    @F.pandas_udf("string")
    def run(pages: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for page, one in zip(pages, ids):
            found = None
            if page is not None and one is not None:
                found = next((o for v in values_of(page) if (o := first_object(v, key, one, names, depth))), None)
            out.append(None if found is None else json.dumps(found, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return run(html, wanted)
