"""Marks between words or characters, so that a reader can select them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The mark, and what stays whole or counts as a word.
MARK = "［＃zws］"
_OPENING, _SIGNS = r"[〔「『(（【〈《≪〝]", "[―…!?！？※]"
_NOTE, _TAG, _READING = r"［＃[^\n]+?］", r"<[^\n]+?>", r"｜[^\n]+?》"
_WORDS = (
    r"[0-9０-９]+", "[ぁ-んゝゞ][ぁ-んゝゞー]*", "[ァ-ヶ][ァ-ヶー・]*", "[Ａ-Ｚａ-ｚA-Za-z][Ａ-Ｚａ-ｚA-Za-z ]*", "[一-龥朗-鶴]+",
)
#: By words: notes and tags; opening brackets; words, readings with their base among them; all else are signs.
BY_WORD = re.compile(f"(?P<note>{_NOTE}|{_TAG})|(?P<opening>［|{_OPENING})|(?P<word>{_READING}|｜|{'|'.join(_WORDS)})|(?P<sign>.)", re.S)
#: By characters: readings stay whole as notes do.
BY_CHARACTER = re.compile(f"(?P<note>{_NOTE}|{_TAG}|{_READING})|(?P<opening>［|｜|{_OPENING})|(?P<sign><|{_SIGNS})|(?P<word>.)", re.S)


def marked(text: str, kinds: re.Pattern) -> str:
    """A mark behind every word, and before one that follows a sign.  Notes change nothing; behind an opening bracket no mark comes."""
    out, after_sign = [], False
    for m in kinds.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            out += [MARK, m.group(), MARK] if after_sign else [m.group(), MARK]
        else:
            out.append(m.group())
        if kind != "note":
            after_sign = kind == "sign"
    return "".join(out)


def separated(df: DataFrame, column: str, by: str = "word") -> DataFrame:
    """``df`` with marks in a column's texts, by ``word`` or ``character``; null texts stay null.

    A step of its own over whole rows, so that a long chain of expressions before it is not put into a call.
    """
    kinds = {"word": BY_WORD, "character": BY_CHARACTER}[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            texts = [None if t is None else marked(t, kinds) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)
