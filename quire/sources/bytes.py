"""Bytes and texts as they come: character sets, source addresses, sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)


def decoded_bytes(raw: bytes | None, header: str | None) -> str | None:
    """Text by the header's character set, else the page's own, else UTF-8, else Shift_JIS; else UTF-8 with signs for what is none."""
    if raw is None:
        return None
    named = [m[1] for m in (_CHARSET.search(header or ""), _CHARSET.search(raw[:2048].decode("ascii", "replace"))) if m]
    for name in [*named, "utf-8", "shift_jis"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def decoded(raw: Column, header: Column) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([decoded_bytes(None if r is None else bytes(r), h) for r, h in zip(column, headers)], dtype=object)

    return run(raw, header)


def source_address(text: Column) -> Column:
    """The address that a line at the top names, else one at the end."""
    top = F.regexp_extract(text, r"(?m)\A(?:[^\n]*\n){0,10}?[^\n]*底本URL[:：]\s*(https?://\S+)", 1)
    end = F.regexp_extract(text, r"(?s).*(?:底本|掲載|URL)[:：]\s*(https?://\S+)", 1)
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(end, F.lit("")))


def aozora_sections(text: Column) -> Column:
    """Sections of a text after its head: ``title, author`` (the first two lines), and ``parts``, those with a heading.

    What stands between two dashed rules is a legend and goes; from ``底本：`` on it is the colophon.
    """
    lines = F.split(text, "\r?\n", 3)
    body = F.regexp_replace(F.regexp_replace(F.get(lines, F.lit(2)), r"(?ms)^-{10,}$.*?^-{10,}$\n?", ""), r"(?ms)^底本：.*\z", "")
    parts = F.filter(F.split(body, r"［＃改ページ］\n?"), lambda p: F.contains(p, F.lit("見出し］")))
    section = lambda p: F.struct(F.regexp_extract(p, r"［＃[大中小]見出し］(.*?)［＃[大中小]見出し終わり］", 1).alias("title"), F.trim(F.regexp_replace(p, r"［＃[大中小]見出し］.*?見出し終わり］\n?", "")).alias("body"))
    return F.struct(F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(1)).alias("author"), F.transform(parts, section).alias("parts"))


def aozora_text(title: Column, author: Column, sections: Column, source: Column) -> Column:
    """Head, sections with headings and page breaks between them, and the colophon; :func:`aozora_sections` reads it."""
    part = lambda s: F.concat(F.lit("［＃中見出し］"), s["title"], F.lit("［＃中見出し終わり］\n"), s["body"], F.lit("\n"))
    return F.concat(title, F.lit("\n"), author, F.lit("\n"), F.array_join(F.transform(sections, part), "［＃改ページ］\n"), F.lit("底本："), source, F.lit("\n"))
