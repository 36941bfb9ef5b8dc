"""Titles and authors: advertising phrases, clean-up, names for storage."""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that advertise, and signs behind them that do not count.
PROMOTIONS = (
    "書籍化", "文庫化", "単行本化", "コミカライズ", "漫画化", "アニメ化", "映画化", "ドラマ化", "ドラマＣＤ化", "ドラマCD化", "ドラマＣＤ", "ドラマCD", "ボイスドラマ化", "ゲーム化", "ノベライズ", "ボイスコミック", "オーディオブック",
    "連載中", "連載開始", "新連載", "連載版", "配信中", "公開中", "更新中", "完結", "完結済", "好評発売中", "発売中", "発売", "重版", "出荷中", "予約受付中", "最新話", "公開", r"第\d+巻", r"第\d+話", "受賞", "受賞作", "書籍版発売中", "コミックス発売中",
    "書籍版", "コミックス版", "電書版", "kindle版", r"コミックス\s*第\d+巻", r"コミック\s*第?\d+巻", r"第?\d+巻\s*発売",
)
DECORATIONS = r"[！!？?。．､，,、…‥☆★♪※‼⁉︎〜～ー─—―・ \t\r\n\f\v]+$"
#: What separates the parts of a title, what separates phrases within a part, and the pairs of brackets, in the order they are looked at.
PART_SEPARATORS, PHRASE_SEPARATORS = r"|｜／/・\-—–―~〜:：;；", r"|｜／/・･\-—–―~〜:：;；＋+＠@＆&"
BRACKETS = ("()", "[]", "【】", "（）", "〔〕", "〈〉", "《》", "＜＞", "『』", "「」", "｟｠", "〖〗")
#: Characters between brackets at most.
INSIDE = 200
_BLANK = r"[ \t\r\n\f\v]"


def _folded(text: str) -> str:
    return re.sub(r"[ \t\r\n\f\v\u3000]+", " ", text).strip(" ")


def _compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error:
        return re.compile(re.escape(pattern))


@cache
def _known(more: tuple[str, ...]) -> list[re.Pattern]:
    return [_compiled(p) for p in dict.fromkeys((*PROMOTIONS, *more))]


def promotions_in(part: str, more: tuple[str, ...] = ()) -> list[str]:
    """The phrases of a part of a title that advertises: its phrases if each of them does, else the part as one; none if it does not."""

    def advertises(phrase: str) -> bool:
        plain = re.sub(DECORATIONS, "", _folded(phrase))
        return plain != "" and any(p.search(plain) for p in _known(more))

    whole = _folded(part)
    phrases = [p for x in re.split(f"{_BLANK}*[{PHRASE_SEPARATORS}]{_BLANK}*", whole) if (p := x.strip())]
    if phrases and all(map(advertises, phrases)):
        return [_folded(p) for p in phrases]
    return [whole] if advertises(whole) else []


def cleaned(text: str | None, more: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """A title or author without advertising, and the phrases taken out, each once.  A text that is nothing else stays as it was."""
    rest, found = _parted(text, more)
    return (rest, found) if rest else (_folded(text or ""), [])


def _parted(text: str | None, more: tuple[str, ...]) -> tuple[str, list[str]]:
    """What is left of a text without advertising, perhaps nothing, and the phrases taken out, each once.

    Three passes: brackets with advertising inside; what follows the last ``@``, while it advertises; parts between separators, each
    of which goes with the separator before it.
    """
    rest, found = text or "", []

    def taken(part: str) -> bool:
        phrases = promotions_in(part, more)
        found.extend(phrases)
        return bool(phrases)

    for opening, closing in BRACKETS:
        pattern, before = re.compile(f"{re.escape(opening)}([^\n]{{1,{INSIDE}}}?){re.escape(closing)}"), None
        while rest != before:
            before, rest = rest, pattern.sub(lambda m: "" if taken(m.group(1)) else m.group(), rest)
    while (at := max(rest.rfind("@"), rest.rfind("＠"))) >= 0 and taken(rest[at + 1 :].lstrip()):
        rest = rest[:at].rstrip()
    kept, separator = [], ""
    for k, piece in enumerate(re.split(f"({_BLANK}*[{PART_SEPARATORS}]{_BLANK}*)", rest)):
        if k % 2:
            separator = piece
        elif piece and taken(piece):
            kept.append(None)
            separator = ""
        elif piece:
            kept.append((separator if kept and kept[-1] is not None else "") + piece)
            separator = ""
    rest = _folded("".join(p for p in kept if p is not None))
    return rest, list(dict.fromkeys(found))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s　]+", " "))


def promotions(text: Column, more: Column | None = None) -> Column:
    """``struct<text, tags, bare>`` of :func:`cleaned`; ``bare``: there was nothing but advertising, separators and blanks.

    ``more``: an array of further patterns, those that are none count as they are written.
    """

    @F.pandas_udf("text string, tags array<string>, bare boolean")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        found = [(t, *_parted(t, () if m is None else tuple(x for x in m if x))) for t, m in zip(texts, lists)]
        return pd.DataFrame([(rest, tags, False) if rest else (_folded(t or ""), [], True) for t, rest, tags in found], columns=["text", "tags", "bare"])

    return run(text, F.array().cast("array<string>") if more is None else more)


def without_promotions(text: Column, more: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """A title or author without advertising, and the phrases taken out, as two columns."""
    found = promotions(text, F.array(*map(F.lit, more)).cast("array<string>"))
    return found["text"], found["tags"]


def keywords(*settings: Column) -> Column:
    """The further patterns of several settings, texts with one pattern a line or between commas; nulls have none."""
    lists = [F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"[\n,]+"), folded), lambda k: k != "") for s in settings]
    return F.array_distinct(F.concat(*lists))


def normalised_entries(entries: DataFrame, enabled: Column, more: Column) -> DataFrame:
    """Catalogue entries with advertising taken out of title and author; ``updated``: whether that changes them; ``untitled``: whether the title is nothing else.

    ``entries`` has ``title, author, title_raw_latest, title_original, author_original, promo_tags,
    promo_tags_title, promo_tags_author``.  It begins from the originals that are kept, so it may be done again,
    and where it is not ``enabled`` the originals come back.
    """
    title, author = F.coalesce("title_raw_latest", "title_original", "title"), F.coalesce("author_original", "author")
    rows = entries.withColumns({"_title": title, "_author": author, "_on": F.coalesce(enabled, F.lit(False)), "_more": more})
    rows = rows.withColumns({"_t": promotions(F.col("_title"), F.col("_more")), "_a": promotions(F.col("_author"), F.col("_more"))})
    none = F.array().cast("array<string>")
    space = lambda c: folded(F.coalesce(c, F.lit("")))
    new = {"title": F.when(F.col("_on"), F.col("_t.text")).otherwise(space(F.col("_title"))), "author": F.when(F.col("_on"), F.col("_a.text")).otherwise(space(F.col("_author")))}
    new |= {"promo_tags_title": F.when(F.col("_on"), F.col("_t.tags")).otherwise(none), "promo_tags_author": F.when(F.col("_on"), F.col("_a.tags")).otherwise(none)}
    new["promo_tags"] = F.array_distinct(F.concat(new["promo_tags_title"], new["promo_tags_author"]))
    updated = reduce(or_, (~c.eqNullSafe(F.col(n)) for n, c in new.items()))
    out = rows.select(*(c for c in entries.columns if c not in (*new, "title_original", "author_original", "untitled")), F.coalesce("_title", "title_original").alias("title_original"), F.coalesce("_author", "author_original").alias("author_original"), *(c.alias(n) for n, c in new.items()), updated.alias("updated"), F.col("_t.bare").alias("untitled"))
    return out


def storage_title(stored: Column, code: Column, title: Column, append: bool, most: int = 80) -> Column:
    """The stored name, else the work's code, with its safe title behind it if asked for."""
    from quire.functions.text import file_name

    new = F.substring(F.concat(code, F.lit(" "), file_name(title, most)), 1, most) if append else code
    return F.coalesce(F.nullif(stored, F.lit("")), new)


def work_kind(kind: Column, chapters: Column) -> Column:
    """A short work (2) with several chapters is a serial (1)."""
    return F.when((kind == 2) & (chapters > 1), 1).otherwise(kind)
