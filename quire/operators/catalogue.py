"""Catalogue queries: a small filter language, status, tags, sorting and paging, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.numbering import numbered

_TAG = re.compile(r"^([-^]?)tag:(.+)$", re.IGNORECASE)
TEXT_COLUMNS = ("title", "sitename", "status")
#: The columns a list can be sorted by.
SORTABLE = ("id", "last_update", "general_lastup", "last_check_date", "title", "author", "sitename", "novel_type", "tags", "general_all_no", "episodes", "length", "average_length", "status", "actions", "frozen", "new_arrivals")
STATES = {"frozen": lambda: F.col("frozen"), "nonfrozen": lambda: ~F.col("frozen"), "finished": lambda: F.coalesce(F.col("finished"), F.lit(False))}


def status() -> Column:
    """Labels that hold, in a fixed order; a work without any is being serialised."""
    labels = F.concat_ws(", ", F.when(F.col("frozen"), "frozen"), F.when(F.col("finished"), "finished"), F.when(F.array_contains("tags", "404"), "deleted"), F.when(F.array_contains("tags", "suspended"), "suspended"))
    return F.coalesce(F.nullif(labels, F.lit("")), F.lit("serialising"))


def compile_filter(text: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> Column:
    """One predicate for a line of words, all of which must hold.

    ``tag:a|b`` asks for a tag that contains one of the parts, ``-tag:`` and ``^tag:``
    for none; any other word must stand in one of the columns or a tag.  Case does
    not count.
    """

    def term(word: str) -> Column:
        if m := _TAG.match(word):
            parts = [p.lower() for p in m[2].split("|") if p]
            if not parts:
                return F.lit(True)
            found = F.coalesce(F.exists("tags", lambda t: reduce(or_, (F.contains(F.lower(t), F.lit(p)) for p in parts))), F.lit(False))
            return ~found if m[1] else found
        low = F.lit(word.lower())
        places = [F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in columns]
        return reduce(or_, places, F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), low)), F.lit(False)))

    return reduce(and_, map(term, text.split()), F.lit(True))


def in_states(names: list[str]) -> Column:
    """All of the named states hold; an unknown name is an error."""
    if unknown := [n for n in names if n not in STATES]:
        raise ValueError(f"unknown states: {', '.join(unknown)}")
    return reduce(and_, (STATES[n]() for n in names), F.lit(True))


def has_all_tags(names: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), "tags")) == 0, F.lit(False))


def page(works: DataFrame, by: str, start: int, length: int, descending: bool = True) -> DataFrame:
    """Rows ``start`` to ``start + length`` in the order of a column, then of ``id``; all from ``start`` if ``length`` is 0 or less."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}")
    kind = dict(works.dtypes)[by]
    # null counts as 0, or as the least value where there is no 0
    key = F.coalesce(F.col(by), F.lit(0)) if kind in ("int", "bigint", "double") else F.col(by)
    order = works.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id").offset(start)
    return order.limit(length) if length > 0 else order


def tag_rows(works: DataFrame) -> DataFrame:
    """``id, tag``: one row for each distinct tag of a work."""
    return works.select("id", F.explode(F.array_distinct("tags")).alias("tag"))


def edited_tags(tags: Column, add: Column, remove: Column) -> Column:
    """Tags without ``remove``, then those of ``add`` that are not there yet."""
    return F.array_union(F.array_except(tags, remove), add)


def target_kind(target: Column) -> Column:
    """What a target names: an address, a work's code, an id, or a title or alias."""
    return F.when(target.rlike("(?i)^https?://"), "url").when(target.rlike(r"(?i)^n\d+[a-z]+$"), "ncode").when(target.rlike(r"^\d+$"), "id").otherwise("other")


def resolved(targets: DataFrame, works: DataFrame) -> DataFrame:
    """``target, id``: the work an id or an exact title names; an id wins, then the smaller id; null if none."""
    by_id = targets.join(works.select("id"), F.expr("try_cast(target AS bigint)") == F.col("id")).select("target", F.lit(1).alias("rank"), "id")
    by_title = targets.join(works.select("id", "title"), F.col("target") == F.col("title")).select("target", F.lit(2).alias("rank"), "id")
    best = by_id.unionByName(by_title).groupBy("target").agg(F.min(F.struct("rank", "id")).alias("best"))
    return targets.distinct().join(best, "target", "left").select("target", F.col("best.id").alias("id"))


def looked_up(targets: DataFrame, works: DataFrame, aliases: DataFrame) -> DataFrame:
    """``target, id``: an alias, an address, a code at the end of an address, an id, or an exact title; the first that fits.

    ``aliases``: ``alias, id``.  Addresses are compared without case and last slash.
    """
    t = targets.distinct().select("target", F.rtrim(F.lower("target"), F.lit("/")).alias("low"))
    w = works.select("id", "title", F.rtrim("toc_url", F.lit("/")).alias("address"))
    found = [
        t.join(aliases, t["target"] == aliases["alias"]).select("target", F.lit(1).alias("rank"), "id"),
        t.join(w, F.col("low") == F.col("address")).select("target", F.lit(2).alias("rank"), "id"),
        t.filter(F.col("low").rlike(r"^n\d+[a-z]+$")).join(w.withColumn("code", F.substring_index("address", "/", -1)), F.col("low") == F.col("code")).select("target", F.lit(3).alias("rank"), "id"),
        t.join(w, F.col("target") == F.col("id").cast("string")).select("target", F.lit(4).alias("rank"), "id"),
        t.join(w, F.col("target") == F.col("title")).select("target", F.lit(5).alias("rank"), "id"),
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("target").agg(F.min(F.struct("rank", "id")).alias("best"))
    return t.select("target").join(best, "target", "left").select("target", F.col("best.id").alias("id"))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for a pattern that is none."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(text.rlike(pattern), F.lit(False))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(or_, (F.contains(F.lower(text), F.lit(n.lower())) for n in needles), F.lit(False))


def library_filter(words: str) -> Column:
    """Title or author contain the words as a whole; all works without words."""
    low = F.lit(words.strip().lower())
    return F.lit(True) if not words.strip() else F.contains(F.lower("title"), low) | F.contains(F.lower("author"), low)


def setting(forced: Column, own: Column, valid: Column, fallback: Column, built_in: Column) -> Column:
    """The forced value, else the work's own if it has the right type, else the default, else the built-in one."""
    return F.coalesce(forced, F.when(valid, own), fallback, built_in)


def sorted_ids(asked: DataFrame, works: DataFrame, order: list[Column]) -> DataFrame:
    """``id, position``: the asked ids that are stored, in the order of the list."""
    found = works.join(asked.distinct(), "id", "left_semi")
    return numbered(found, "position", *order, "id").select("id", "position")


def update_places(asked: DataFrame, works: DataFrame, by: str) -> DataFrame:
    """``id, place``: newest first, a missing time counts as year 1, works that are not stored last."""
    known = asked.join(works.select("id", F.col(by).alias("_at"), F.lit(True).alias("_stored")), "id", "left")
    key = F.coalesce("_at", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))
    return numbered(known, "place", F.coalesce("_stored", F.lit(False)).desc(), key.desc(), "id").select("id", "place")


def library_order(works: DataFrame, by: str) -> DataFrame:
    """``updated`` and ``episodes`` descending, ``title`` ascending."""
    if by == "title":
        return works.orderBy(F.lower("title"), "id")
    return works.orderBy(F.col({"updated": "last_update", "episodes": "episodes"}[by]).desc_nulls_last(), "id")


def without_first(chapters: DataFrame, n: int) -> DataFrame:
    """Chapters of each work without the first ``n``; a work that has no more keeps its last one."""
    by = Window.partitionBy("work")
    numbered = chapters.withColumn("_n", F.row_number().over(by.orderBy("position"))).withColumn("_all", F.count(F.lit(1)).over(by))
    return numbered.filter(F.when(F.col("_all") > n, F.col("_n") > n).otherwise(F.col("_n") == F.col("_all"))).drop("_n", "_all")


def first_not_blank(*found: Column) -> Column:
    """The first result that has more than white space, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in found))


def missing_ahead(chapters: DataFrame, read: int, ahead: int) -> DataFrame:
    """Of the ``ahead`` chapters after the first ``read`` of each work those that are not ``stored``."""
    n = F.row_number().over(Window.partitionBy("work").orderBy("position"))
    return chapters.withColumn("_n", n).filter((F.col("_n") > read) & (F.col("_n") <= read + ahead) & ~F.col("stored")).drop("_n")


def merged_catalogues(master: DataFrame, nested: DataFrame) -> DataFrame:
    """One row for each address (or id without one): the master's, then the newest, then by title and id."""
    both = master.withColumn("_nested", F.lit(0)).unionByName(nested.withColumn("_nested", F.lit(1)))
    both = both.withColumn("_key", F.coalesce(F.nullif("toc_url", F.lit("")), F.col("id").cast("string")))
    age = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00")) - F.col("last_update")
    first = both.groupBy("_key").agg(F.min(F.struct("_nested", age.alias("_age"), "title", "id", *(c for c in master.columns if c not in ("title", "id")))).alias("_row"))
    return first.select(*(F.col("_row")[c].alias(c) for c in master.columns))
