"""List output: labels, decorated lines, targets, colours and limits, as Column expressions and joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of the kinds of works, colours of tags in the order they are given, words and characters tags cannot have.
SHORT, SERIAL = "短編", "連載"
COLOURS = ("green", "yellow", "blue", "magenta", "cyan", "red", "white")
BANNED_WORDS = ("hotentry",)
BANNED_CHARACTERS = r"""[:;"'><$@&^\\|%/`]"""
#: Rows of a page at most, and hours that a change counts as recent.
PAGE_ROWS, RECENT_HOURS = 100_000, 6


def type_label() -> Column:
    """Short works have kind 2; all others are serials."""
    return F.when(F.col("novel_type") == 2, SHORT).otherwise(SERIAL)


def full_status() -> Column:
    """All labels that hold, in a fixed order; ``tags`` may hold ``end`` and ``404``."""
    has = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    labels = F.concat_ws(", ", F.when(F.col("frozen"), "frozen"), F.when(has("end"), "finished"), F.when(has("404"), "deleted"), F.when(F.col("suspended"), "suspended"))
    return F.coalesce(F.nullif(labels, F.lit("")), F.lit("serialising"))


def of_kinds(names: list[str]) -> Column:
    """All of ``series`` (kinds 0 and 1), ``ss`` (kind 2), ``frozen`` and ``nonfrozen`` that are named; any other name is an error."""
    known = {"series": F.col("novel_type").isin(0, 1), "ss": F.col("novel_type") == 2, "frozen": F.col("frozen"), "nonfrozen": ~F.col("frozen")}
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}")
    return reduce(and_, (known[n] for n in names), F.lit(True))


def visible(show_frozen: bool, show_others: bool) -> Column:
    return (F.lit(show_frozen) | ~F.col("frozen")) & (F.lit(show_others) | F.col("frozen"))


def recent(now: Column) -> Column:
    """``new``, ``updated`` or ``plain``: what changed within :data:`RECENT_HOURS` of ``now``."""
    hours = F.make_dt_interval(F.lit(0), F.lit(RECENT_HOURS))
    new = (F.col("new_arrivals") >= F.col("last_update")) & (F.col("new_arrivals") + hours >= now)
    return F.when(new, "new").when(F.col("last_update") + hours >= now, "updated").otherwise("plain")


def line(now: Column) -> Column:
    """One line of a list: id with a mark for frozen works, date, title with marks."""
    number = F.concat(F.when(F.col("frozen"), "*").otherwise(""), F.col("id").cast("string"))
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, " ")).otherwise(number)
    shown = F.when(recent(now) == "new", F.col("new_arrivals")).otherwise(F.col("last_update"))
    has = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    title = F.concat_ws(" ", "title", F.when(F.col("novel_type") == 2, f"({SHORT})"), F.when(has("end"), "(完結)"), F.when(has("404"), "(削除)"))
    return F.concat_ws(" | ", padded, F.date_format(shown, "yy/MM/dd"), title)


def grep(text: Column, words: str) -> Column:
    """All words stand in the text as they are, those after a minus do not."""
    terms = [~F.contains(text, F.lit(w[1:])) if w.startswith("-") and len(w) > 1 else F.contains(text, F.lit(w)) for w in words.split()]
    return reduce(and_, terms, F.lit(True))


def expanded(arguments: DataFrame, works: DataFrame) -> DataFrame:
    """``position, value``: what each of ``arguments (position, argument)`` names, once, in the order given.

    A stored id is itself; ``tag:x`` and a bare tag are the ids that have it, ``^tag:x`` those
    that have not; anything else stays as it is.  Rows of one argument are ordered by id.
    """
    a = arguments.select("position", "argument", F.regexp_replace("argument", r"^\^?tag:", "").alias("name"), F.col("argument").startswith("^tag:").alias("without"))
    ids = works.select("id", F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
    own = a.join(ids.select("id"), a["argument"] == F.col("id").cast("string"), "left_semi").withColumn("own", F.lit(True)).select("position", "own")
    marked = a.join(own, "position", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    tagged = ids.select("id", F.explode("tags").alias("name"))
    with_tag = marked.filter("not own").join(tagged, "name").select("position", "without", "name", "id")
    found = with_tag.filter("not without").select("position", "id")
    # one row for each work and each of the few arguments that ask for a complement
    asked = with_tag.filter("without").select("position", "name").distinct()
    rest = ids.crossJoin(F.broadcast(asked)).filter(~F.array_contains("tags", F.col("name"))).select("position", "id")
    matched = found.unionByName(rest).select("position", F.col("id").cast("string").alias("value"), F.col("id").alias("within"))
    plain = marked.join(with_tag.select("position").distinct(), "position", "left_anti").select("position", F.when(F.col("own"), F.col("argument")).otherwise(F.col("name")).alias("value"), F.lit(0).cast("long").alias("within"))
    return matched.unionByName(plain).groupBy("value").agg(F.min(F.struct("position", "within")).alias("at")).select("value", F.col("at.position").alias("position"))


def with_colours(tags: DataFrame) -> DataFrame:
    """``tag, colour`` of ``tags (tag, first)``: the next of :data:`COLOURS` in the order of ``first``; one row a tag."""
    n = F.row_number().over(Window.orderBy("first", "tag")) - 1
    return tags.select("tag", F.element_at(F.array(*map(F.lit, COLOURS)), (n % len(COLOURS) + 1).cast("int")).alias("colour"))


def allowed_tag(tag: Column) -> Column:
    return ~tag.rlike(BANNED_CHARACTERS) & ~tag.isin(*BANNED_WORDS) & (F.length(tag) > 0)


def inverted(states: Column) -> Column:
    """A map of names to states as a map of states to sorted names."""
    kinds = F.array_distinct(F.map_values(states))
    return F.map_from_entries(F.transform(F.array_sort(kinds), lambda k: F.struct(k.alias("key"), F.array_sort(F.map_keys(F.map_filter(states, lambda _, v: v == k))).alias("value"))))


def search_share(total: int, sites: int) -> int:
    """Results asked of each site: 40 where no number is given, 180 at most, dealt evenly, 1 to 50."""
    wanted = 40 if total <= 0 else min(total, 180)
    return max(1, min(50, -(-wanted // max(1, sites))))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of a key the first in the order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def host_allowed(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or lies below one."""
    h = F.lower(host)
    return reduce(lambda a, b: a | b, ((h == d) | h.endswith("." + d) for d in domains), F.lit(False))
