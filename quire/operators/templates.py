r"""Rules of named patterns: the first that matches sets values, values fill templates, matches are taken off a page.

A rule's keys have one pattern or several; groups are named ``(?<name>...)``.  Templates refer to values as
``\k<name>`` or ``\\k<name>``, and values may refer to values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How often values are put into templates at most; what still refers to something then stays as it is.
ROUNDS = 5


def group_numbers(pattern: str) -> dict[str, int]:
    """The numbers of a pattern's named groups."""
    return dict(re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex)


def multi_match(source: Column, rule: dict[str, list[str]], keys: list[str]) -> dict[str, Column]:
    """The values that the keys set, one after the other: of each key the first pattern that matches sets all its groups.

    A group that takes no part in the match is ""; a name that several keys set has the last one's
    value; one that none sets is null.
    """
    out: dict[str, Column] = {}
    for key in keys:
        patterns = rule.get(key, [])
        names = {n for p in patterns for n in group_numbers(p)}
        before = dict(out)
        for name in names:
            value = None
            for p in patterns:
                numbers = group_numbers(p)
                # a pattern without the name leaves what an earlier key has set
                own = F.regexp_extract(source, p, numbers[name]) if name in numbers else before.get(name, F.lit(None).cast("string"))
                hit = source.rlike(p)
                value = F.when(hit, own) if value is None else value.when(hit, own)
            out[name] = value.otherwise(before[name]) if name in before else value
    return out


def matched(pages: DataFrame, source: Column, rule: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """``pages`` with a column for each value of :func:`multi_match`."""
    return pages.withColumns(multi_match(source, rule, keys))


def filled(template: Column, values: dict[str, Column], rounds: int = ROUNDS) -> Column:
    """The template with values in place of their names, again until nothing can change, ``rounds`` times at most; null values and unknown names stay."""
    out = template
    for _ in range(rounds):
        for name, value in values.items():
            for mark in (rf"\\k<{name}>", rf"\k<{name}>"):
                out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit(mark)))
    return out


def consumed(pages: DataFrame, key: str, html: Column, patterns: list[str]) -> DataFrame:
    """``key, n, <names>``: the matches of a list of patterns, taken off the page one after the other.

    At each step the first pattern that is found in the rest of the page counts and the rest begins behind
    it; so all matches of the first pattern come before those that the second finds behind the last of them.
    ``n`` numbers a page's matches from 1; groups that a pattern lacks are null.
    """
    names = sorted({n for p in patterns for n in group_numbers(p)})
    rest, found = html, []
    for p in patterns:
        if re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", p)).match(""):
            raise ValueError(f"the pattern {p} matches nothing at all")
        numbers = group_numbers(p)
        every = F.regexp_extract_all(rest, F.lit(p), F.lit(0))
        groups = [F.regexp_extract_all(rest, F.lit(p), F.lit(numbers[n])) if n in numbers else F.transform(every, lambda _: F.lit(None).cast("string")) for n in names]
        found.append(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names))))
        rest = F.element_at(F.split(rest, p), -1)
    kind = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    rows = pages.select(key, F.posexplode(F.concat(*(f.cast(kind) for f in found))).alias("n", "found"))
    return rows.select(key, (F.col("n") + 1).alias("n"), *(F.col("found")[n].alias(n) for n in names))


def dated(chapters: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``chapters`` (``keys``, ``subdate``, ``subupdate``, ...) with ``subdate`` filled where the page has none.

    From ``stored``, the contents as they were kept: its revision, else its first date, if it has a first date; otherwise
    the chapter's own revision.
    """
    old = stored.select(*keys, F.col("subdate").alias("_first"), F.col("subupdate").alias("_revised")).dropDuplicates(keys)
    kept = F.when(F.col("_first").isNotNull(), F.coalesce("_revised", "_first")).otherwise(F.col("subupdate"))
    return chapters.join(old, keys, "left").withColumn("subdate", F.coalesce("subdate", kept)).drop("_first", "_revised")
