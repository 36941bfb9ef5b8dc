"""The page queue: pages in the order of breadth-first search, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import removed, stored


def page_levels(roots: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """``root, page, level``: every page that links lead to from a root, with the fewest links on the way.

    ``roots`` has ``root`` and ``page``, ``links`` has ``page`` and ``target``, another page.  ``most``: levels that are
    followed; pages beyond are left out.  One round of joins a level: pages of all levels before are taken off,
    and rounds end when none is new.  Null pages and targets lead nowhere.
    """
    edges = stored(links.select("page", "target").dropna().distinct(), "links")
    seen = stored(roots.select("root", "page").dropna().distinct().withColumn("level", F.lit(0)), "level0")
    levels, level = [seen], 0
    while most is None or level < most:
        level += 1
        now = levels[-1].select("root", "page").join(edges, "page").select("root", F.col("target").alias("page")).distinct()
        new = stored(now.join(_together(levels).select("root", "page"), ["root", "page"], "left_anti").withColumn("level", F.lit(level)), f"level{level}")
        levels.append(new)
        if new.isEmpty():
            break
    found = stored(_together(levels), "levels")
    removed(edges, *levels)
    return found


def _together(levels: list[DataFrame]) -> DataFrame:
    return levels[0].sparkSession.read.schema(levels[0].schema).parquet(*(df.path for df in levels))


def shared_links(links: DataFrame) -> DataFrame:
    """``page, target`` for :func:`page_levels` where pages are linked by what both name.

    ``links`` has ``page`` and ``href``; a step from page to page goes by a node for each ``href``, so that one that very many pages
    name costs its links and not their pairs; levels then count two for each step.
    """
    node = F.concat(F.lit("href "), F.col("href"))
    page = F.concat(F.lit("page "), F.col("page").cast("string"))
    return links.dropna().select(page.alias("page"), node.alias("target")).unionByName(links.dropna().select(node.alias("page"), page.alias("target")))
