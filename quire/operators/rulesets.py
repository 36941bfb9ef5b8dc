"""Rule sets that extend each other: lines of descent as a fixed point of joins, settings overlaid by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import removed, stored


def lineage(links: DataFrame) -> DataFrame:
    """``name, ancestor, distance, state``: each rule set with itself (0) and all it extends, nearest first.

    ``links`` has ``name`` and ``parent`` (null: extends nothing), a name once.  ``state``: ``found``, ``missing``
    for a parent that is no name, ``cycle`` for one that stands in the line already; such ends lead no
    further.  Each round is a join of the open ends with the links, and is written; rounds end when no end is open, after
    the longest line.
    """
    known = stored(links.select("name", "parent").filter("name IS NOT NULL").groupBy("name").agg(F.min("parent").alias("parent")), "links")
    by = known.select(F.col("name").alias("ancestor"), F.col("parent").alias("next"))
    front = known.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("distance"), F.array("name").alias("line"))
    rounds: list[DataFrame] = []
    while True:
        met = front.join(by.withColumn("known", F.lit(True)), "ancestor", "left")
        again = F.size(F.filter("line", lambda x: x == F.col("ancestor"))) > 1
        state = F.when(again, "cycle").when(F.col("known").isNull(), "missing").otherwise("found")
        rounds.append(stored(met.select("name", "ancestor", "distance", "line", state.alias("state"), "next"), "round"))
        opened = rounds[-1].filter("state = 'found' AND next IS NOT NULL")
        if opened.isEmpty():
            break
        front = opened.select("name", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"), F.concat("line", F.array("next")).alias("line"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    found = stored(out.select("name", "ancestor", "distance", "state"), "lineage")
    removed(known, *rounds)
    return found


def effective(settings: DataFrame, lines: DataFrame) -> DataFrame:
    """``name, path, value, origin``: what holds for each rule set.

    ``settings`` has ``name``, ``path`` (``a.b.c`` for nested ones) and ``value``; ``lines`` is a :func:`lineage`.
    Of equal paths the nearest rule set's value holds.  A nearer plain value hides all that a farther one has
    below its path, and nearer settings below a path hide a farther plain value there; so maps
    are merged in depth and anything else is replaced.
    """
    have = lines.filter("state = 'found'").join(settings.select(F.col("name").alias("ancestor"), "path", "value"), "ancestor")
    nearest = have.groupBy("name", "path").agg(F.min(F.struct("distance", "value", "ancestor")).alias("s")).select("name", "path", "s.distance", "s.value", F.col("s.ancestor").alias("origin"))
    # every path with the paths above it: the joins below are by name and path
    words = F.split("path", r"\.")
    above = nearest.filter(F.size(words) > 1).select("name", F.col("path").alias("below"), F.col("distance").alias("below_at"), F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), "."))).alias("path"))
    pairs = above.join(nearest.select("name", "path", "distance"), ["name", "path"])
    hidden = pairs.filter("distance < below_at").select("name", F.col("below").alias("path")).unionByName(pairs.filter("below_at < distance").select("name", "path")).distinct()
    return nearest.join(hidden, ["name", "path"], "left_anti").select("name", "path", "value", "origin")


def with_access(own: DataFrame, links: DataFrame, group: str = "access") -> DataFrame:
    """``own`` (of :func:`effective`) with what ``links (name, parent)`` take from another rule set: its ``group`` only, behind the rule set's own."""
    inside = own.filter((F.col("path") == group) | F.col("path").startswith(group + "."))
    lent = links.select("name", F.col("parent").alias("_from")).join(inside.withColumnRenamed("name", "_from"), "_from").drop("_from")
    both = own.withColumn("distance", F.lit(0)).unionByName(lent.withColumn("distance", F.lit(1)))
    lines = both.select("name", F.concat_ws("\u0000", "name", F.col("distance").cast("string")).alias("ancestor"), "distance", F.lit("found").alias("state")).distinct()
    settings = both.select(F.concat_ws("\u0000", "name", F.col("distance").cast("string")).alias("name"), "path", "value")
    merged = effective(settings, lines).drop("origin")
    origin = both.groupBy("name", "path").agg(F.min_by("origin", "distance").alias("origin"))
    return merged.join(origin, ["name", "path"])
