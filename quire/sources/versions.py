"""Chapters with all their versions: intervals of validity, merged batch by batch, and joins as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import removed, stored

#: Folders that works are dealt into.
PARTS = 32
VERSIONS = "work long, chapter string, content string, valid_from timestamp_ntz, valid_to timestamp_ntz, part int"
NAMES = ("work", "chapter", "content", "valid_from", "valid_to")


def intervals(history: DataFrame) -> DataFrame:
    """``work, chapter, content, valid_from, valid_to`` from ``history (work, chapter, at, seq, content)``.

    A null content means that the chapter is gone.  Entries follow each other by ``at`` and ``seq``; of
    equal times the last counts; equal contents in a row are one version; ``valid_to`` is null
    while a version is the last.
    """
    by = Window.partitionBy("work", "chapter").orderBy("at")
    last = history.groupBy("work", "chapter", "at").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))
    # max_by leaves out null contents: the last entry decides
    gone = history.filter("content IS NULL").groupBy("work", "chapter", "at").agg(F.max("seq").alias("gone"))
    last = last.join(gone, ["work", "chapter", "at"], "left").withColumn("content", F.when(F.col("gone") == F.col("seq"), None).otherwise(F.col("content")))
    changed = last.withColumn("before", F.lag("content").over(by)).withColumn("n", F.row_number().over(by)).filter((F.col("n") == 1) | ~F.col("content").eqNullSafe(F.col("before")))
    ends = changed.withColumn("valid_to", F.lead("at").over(by))
    return ends.filter("content IS NOT NULL").select("work", "chapter", "content", F.col("at").alias("valid_from"), "valid_to")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The stored versions, with the folder ``part`` they are in."""
    return spark.read.schema(VERSIONS).parquet(path)


def _folder(work: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(work), F.lit(parts)).cast("int")


def store_versions(history: DataFrame, path: str, first: bool = False, parts: int = PARTS) -> None:
    """Merges a batch of history into the versions at ``path``; ``first``: there are none yet.

    The batch is later than all that is stored.  A chapter's open version ends where the batch has another
    content, and goes on where it has the same.  Closed versions are never read again: only folders
    with works of the batch are rewritten, and of these only rows that the batch touches change.
    """
    spark = history.sparkSession
    if first:
        rows = intervals(history)
        rows.withColumn("part", _folder(F.col("work"), parts)).select(*NAMES, "part").write.partitionBy("part").option("compression", "zstd").parquet(path)
        return
    batch = stored(history.withColumn("part", _folder(F.col("work"), parts)), "batch")
    touched = [r[0] for r in batch.select("part").distinct().collect()]  # at most as many as folders
    old = read_versions(spark, path).filter(F.col("part").isin(touched))
    asked = batch.select("work", "chapter").distinct()
    opened = old.filter("valid_to IS NULL").join(asked, ["work", "chapter"], "left_semi")
    kept = old.filter("valid_to IS NOT NULL").unionByName(old.filter("valid_to IS NULL").join(asked, ["work", "chapter"], "left_anti"))
    before = opened.select("work", "chapter", F.col("valid_from").alias("at"), F.lit(-1).cast("long").alias("seq"), "content")
    merged = intervals(before.unionByName(batch.select("work", "chapter", "at", "seq", "content"))).withColumn("part", _folder(F.col("work"), parts))
    rows = stored(kept.select(*NAMES, "part").unionByName(merged.select(*NAMES, "part")), "merged")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").option("compression", "zstd").parquet(path)
    removed(batch, rows)


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """``work, chapter, content`` as they stood at a time."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("work", "chapter", "content")


def as_of_rows(rows: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """``rows`` (``work``, ``chapter``, a time in ``at``) with the ``content`` of that time, null where there was none: a join by key and interval."""
    v = versions.select(F.col("work").alias("_w"), F.col("chapter").alias("_c"), "content", "valid_from", "valid_to")
    match = (F.col("work") == F.col("_w")) & (F.col("chapter") == F.col("_c")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at)))
    return rows.join(v, match, "left").drop("_w", "_c", "valid_from", "valid_to")


def snapshot_changes(versions: DataFrame, at: Column) -> DataFrame:
    """``work, chapter, old, new, state``: each chapter of the snapshot at a time with the current one.

    A chapter that is gone stays on the old side alone (``gone``); others are ``same`` or ``changed``.  Chapters that
    came later are not in the snapshot.
    """
    old = as_of(versions, at).withColumnRenamed("content", "old")
    now = versions.filter("valid_to IS NULL").select("work", "chapter", F.col("content").alias("new"))
    state = F.when(F.col("new").isNull(), "gone").when(F.col("new") == F.col("old"), "same").otherwise("changed")
    return old.join(now, ["work", "chapter"], "left").withColumn("state", state)
