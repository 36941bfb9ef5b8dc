"""Text files of the library: settings, tables, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import listing as L

#: The columns of the table that is exchanged.
CSV_COLUMNS = ("id", "title", "author", "sitename", "toc_url", "novel_type", "tags", "frozen", "last_update", "general_lastup")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """``file, section, name, value, boolean, integer, float, text`` of INI files; lines before any section have none.

    A file's lines stay in order within its whole text, so that each line finds its section.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", r"(?m)^(?=\s*\[)")).alias("block"))
    section = F.nullif(F.regexp_extract("block", r"^\s*\[([^\]\n]*)\]", 1), F.lit(""))
    lines = files.select("file", section.alias("section"), F.explode(F.split("block", r"\r?\n")).alias("line"))
    name, value = V.setting_line(F.col("line"))
    rows = lines.select("file", "section", name.alias("name"), value.alias("value")).filter(F.col("name").isNotNull())
    return rows.select("*", *(c.alias(n) for n, c in V.typed(F.col("value")).items()))


def works_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a heading that has ``url``; rows without an address do not count."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if "url" not in rows.columns:
        raise ValueError("the heading lacks url")
    return rows.filter(F.col("url").isNotNull())


def csv_columns(works: DataFrame) -> DataFrame:
    """The works as :data:`CSV_COLUMNS`: labels instead of kinds, tags joined, times as seconds, 0 for none."""
    seconds = lambda c: F.coalesce(F.unix_timestamp(F.to_timestamp_ltz(F.col(c).cast("string"))), F.lit(0))
    own = {"novel_type": L.type_label(), "tags": F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), "frozen": F.col("frozen").cast("string"), "last_update": seconds("last_update"), "general_lastup": seconds("new_arrivals")}
    return works.select(*(own.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS))


def write_csv(works: DataFrame, path: str) -> None:
    csv_columns(works).write.csv(path, header=True)


def chapter_name(position: Column, subtitle: Column) -> Column:
    return F.concat(position.cast("string"), F.lit(" "), T.file_name(subtitle), F.lit(".txt"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Texts of ``chapters (work, position, subtitle, body)``, a folder for each work, with the names of the files in a column.

    Each row keeps its ``name``; the store splits files as it sees fit.
    """
    rows = chapters.select("work", chapter_name(F.col("position"), F.col("subtitle")).alias("name"), F.col("body").alias("text"))
    rows.repartition("work").sortWithinPartitions("work", "name").write.partitionBy("work").option("compression", "zstd").parquet(path)


def upsert_into(stored: DataFrame, merged: DataFrame, path: str, partition: str) -> None:
    """Writes only those partitions of the table at ``path`` whose rows the merge has changed."""
    changed = merged.exceptAll(stored).select(partition).union(stored.exceptAll(merged).select(partition)).distinct()
    rows = merged.join(changed, partition, "left_semi").select(*merged.columns)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def catalogues(spark: SparkSession, root: str, nested: list[str]) -> DataFrame:
    """The catalogue at ``root`` and those below it; nested files that cannot be read are left out."""
    from quire.operators.catalogue import merged_catalogues

    master = spark.read.parquet(root)
    if not nested:
        return merged_catalogues(master, master.limit(0))
    rest = spark.read.option("ignoreCorruptFiles", "true").schema(master.schema).parquet(*nested)
    return merged_catalogues(master, rest)
