"""The library's tables: schema-tolerant reads, and views of stored tables as works and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; only the columns that a query names are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_columns_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with exactly these columns (name: type); those of an older layout that it lacks are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def works(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue: ``documents`` with what ``labels`` says of them.

    ``id, title, sitename, length, tags, frozen, finished``; ``finished`` is null where unknown.
    """
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("sitename"),
        F.greatest("n_chars", F.lit(0)).alias("length"),
        F.array("lang", "source", size).alias("tags"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("frozen"),
        (F.col("quality") == 1).alias("finished"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue with all its columns, derived from ``documents`` and ``labels``.

    ``id, title, author, sitename, lang, toc_url, novel_type, length, tags, frozen, finished,
    suspended, last_update, new_arrivals, episodes``.
    """
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    i = F.col("doc_id")
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    hours = i * 7 % 9000

    def later(n):
        return start + F.make_dt_interval(F.lit(0), n.cast("int"))

    none = F.array().cast("array<string>")
    joined = docs.join(labels, "doc_id", "left")
    end = F.when(F.coalesce(F.col("quality") == 1, F.lit(False)), F.array(F.lit("end"))).otherwise(none)
    gone = F.when(i % 31 == 0, F.array(F.lit("404"))).otherwise(none)
    return joined.select(
        i.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("author"), (i % 97).cast("string")).alias("author"),
        F.col("source").alias("sitename"),
        "lang",
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/n"), i.cast("string"), F.lit("ab/")).alias("toc_url"),
        F.when(F.col("n_chars") < 500, 2).when(i % 5 == 0, 0).otherwise(1).alias("novel_type"),
        F.greatest("n_chars", F.lit(0)).alias("length"),
        F.concat(F.array("lang", "source", size), end, gone).alias("tags"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("frozen"),
        (F.col("quality") == 1).alias("finished"),
        (i % 29 == 0).alias("suspended"),
        later(hours).alias("last_update"),
        F.when(i % 3 == 0, None).otherwise(later(hours + i % 10 - 5)).alias("new_arrivals"),
        F.when(i % 7 == 0, None).otherwise(i % 400).alias("episodes"),
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """``work, position, subtitle, body`` from ``conversations``."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("position"), F.col("role").alias("subtitle"), F.col("text").alias("body"))


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Replacement pairs from a text file: two fields split at the first tab; lines that begin with ``;`` do not count."""
    pair = F.split("value", "\t", 2)
    return spark.read.text(path).filter(~F.col("value").startswith(";") & (F.size(pair) == 2)).select(pair[0].alias("old"), pair[1].alias("new"))


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """``url, options`` of a watch list: one address a line, ``#`` comments, ``| key=value`` options."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    parts = spark.read.text(path).select(F.split(line, r"\s*\|\s*").alias("p"))
    options = F.map_from_entries(F.transform(F.filter(F.slice("p", F.lit(2), F.size("p")), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))
    return parts.select(F.col("p")[0].alias("url"), options.alias("options")).filter(F.col("url").rlike("^https?://"))
