"""Task states, message history and arrivals; each also works on a finished table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """``task, status, ts``: of each task the last event; a grouped maximum, for streams and tables alike."""
    return events.groupBy("task").agg(F.max(F.struct("ts", "event_id", "status")).alias("last")).select("task", F.col("last.status").alias("status"), F.col("last.ts").alias("ts"))


def merged_messages(events: DataFrame, keep: int = 60) -> DataFrame:
    """Runs of equal messages of a task as one, with their number; the last ``keep`` of each task."""
    by = Window.partitionBy("task").orderBy("ts", "event_id")
    changed = F.coalesce((F.col("status") != F.lag("status").over(by)).cast("int"), F.lit(1))
    return _last_runs(events.withColumn("changed", changed), by, keep)


def console(events: DataFrame, keep: int = 60) -> DataFrame:
    """The last ``keep`` messages of a task: dots that follow each other are one growing message, those marked ``no_history`` go."""
    by = Window.partitionBy("task").orderBy("ts", "event_id")
    shown = events.filter(~F.coalesce("no_history", F.lit(False)))
    again = (F.col("status") == ".") & (F.lag("status").over(by) == ".")
    return _last_runs(shown.withColumn("changed", F.when(again, 0).otherwise(1)), by, keep)


def _last_runs(events: DataFrame, by, keep: int) -> DataFrame:
    runs = events.withColumn("run", F.sum("changed").over(by))
    merged = runs.groupBy("task", "run").agg(F.first("status").alias("status"), F.count(F.lit(1)).alias("times"))
    newest = F.row_number().over(Window.partitionBy("task").orderBy(F.col("run").desc()))
    return merged.withColumn("rank", newest).filter(F.col("rank") <= keep).select("task", "run", "status", "times")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each status by window of event time; later than ``late`` does not count in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def store_arrivals(batch: DataFrame, path: str, keys: list[str]) -> None:
    """For ``foreachBatch``: appends the rows whose key the stored table lacks."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


#: The states a task may go to from each state; a new task is queued.
NEXT = {"queued": ("running", "canceled"), "running": ("completed", "failed", "canceled"), "failed": ("queued",)}


def allowed(before: Column, after: Column) -> Column:
    """Whether a task may go from one state (null: none yet) to another."""
    out = F.when(before.isNull(), after == "queued")
    for state, to in NEXT.items():
        out = out.when(before == state, after.isin(*to))
    return out.otherwise(False)


def may_retry(state: Column, retries: Column, limit: Column) -> Column:
    return (state == "failed") & (retries < limit)
