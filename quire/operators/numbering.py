"""Numbers for all rows of a result in order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import stored


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order, from 1.

    Rows are sorted by ranges and written; each range is numbered on its own, from behind the number of rows
    of the ranges before it.  Only these numbers, one a range, meet in one task.  The order must tell rows apart,
    or equal ones are numbered as it happens.
    """
    rows = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.join(F.broadcast(before), "_range").withColumn(name, place.cast("bigint")).drop("_range", "_before")
