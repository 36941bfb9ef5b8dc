"""Vectors in bounded blocks, for the search operators.

A block is one row: the ids and the matrix of some thousand vectors as bytes.
Queries are packed alike, and blocks of queries meet blocks of vectors once; results
of a query are then merged by rank.  Equal rows are counted before they are dealt, so
that an id or a vector that very many rows have fills no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "dim int, block int, n int, ids binary, keys binary, times binary, data binary"
FOUND = "query_id long, query_key long, vec_id long, score {}, times long"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """``vec_id long, embedding array<double>`` of the rows that take part.

    Left out are null ids, null or empty vectors, vectors with null or non-finite
    components and, unless ``zero``, zero vectors.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    big = F.lit(float("inf"))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)))
    return v if zero else v.filter(F.exists("embedding", lambda x: x != 0))


def counted(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, key, times, dim``: equal rows once; ``key``: a hash of the vector."""
    once = vectors.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("times"))
    return once.withColumn("key", F.xxhash64("embedding")).withColumn("dim", F.size("embedding"))


def blocks(rows: DataFrame, block: F.Column) -> DataFrame:
    """Rows of :data:`BLOCK`: ``rows`` of :func:`counted`, dealt by ``dim`` and ``block``; ids are ascending."""
    grouped = rows.withColumn("block", block.cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "key", "times", "embedding")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(2)[k].values
                dim = batch.column(0)[k].as_py()
                ids, keys, times = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key", "times"))
                data = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = np.lexsort((keys, ids))
                blobs = [ids[order].astype("<i8"), keys[order].astype("<i8"), times[order].astype("<i8"), data[order].astype("<f8")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), batch.column(1).slice(k, 1), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
                    [c.split()[0] for c in BLOCK.split(", ")],
                )

    return grouped.mapInArrow(run, BLOCK)


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys, times and vectors of a block."""
    ids, keys, times = (np.frombuffer(row[prefix + c], "<i8") for c in ("ids", "keys", "times"))
    return ids, keys, times, np.frombuffer(row[prefix + "data"], "<f8").reshape(-1, row["dim"])


def others(ids: np.ndarray, keys: np.ndarray, times: np.ndarray, query_id: int, query_key: int) -> np.ndarray:
    """``times`` without the query's own row."""
    own = (ids == query_id) & (keys == query_key)
    return times - own if own.any() else times


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query: highest score, then smallest ``vec_id``; a row that occurs several times is several."""
    by = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    few = found.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k)
    last = F.sum("times").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumn("last", last).withColumn("first", F.col("last") - F.col("times") + 1).filter(F.col("first") <= k)
    last = F.least("last", F.lit(k).cast("long"))
    each = F.explode(F.sequence(F.col("first").cast("int"), last.cast("int")))
    return ranked.select("query_id", each.alias("rank"), "vec_id", "score", "query_key")
