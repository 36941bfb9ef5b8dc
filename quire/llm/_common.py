"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and Spark runs in one process a
    temporary folder is used and set as the checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quire-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that Python gets at once while a table is written, one row at least.
BATCH_BYTES = 4 << 20
_scopes: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks it held, not the
    steps before.  The shuffle files of the steps before go as soon as it is written.
    Python gets ``BATCH_BYTES`` at once meanwhile, and ``batch_rows`` rows at most if that is given.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _BATCH: spark.conf.get(_BATCH), _BATCH_BYTES: spark.conf.get(_BATCH_BYTES, None)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` returned and nobody reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is :func:`written` inside at its end, but for tables given to the function it yields.

    Kept tables pass to the scope around it, if there is one.
    """
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append([])
    try:
        yield keep
    finally:
        for df in _scopes.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _scopes:
                _scopes[-1].append(df)


def memory_returned() -> None:
    """Gives memory that a Python worker has freed back to the system; workers stay for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty); other columns are not read."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
