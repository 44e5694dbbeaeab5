"""Helpers shared by the text operators: shared storage, sizes, column hygiene."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch_dir, shared_dir, written

__all__ = ["checkpointed", "turn", "id_text", "n_groups", "partitions", "positional", "scratch_dir", "shared_dir", "size_in_bytes", "text_bytes", "written"]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; a written table is computed once, a checkpoint twice."""
    return written(df, "lineage")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (file sizes for scans); where it has none, the texts are measured."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else int(df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def n_groups(df: DataFrame, target: int = 16 << 20) -> int:
    """Number of document groups: a group holds about ``target`` stored bytes at most."""
    spark = df.sparkSession
    return max(2 * partitions(spark), -(-size_in_bytes(df) // target))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand at a time, where the session has Spark's default of ten thousand.

    A batch is held several times over, by the JVM outside of its heap and by the worker.
    """
    if spark.sparkContext.getConf().get(BATCH_ROWS, None) is None and spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


_TURN: list = [None, None]


def turn(name: str, forget: Callable[[], object] | None = None) -> None:
    """In a Python worker: what the operator before remembers is forgotten when another one begins.

    Workers serve one stage after the other; without this the tables of all operators that a job has been
    through would stay. ``forget`` empties what this operator remembers.
    """
    if _TURN[0] == name:
        return
    if _TURN[1]:
        _TURN[1]()
    _TURN[:] = [name, forget]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string, null becomes empty); other columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns as c0, c1, ... so that no added name can clash, and each name's new one."""
    small_batches(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), dict(zip(docs.columns, plain, strict=True))


def text_bytes(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value (null: empty)."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]
