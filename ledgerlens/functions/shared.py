"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_LOCK = Lock()
T = TypeVar("T")


def together(*makers: Callable[[], T]) -> list[T]:
    """The results of jobs that do not need each other, submitted at once; the first error is raised."""
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return [f.result() for f in [pool.submit(m) for m in makers]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master gets a temporary folder; a cluster gets an error, as its
    executors would write to their own disks.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared one; the driver deletes it when it ends."""
    app = spark.sparkContext.applicationId
    as_path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    with _LOCK:
        root = _ROOTS.get(app)
        if root is None or not as_path(root).getFileSystem(settings).exists(as_path(root)):
            root = f"{shared_dir(spark)}/ledgerlens-{app}-{uuid.uuid4().hex[:8]}"
            files = as_path(root).getFileSystem(settings)
            files.mkdirs(as_path(root))
            files.deleteOnExit(as_path(root))
            _ROOTS[app] = root
        return root


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, without lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
