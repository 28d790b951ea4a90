"""What the corpus operators share: reading, shipping code to executors, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querent.session import ship

__all__ = ["cut", "frugal", "read", "release", "shared_folder", "ship", "small_batches", "trim", "written"]

#: Rows of one Arrow batch sent to Python; whole documents can be long, so batches stay short.
BATCH_ROWS = 500
#: Seconds that the cleaner has between two collections.
PAUSE = 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a session that is one process may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="querent-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the cluster's shared folder (spark.checkpoint.dir), so that losing an
    executor never recomputes, or changes, what later jobs read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same as a Parquet table in the shared folder. Unlike ``checkpoint``, which runs a plan once to
    see it through and again to write it, this runs it once; and later reads take single columns of it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds; long texts make default batches large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles, and checkpoints where the session cleans them, of frames that
    no variable holds any more. Without this they stay until the driver happens to collect its garbage.

    One collection seldom does: what the cleaner takes at the first still holds the shuffles themselves."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(PAUSE)
    spark._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system. A Python worker outlives its tasks, and what its allocators
    keep for themselves counts beside what the next task, and the executor's JVM, need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task over batches, which gives freed memory back when it ends."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return task
