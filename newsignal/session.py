"""Session helpers: a local session for tests, and the shared scratch folder of a cluster."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = 8, name: str = "newsignal", shared: str | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings their own. ``shared`` becomes
    ``spark.checkpoint.dir``, so that the caller can delete what intermediate results leave there."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    The root is the cluster's ``spark.checkpoint.dir``, or the checkpoint folder set on the
    context. A machine-local folder is used only in local mode, where both are normally absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="newsignal-")
    return f"{root.rstrip('/')}/newsignal/{purpose}-{uuid.uuid4().hex}"


def durable(spark: SparkSession, df: DataFrame, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    Used where one result feeds several branches: what lies below it is computed once, a lost
    executor does not bring it back, later steps read only the columns they need, and the
    optimizer knows the size.
    """
    path = f"{folder or shared_dir(spark, 'durable')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Share of the driver's heap limit from which its garbage is collected between steps.
HEAP_SHARE = 0.5


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage if its heap has grown past ``HEAP_SHARE`` of its limit, so that the JVM gives memory back.

    For work of many steps: plans and broadcasts of steps that are done need a small part of the heap, but the JVM lets it grow
    to the limit first, however small that part, and keeps what it took. Shuffle files that nothing reads any more go with them.
    """
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()  # what Python still holds of the JVM's objects
        spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``durable`` for intermediate results of a run, which are deleted at its end; pressed harder, as they hold texts."""
    folder = shared_dir(spark, "run")
    try:
        yield lambda df: durable(spark, df, folder, "zstd")
    finally:
        delete(spark, folder)


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counts (the rows, and how many meet the given conditions) that come for free with the next write of it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in counts.items())), seen


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


# Rows up to which a side of a join is sent to every executor: some tens of megabytes.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else left to the optimizer.

    For word lists and the like, whose size the optimizer does not know when they come from the
    driver. The check reads at most ``rows`` + 1 rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
