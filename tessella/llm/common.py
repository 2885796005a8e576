"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold (one row at least), so that a batch of very long texts stays small.
ARROW_ROWS, ARROW_BYTES = 256, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by whatever file system Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master has a temporary folder of its own; a cluster has none, which is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"file://{os.path.abspath(tempfile.gettempdir())}/checkpoints"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; cuts the lineage and survives lost executors.

    The folder goes when the driver ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, where = _files(df.sparkSession, path)
        files.delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_ROWS rows and ARROW_BYTES: texts have no length limit. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


#: What a worker keeps of the words and files it has seen; ``tidy`` tasks leave none of it behind, whichever task it comes from.
CACHES: list[dict] = []


def forget() -> None:
    """Empty this process's caches and give their memory back to the system."""
    for kept in CACHES:
        kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """A mapInArrow task that gives its memory back at its end: workers are used again by tasks that need theirs."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            forget()  # a function of the module: CACHES named here would go to the worker as a copy of the driver's

    return task


def utf8(column: str):
    """A text column as bytes, so that Python workers get UTF-8 without decoding it."""
    return F.col(column).cast("binary")


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def private(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
