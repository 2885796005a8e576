"""Stores of the three layouts: relations, document collections and a property graph, loaded once and read many times.

A store is a folder with a marker, one Parquet table per relation, collection, vertex label or edge type. ``reset`` deletes
a store and nothing else. ``once`` gives a query the store of a folder of tables, which the first query of the session loads.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_tessella_store"
_made: dict[tuple[str, str, str], str] = {}


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def create(spark: SparkSession, path: str) -> str:
    """A new store's folder; an error where something is already."""
    files, where = _files(spark, path)
    if files.exists(where):
        raise FileExistsError(path)
    files.mkdirs(where)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(where, MARK)).close()
    return path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(spark._jvm.org.apache.hadoop.fs.Path(where, MARK))


def reset(spark: SparkSession, path: str) -> bool:
    """Delete a store. False where there is none; a folder without the mark is an error and stays."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return False
    if not exists(spark, path):
        raise ValueError(f"{path} is no store")
    return files.delete(where, True)


def load(df: DataFrame, path: str, name: str, by: str | None = None) -> None:
    """One table of a store; ``by``: rows lie in ranges of this column, so that a filter on it skips files and row groups."""
    rows = df.repartitionByRange(F.col(by)).sortWithinPartitions(by) if by else df
    rows.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def root(spark: SparkSession) -> str:
    """Where a session's own stores lie: spark.checkpoint.dir, or a temporary folder under a local master."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"file://{os.path.abspath(tempfile.gettempdir())}/stores"


def once(spark: SparkSession, sf_dir: str, layout: str, fill: Callable[[str], None]) -> str:
    """The session's store of a layout over ``sf_dir``; loaded by ``fill`` at first, deleted when the driver ends."""
    key = spark.sparkContext.applicationId, sf_dir, layout
    if key not in _made:
        path = create(spark, f"{root(spark)}/{layout}-{uuid.uuid4().hex}")
        files, where = _files(spark, path)
        files.deleteOnExit(where)
        fill(path)
        _made[key] = path
    return _made[key]
