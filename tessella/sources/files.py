"""File sources and sinks: checked CSV, JSON lines (plain and extended), measurement log, latency matrix, sizes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV whose header must be the schema's names in order; empty fields are null. The check is made as files are read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: The wrappers of extended JSON and the types that they stand for.
_WRAPPERS = {"$date": "timestamp", "$numberLong": "bigint", "$numberInt": "int", "$numberDouble": "double", "$oid": "string"}


def _unwrap(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _unwrap(x, kind.elementType))
    if not isinstance(kind, T.StructType):
        return col
    if len(kind) == 1 and kind[0].name in _WRAPPERS:
        inner = col.getField(kind[0].name)
        if kind[0].name == "$date" and isinstance(kind[0].dataType, T.StructType):  # dates outside the common years are milliseconds
            return F.timestamp_millis(inner.getField("$numberLong").cast("bigint"))
        return inner.cast(_WRAPPERS[kind[0].name])
    return F.when(col.isNotNull(), F.struct(*(_unwrap(col.getField(f.name), f.dataType).alias(f.name) for f in kind)))


def read_jsonl(spark: SparkSession, path: str, extended: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; with ``extended`` the wrapped dates, numbers and ids become plain values at every depth."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df.select(*(_unwrap(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema)) if extended else df


def write_jsonl(df: DataFrame, path: str, extended: bool = False) -> None:
    if extended:
        as_date = lambda c: F.struct(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("$date"))
        df = df.select(*(F.when(F.col(f.name).isNotNull(), as_date(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))
    df.write.mode("overwrite").json(path)


LOG = "id string, label string, is_write boolean, content string, plan string, times array<double>"


def append_measurements(rows: DataFrame, path: str) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(LOG))).write.mode("append").parquet(path)


def pending(spark: SparkSession, ids: DataFrame, path: str) -> DataFrame:
    """The ids not yet in the log at ``path``; all, if there is no log."""
    try:
        done = spark.read.schema(LOG).parquet(path).select("id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return ids
    return ids.join(done, "id", "left_anti")


def latency_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, layout, latency_ms) from JSON lines, one row per pair and no latency negative or missing; the header line has no query."""
    df = spark.read.schema("query_id string, layout string, latency_ms double").json(path).filter(F.col("query_id").isNotNull())
    bad = (F.col("layout").isNull() | F.col("latency_ms").isNull() | (F.col("latency_ms") < 0)).cast("int")
    wrong = df.groupBy("query_id", "layout").agg(F.count("*").alias("n"), F.max(bad).alias("bad")).filter("n > 1 OR bad = 1").limit(1).collect()
    if wrong:
        raise ValueError(f"latency matrix: repeated or invalid entry {wrong[0]}")
    return df


def stored(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """One row: the bytes of a table's files (from their listing, contents unread) and its number of records."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return size.crossJoin(records.agg(F.count("*").alias("records")))  # one row each


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, the same in each run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose share of the weights holds ``u``."""
    total, upto, out = sum(weights), 0.0, None
    for v, w in zip(values, weights, strict=True):
        upto += w / total
        out = F.when(u < upto, F.lit(v)) if out is None else out.when(u < upto, F.lit(v))
    return out.otherwise(F.lit(values[-1]))
