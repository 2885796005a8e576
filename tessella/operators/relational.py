"""Relational operators that Spark has no keyword for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under an order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the rank filter lets Spark limit groups before the shuffle."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def band_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal key with right_time in (left_time, left_time + seconds]: both sides meet in time buckets as an equi-join."""
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    a = left.withColumn("__b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("__c", bucket(right_time))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))
    return a.join(b, (a[key] == b[key]) & (a["__b"] == b["__c"]) & (b[right_time] > a[left_time]) & (b[right_time] <= a[left_time] + span)).drop("__b", "__c")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str, seconds: int = 86_400) -> DataFrame:
    """The latest right value at or before each left row.

    Both sides meet in time buckets of ``seconds``, each a window of its own; the last value of a bucket is carried to the
    later ones of its key over one row per bucket, so a hot key is no hot task. Null values are no values.
    """
    rows = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__s", F.lit(1))
    seen = right.select(key, time, F.col(value).alias("__v")).withColumn("__s", F.lit(0))
    bucket = F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds)
    both = rows.unionByName(seen, allowMissingColumns=True).withColumn("__b", bucket)
    within = W.partitionBy(key, "__b").orderBy(time, "__s").rowsBetween(W.unboundedPreceding, 0)
    ends = seen.filter("__v IS NOT NULL").groupBy(F.col(key).alias("__k"), bucket.alias("__c")).agg(F.max_by("__v", time).alias("__e"))
    named = both.withColumn("__own", F.last("__v", ignorenulls=True).over(within)).filter("__s = 1")
    asked = named.select(key, "__b").distinct()
    marks = ends.select(F.col("__k").alias(key), F.col("__c").alias("__b"), "__e").unionByName(asked.withColumn("__e", F.lit(None).cast(right.schema[value].dataType)))
    carried = marks.groupBy(key, "__b").agg(F.max("__e").alias("__e"))
    before = carried.withColumn("__before", F.last("__e", ignorenulls=True).over(W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__e")
    return named.join(before, [key, "__b"], "left").withColumn(name, F.coalesce("__own", "__before")).select(*left.columns, name)


def densify(df: DataFrame, time: str, unit: str, aggs: list[Column]) -> DataFrame:
    """Aggregates per time unit, with a row for every unit between the first and the last."""
    day = F.date_trunc(unit, F.col(time)).cast("timestamp_ntz")
    got = df.groupBy(day.alias(time)).agg(*aggs)
    ends = got.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    steps = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias(time))
    return steps.join(got, time, "left")


def bucket(df: DataFrame, column: str, bounds: list[float], default: str = "other") -> DataFrame:
    """Counts per half-open range, keyed by its lower bound."""
    case = F.lit(default)
    for lo, hi in reversed(list(zip(bounds, bounds[1:], strict=False))):
        case = F.when((F.col(column) >= lo) & (F.col(column) < hi), F.lit(str(lo))).otherwise(case)
    return df.groupBy(case.alias("bucket")).agg(F.count("*").alias("n"))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before in the order: ranges of rows are summed by themselves and start at the ranges' totals."""
    ranged = df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    totals = ranged.groupBy("__p").agg(F.sum(value).alias("__n"))
    starts = totals.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__p").withColumn(name, F.col("__from") + F.col("__own")).drop("__p", "__own", "__from")


def bucket_auto(df: DataFrame, column: str, n: int) -> DataFrame:
    """About n buckets of equal counts; equal values never part. Ranks come from counts per value, summed by ranges of values."""
    per = df.groupBy(column).agg(F.count("*").alias("c"))
    total = per.agg(F.sum("c").alias("t"))
    upto = running_total(per, column, "c", "before").crossJoin(F.broadcast(total))
    return upto.groupBy(F.floor(F.col("before") * n / F.col("t")).cast("int").alias("bucket")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum("c").alias("n"))


def facet(branches: dict[str, DataFrame]) -> DataFrame:
    """One row with an array of structs per branch: a branch must have few rows (aggregates or a limit), as each becomes one value."""
    out = None
    for name, df in branches.items():
        one = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def scattered(key: str) -> Column:
    """A whole number in [0, 2^31) that scatters whole keys, the same in any engine."""
    return F.col(key).cast("long") % F.lit(1 << 31) * F.lit(1103515245) % F.lit(1 << 31)


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """Exactly n rows, by scattered keys: repeatable, and a top-n rather than a full sort."""
    return df.orderBy(scattered(key), key).limit(n)


def sample_share(df: DataFrame, share: float, key: str) -> DataFrame:
    """About this share of the rows, each kept or not by its key alone: no shuffle, and the same rows at any partitioning."""
    return df.filter(scattered(key) < F.lit(int(share * (1 << 31))))
