"""Writes as copy-on-write transformations: each returns the table's next state; ``returning`` the affected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def insert_select(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows get ids from the table's largest on. Ids come from per-partition counts, not from one global window."""
    top = F.broadcast(table.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top")))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__lo"))
    starts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    new = ranged.join(F.broadcast(starts.select("__p", "__s", "__lo")), "__p").crossJoin(top)
    return table.unionByName(new.withColumn(key, F.col("__top") + F.col("__s") + F.col("__i") - F.col("__lo") + 1).select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str, update: dict[str, Column] | None, when: Column | None = None) -> DataFrame:
    """Rows whose key is new go in; others change the old row by ``update`` (over ``old.*`` and ``new.*``) where ``when`` holds, or do nothing."""
    old, new = table.alias("old"), rows.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    here, there = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    change = here & there & (when if when is not None else F.lit(True))
    cols = []
    for c in table.columns:
        kept = F.when(change, update[c]).otherwise(F.col(f"old.{c}")) if update and c in update else F.col(f"old.{c}")
        cols.append(F.when(here, kept).otherwise(F.col(f"new.{c}")).alias(c))
    return both.select(*cols)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def update_from(table: DataFrame, source: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: ``source`` has one row per key; ``values`` may name its columns."""
    joined = table.join(source.withColumn("__hit", F.lit(True)), key, "left")
    return joined.select(*(F.when(F.col("__hit"), values[c]).otherwise(table[c]).alias(c) if c in values else table[c] for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return table.join(source, key, "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone`` (one column, the key) and edges without theirs."""
    ids = gone.select(F.col(gone.columns[0]).alias("__g"))
    left = edges.join(ids, edges["src"] == ids["__g"], "left_anti")
    return nodes.join(ids, nodes[key] == ids["__g"], "left_anti"), left.join(ids, left["dst"] == ids["__g"], "left_anti")


def returning(table: DataFrame, where: Column, columns: list[Column]) -> DataFrame:
    return table.filter(where).select(*columns)
