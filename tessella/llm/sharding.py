"""Sharding over fixed virtual slots, in DataFrame functions only.

A record's virtual slot is a hash of its id, its size and its text's CRC modulo a fixed number of slots and never
changes, so different texts under one id spread over the slots. Equal records that together hold more than a slot's
even share of all bytes (at most as many kinds of them as there are slots) are spread over ``SPREAD`` slots by their
places in the input, as no other mark tells them apart.
Bytes and rows are added up per slot; a versioned map sends each slot to a shard. Version 1 deals the slots,
largest first, each to the shard with the fewest bytes so far; ``rebalance`` edits a stored map into its next
version and moves only the slots that it must. All of a map's work is on one row per slot, however many
records there are. ``store`` keeps every version; records are placed by the map as stored.

Defined results: a null text has no bytes (size 1) and the CRC of an empty text; a null id is hashed as a null;
repeated rows are separate records with slots of their own place; ties go to the smaller slot and shard;
an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import shared_dir, table

SLOTS = 4096
SHARDS = 8
#: Slots that equal records may go to where they are many.
SPREAD = 1024


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    kinds = rows.groupBy(kind).agg(F.sum("size").alias("bytes"))
    many = kinds.crossJoin(F.broadcast(rows.agg(F.sum("size").alias("all")))).filter(F.col("bytes") * slots > F.col("all")).filter(F.col("bytes") > F.col("size"))
    many = many.select(*(F.col(c).alias(f"m_{c}") for c in kind), F.lit(SPREAD).alias("spread"))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("size") == F.col("m_size")) & (F.col("text_crc32") == F.col("m_text_crc32"))
    placed = rows.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(many), same, "left")
    nth = F.coalesce(F.col("at") % F.col("spread"), F.lit(0))
    return placed.select(*kind, F.pmod(F.xxhash64(*kind, nth), F.lit(slots)).cast("int").alias("vslot"))


def slot_stats(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, n_rows): at most as many rows as there are slots."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def deal(stats: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """(vslot, shard, version, bytes, n_rows): slots by size, each to the shard with the fewest bytes so far."""
    ordered = stats.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "n_rows"))).alias("o"))
    dealt = f"""
        aggregate(o,
            struct(array_repeat(0L, {shards}) AS loads, CAST(array() AS array<struct<vslot:int,shard:int,bytes:bigint,n_rows:bigint>>) AS got),
            (a, x) -> struct(
                transform(a.loads, (v, i) -> IF(i + 1 = array_position(a.loads, array_min(a.loads)), v - x.less, v)) AS loads,
                array_append(a.got, struct(x.vslot AS vslot, CAST(array_position(a.loads, array_min(a.loads)) - 1 AS int) AS shard, -x.less AS bytes, x.n_rows AS n_rows)) AS got),
            a -> a.got)"""
    return ordered.select(F.inline(F.expr(dealt))).withColumn("version", F.lit(version))


def rebalance(current: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version of a map for ``shards`` shards: an overfull shard gives its smallest slots, and no more
    than its surplus over the new mean; a removed shard gives all. The given slots are dealt to the shards with room.
    """
    total = current.agg((F.sum("bytes") / shards).alias("mean"))
    w = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    kept = current.crossJoin(F.broadcast(total)).withColumn("kept", (F.col("shard") < shards) & (F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)) <= F.col("mean")))
    loads = kept.filter("kept").groupBy("shard").agg(F.sum("bytes").alias("b"))
    every = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    start = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("start"))
    moved = kept.filter("NOT kept").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "n_rows"))).alias("o"))
    dealt = """
        aggregate(o,
            struct(start AS loads, CAST(array() AS array<struct<vslot:int,shard:int,bytes:bigint,n_rows:bigint>>) AS got),
            (a, x) -> struct(
                transform(a.loads, (v, i) -> IF(i + 1 = array_position(a.loads, array_min(a.loads)), v - x.less, v)) AS loads,
                array_append(a.got, struct(x.vslot AS vslot, CAST(array_position(a.loads, array_min(a.loads)) - 1 AS int) AS shard, -x.less AS bytes, x.n_rows AS n_rows)) AS got),
            a -> a.got)"""
    given = moved.crossJoin(F.broadcast(start)).select(F.inline(F.expr(dealt)))
    return kept.filter("kept").select("vslot", "shard", "bytes", "n_rows").unionByName(given).withColumn("version", F.lit(version))


_MAP = "vslot int, shard int, bytes long, n_rows long, version int"


def store(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable below ``version=``."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One version of a stored map."""
    return spark.read.schema(_MAP).parquet(path).filter(F.col("version") == version)


def places(slot_map: DataFrame) -> DataFrame:
    """(vslot, shard, before): how many records of the shard stand in earlier slots."""
    w = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    return slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).alias("before"))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its gapless place there. The map has one row per slot, so it is broadcast."""
    w = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("n", F.row_number().over(w) - 1)
        .join(F.broadcast(places(slot_map)), "vslot")
        .withColumn("slot", (F.col("before") + F.col("n")).cast("long"))
        .drop("n", "before")
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    rows = records(table(spark, sf_dir, "documents"))
    path = f"{shared_dir(spark)}/tessella/slot-map-{uuid.uuid4().hex}"
    store(deal(slot_stats(rows)), path)
    store(rebalance(stored(spark, path, 1), SHARDS + 1, 2), path)
    placed = assign(rows, stored(spark, path, 1))
    grown = stored(spark, path, 2).select("vslot", F.col("shard").alias("shard_v2"))
    placed = placed.join(F.broadcast(grown), "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "shard_v2")
