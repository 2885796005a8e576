"""The graph layout: edge tables (src, dst, ...) and path operators as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_hop(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, n): counts of chains of exactly k edges, adding up counts per pair after each hop."""
    out = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    step = edges.groupBy(F.col("src").alias("dst"), F.col("dst").alias("next")).agg(F.count("*").alias("m"))
    for _ in range(k - 1):
        out = out.join(step, "dst").groupBy("src", F.col("next").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return out


def variable_paths(starts: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(src, dst, nodes, path): paths of low to high edges from each start; no edge (by its id) twice in a path."""
    e = edges.select("id", F.col("src").alias("dst"), F.col("dst").alias("next"))
    front = starts.select("src", F.col("src").alias("dst"), F.array("src").alias("nodes"), F.array().cast("array<bigint>").alias("path"))
    out = front if low == 0 else None
    for depth in range(1, high + 1):
        step = front.join(e, "dst").filter(~F.array_contains("path", F.col("id")))
        front = step.select("src", F.col("next").alias("dst"), F.array_append("nodes", F.col("next")).alias("nodes"), F.array_append("path", F.col("id")).alias("path"))
        if depth >= low:
            out = front if out is None else out.unionByName(front)
    return out


def reachable(starts: DataFrame, edges: DataFrame, high: int) -> DataFrame:
    """(src, dst, depth): breadth-first levels up to ``high``; a node keeps its least depth.

    Each level reads the one before once, so the plan grows with the depth only in proportion: rows of the last level
    are joined with their edges and all rows go into one partial aggregation."""
    e = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__next")).distinct()
    seen = starts.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")).distinct()
    for depth in range(1, high + 1):
        step = seen.join(e, (F.col("dst") == F.col("__from")) & (F.col("depth") == depth - 1), "left")
        own, new = F.struct("dst", "depth"), F.struct(F.col("__next").alias("dst"), F.lit(depth).alias("depth"))
        both = step.select("src", F.inline(F.when(F.col("__next").isNull(), F.array(own)).otherwise(F.array(own, new))))
        seen = both.groupBy("src", "dst").agg(F.min("depth").alias("depth"))
    return seen


def shortest_paths(starts: DataFrame, edges: DataFrame, high: int) -> DataFrame:
    """(src, dst, nodes): every path of least length. Paths go along with the levels, so each level is planned once."""
    e = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__next")).distinct()
    seen = starts.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"), F.array(F.array("src")).alias("paths")).distinct()
    for depth in range(1, high + 1):
        step = seen.join(e, (F.col("dst") == F.col("__from")) & (F.col("depth") == depth - 1), "left")
        own = F.struct("dst", "depth", "paths")
        new = F.struct(F.col("__next").alias("dst"), F.lit(depth).alias("depth"), F.transform("paths", lambda p: F.array_append(p, F.col("__next"))).alias("paths"))
        both = step.select("src", F.inline(F.when(F.col("__next").isNull(), F.array(own)).otherwise(F.array(own, new))))
        found = both.groupBy("src", "dst").agg(F.min("depth").alias("depth"), F.collect_set(F.struct("depth", "paths")).alias("all"))
        best = F.filter("all", lambda x: x["depth"] == F.col("depth"))
        seen = found.select("src", "dst", "depth", F.flatten(F.transform(best, lambda x: x["paths"])).alias("paths"))
    return seen.select("src", "dst", F.explode("paths").alias("nodes"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c of an undirected graph; edges point to the end of higher degree, so hubs expand little."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u <> v").distinct()
    degree = pairs.select("u").union(pairs.select("v")).groupBy("u").agg(F.count("*").alias("d"))
    named = pairs.join(degree, "u").withColumnRenamed("d", "du").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = named.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"))
    two = out.alias("p").join(out.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("u"), F.col("q.y").alias("v"))
    closed = two.join(pairs, ["u", "v"])
    s = F.array_sort(F.array("x", "u", "v"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))
