"""Query plans as trees, their features for latency models, measured runs, and column statistics."""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class PlanNode:
    kind: str
    bytes: float
    children: list[PlanNode] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)

    def shape(self) -> str:
        return self.kind + ("(" + ",".join(c.shape() for c in self.children) + ")" if self.children else "")


def plan(df: DataFrame) -> PlanNode:
    """The optimized logical plan with the optimizer's own size estimates; nothing is executed."""

    def node(p) -> PlanNode:
        kids = p.children()
        return PlanNode(p.nodeName().split(" ")[0], float(str(p.stats().sizeInBytes())), [node(kids.apply(i)) for i in range(kids.size())])

    return node(df._jdf.queryExecution().optimizedPlan())


def structure_hash(root: PlanNode) -> int:
    """Equal for plans with the same operators in the same places."""
    return xxhash.xxh64(root.shape(), seed=42).intdigest()


FAMILIES = ("LogicalRelation", "Project", "Filter", "Join", "Aggregate", "Sort", "Window", "Generate", "Expand", "Union", "GlobalLimit", "LocalLimit", "Distinct", "other")
NAMES = [*(f"n_{x}" for x in FAMILIES), "nodes", "depth", "leaves", "log_root_bytes", "log_leaf_bytes", "log_max_bytes"]


def features(root: PlanNode) -> list[float]:
    """A flat vector (``NAMES``) of what is known before a run: operators by family, shape, estimated sizes."""
    nodes = list(root.walk())
    kinds = Counter({"Relation": "LogicalRelation"}.get(n.kind, n.kind) if n.kind in (*FAMILIES, "Relation") else "other" for n in nodes)
    leaves = [n.bytes for n in nodes if not n.children]
    log = lambda x: math.log1p(min(x, 1e300))
    return [*(float(kinds[x]) for x in FAMILIES), float(len(nodes)), float(root.depth()), float(len(leaves)), log(root.bytes), log(sum(leaves)), log(max(n.bytes for n in nodes))]


def measure(build: Callable[[], DataFrame], runs: int) -> list[float]:
    """Milliseconds of each full run; the query is planned anew each time, its rows are not kept."""
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - began) * 1000)
    return out


def rendered(root: PlanNode) -> str:
    """The tree as text, one operator a line."""

    def lines(node: PlanNode, before: str, last: bool, first: bool):
        yield before + ("" if first else "`- " if last else "|- ") + f"{node.kind} ({node.bytes:.3g} B)"
        for k, child in enumerate(node.children):
            yield from lines(child, before + ("" if first else "   " if last else "|  "), k == len(node.children) - 1, False)

    return "\n".join(lines(root, "", True, True))


NODE_NAMES = [*(f"is_{x}" for x in FAMILIES), "log_bytes", "log_child_bytes", "children", "depth", "height"]


def node_features(root: PlanNode) -> list[tuple[int, int, list[float]]]:
    """(number, parent's number or -1, vector by ``NODE_NAMES``) of each operator, parents first: a plan as a model over trees reads it."""
    out: list[tuple[int, int, list[float]]] = []
    log = lambda x: math.log1p(min(x, 1e300))

    def visit(node: PlanNode, parent: int, depth: int) -> None:
        kind = {"Relation": "LogicalRelation"}.get(node.kind, node.kind)
        kind = kind if kind in FAMILIES else "other"
        number = len(out)
        out.append((number, parent, [*(float(kind == x) for x in FAMILIES), log(node.bytes), log(sum(c.bytes for c in node.children)), float(len(node.children)), float(depth), float(node.depth())]))
        for c in node.children:
            visit(c, number, depth + 1)

    visit(root, -1, 0)
    return out


def scaled(rows: list[list[float]]) -> tuple[list[float], list[float]]:
    """Mean and deviation of each feature, for z-scores; a constant feature has deviation 1."""
    n = max(1, len(rows))
    mean = [sum(x) / n for x in zip(*rows, strict=True)]
    dev = [math.sqrt(sum((v - m) ** 2 for v in x) / n) or 1.0 for x, m in zip(zip(*rows, strict=True), mean, strict=True)]
    return mean, dev


def footprint(df: DataFrame) -> dict[str, float]:
    """The tables that a plan reads, by the folder or file each scan names, with the optimizer's size of what it reads."""
    out: dict[str, float] = {}

    def visit(p) -> None:
        kids = p.children()
        if p.nodeName().startswith(("LogicalRelation", "Relation")):
            paths = p.relation().location().rootPaths()
            name = paths.apply(0).getName().removesuffix(".parquet")
            out[name] = out.get(name, 0.0) + float(str(p.stats().sizeInBytes()))
        for i in range(kids.size()):
            visit(kids.apply(i))

    visit(df._jdf.queryExecution().optimizedPlan())
    return out


def measure_write(spark, table_path: str, change: Callable[[DataFrame], DataFrame], runs: int) -> list[float]:
    """Milliseconds of writing a table's next state, each from the same state: a write goes to a folder beside it, which is deleted again.

    The table itself is never touched, so a run that fails has nothing to undo but that folder.
    """
    out = []
    for k in range(runs):
        beside = f"{table_path.rstrip('/')}.run-{k}"
        where = spark._jvm.org.apache.hadoop.fs.Path(beside)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        began = time.perf_counter()
        try:
            change(spark.read.parquet(table_path)).write.mode("errorifexists").parquet(beside)
            out.append((time.perf_counter() - began) * 1000)
        finally:
            files.delete(where, True)
    return out


TOP, BINS = 16, 12


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column, in one pass: rows, present, distinct (estimated), least and greatest as text, mean array length."""
    cols = []
    for f in df.schema:
        c, nested = F.col(f"`{f.name}`"), isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = c.cast("string") if not nested else F.to_json(c)
        cols.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("n"), F.count(c).alias("present"), F.approx_count_distinct(text).alias("distinct"),
                (F.lit(None) if nested else F.min(c).cast("string")).cast("string").alias("least"), (F.lit(None) if nested else F.max(c).cast("string")).cast("string").alias("greatest"),
                (F.avg(F.size(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(None)).cast("double").alias("mean_length"),
            )
        )
    return df.agg(F.array(*cols).alias("s")).select(F.inline("s"))


def top_values(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k most frequent values, ties to the smaller value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Counts over equal widths between the least and the greatest value; the last bin is closed."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@dataclass
class Selectivity:
    """Estimated shares of a numeric column's rows, from its TOP values and BINS counts; all that is kept has a fixed size."""

    n: int
    present: int
    distinct: int
    least: float
    greatest: float
    top: dict
    bins: list[int]

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Selectivity:
        x = F.col(column)
        n, present, distinct, least, greatest = df.agg(F.count("*"), F.count(x), F.approx_count_distinct(x), F.min(x.cast("double")), F.max(x.cast("double"))).first()
        bins = {r["bin"]: r["n"] for r in histogram(df, column).collect()}
        return cls(n, present, distinct, least, greatest, {r["value"]: r["n"] for r in top_values(df, column).collect()}, [bins.get(k, 0) for k in range(BINS)])

    def null(self) -> float:
        return 1 - self.present / self.n if self.n else 0.0

    def equals(self, value) -> float:
        """Exact for a frequent value; others share what is left evenly."""
        if not self.present or not self.least <= float(value) <= self.greatest:
            return 0.0
        if value in self.top:
            return self.top[value] / self.n
        rest, kinds = self.present - sum(self.top.values()), self.distinct - len(self.top)
        return max(rest, 0) / max(kinds, 1) / self.n

    def among(self, values) -> float:
        return min(1.0, sum(self.equals(v) for v in set(values)))

    def between(self, low: float, high: float) -> float:
        """Whole bins and even shares of the bins at both ends."""
        if not self.present or high < low or high < self.least or low > self.greatest:
            return 0.0
        if self.greatest == self.least:
            return self.present / self.n
        width = (self.greatest - self.least) / BINS
        parts = (max(0.0, min(high, self.least + (k + 1) * width) - max(low, self.least + k * width)) / width for k in range(BINS))
        return max(sum(c * p for c, p in zip(self.bins, parts, strict=True)) / self.n, self.equals(low) if low == high else 0.0)

    @staticmethod
    def both(*shares: float) -> float:
        """Conditions taken as independent."""
        return math.prod(shares)

    @staticmethod
    def either(*shares: float) -> float:
        return 1 - math.prod(1 - x for x in shares)


def range_selectivity(df: DataFrame, column: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """``Selectivity.between`` as one row (rows, share), from a histogram that stays distributed."""
    rows = df.agg(F.count("*").alias("n_all"), F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    start = F.col("lo") + F.col("bin") * width
    part = F.when(width == 0, ((F.col("lo") >= low) & (F.col("lo") <= high)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(high)), start + width) - F.greatest(F.lit(float(low)), start)) / width)
    return histogram(df, column, bins).crossJoin(F.broadcast(rows)).agg(F.max("n_all").alias("n"), F.round(F.sum(F.col("n") * part) / F.max("n_all"), 6).alias("share"))


def _t(spark, d, name):
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def x1_statistics(spark, d):
    return column_statistics(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).select("column", "n", "present", "least", "greatest")


def x2_top_values(spark, d):
    return top_values(_t(spark, d, "lineitem"), "l_partkey")


def x3_histogram(spark, d):
    return histogram(_t(spark, d, "lineitem"), "l_quantity")


def x4_selectivity(spark, d):
    return range_selectivity(_t(spark, d, "orders"), "o_totalprice", 120_000, 310_000)


QUERIES = {f.__name__: f for f in (x1_statistics, x2_top_values, x3_histogram, x4_selectivity)}
ORACLE = {
    "x1_statistics": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS present, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
    "x2_top_values": "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16",
    "x4_selectivity": """WITH e AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders),
        b AS (SELECT least(11, floor((o_totalprice - lo) / w)) AS k, count(*) AS c FROM orders, e GROUP BY 1)
        SELECT max(n) AS n, round(sum(c * greatest(0, least(310000, lo + (k + 1) * w) - greatest(120000, lo + k * w)) / w) / max(n), 6) AS share FROM b, e""",
    "x3_histogram": "SELECT CAST(least(11, floor((l_quantity - lo) / (hi - lo) * 12)) AS INT) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1",
}
