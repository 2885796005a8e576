"""Measured and predicted latencies: labels, splits, error metrics and coverage, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WARM_UP = 5


def label(runs: DataFrame, times: str = "times", warm_up: int = WARM_UP) -> DataFrame:
    """Adds ``latency``: the mean of the times after the first ``warm_up``; null if none is left."""
    kept = F.slice(times, F.lit(warm_up + 1), F.greatest(F.size(times) - warm_up, F.lit(0)))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return runs.withColumn("latency", F.when(F.size(times) > warm_up, mean))


def split(rows: DataFrame, template: str, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``is_train``: of each template's rows that share, by a seeded hash of the unique key; with two rows or more
    both sides have one. Ranks are counts of lower hash ranges plus a rank within a range, so that no template's rows meet in one task."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))
    dealt = rows.withColumns({"__h": h, "__b": F.substring(h, 1, 3)})
    sizes = dealt.groupBy(template, "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy(template)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(template).alias("__t"), F.col("__b").alias("__c"), before.alias("__before"), F.sum("__n").over(w).alias("__all"))
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy(template, "__b").orderBy("__h", key)))
    train = F.greatest(F.lit(1), F.least(F.col("__all") - 1, F.floor(F.col("__all") * share)))
    joined = ranked.join(sizes, ranked[template].eqNullSafe(sizes["__t"]) & (ranked["__b"] == sizes["__c"]))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__r") <= train).alias("is_train"))


def metrics(rows: DataFrame, predicted: str, actual: str, by: list[str] | None = None, eps: float = 1e-9) -> DataFrame:
    """MAE, median absolute error, mean relative error, median and mean q-error, shares of q-errors up to 1.5, 2 and 5."""
    p, a = F.greatest(F.col(predicted), F.lit(eps)), F.greatest(F.col(actual), F.lit(eps))
    q, off = F.greatest(p / a, a / p), F.abs(F.col(predicted) - F.col(actual))
    share = lambda x: F.round(F.avg((F.col("__q") <= x).cast("double")), 6)
    errors = rows.withColumns({"__q": q, "__off": off, "__rel": off / a})
    return errors.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.avg("__off"), 4).alias("mae"), F.round(F.percentile("__off", F.lit(0.5)), 4).alias("median_ae"), F.round(F.avg("__rel"), 4).alias("mean_relative"),
        F.round(F.percentile("__q", F.lit(0.5)), 4).alias("median_q"), F.round(F.avg("__q"), 4).alias("mean_q"), share(1.5).alias("within_1_5"), share(2.0).alias("within_2"), share(5.0).alias("within_5"),
    )


def uncovered(templates: DataFrame, measured: DataFrame, key: str = "template") -> DataFrame:
    """Templates without a measurement."""
    return templates.join(measured.select(key), key, "left_anti")


def _t(spark, d, name):
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def v1_label(spark, d):
    runs = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("times"))
    return label(runs).select("user_id", "event_type", F.round("latency", 6).alias("latency"))


def v2_split(spark, d):
    return split(_t(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


def v3_metrics(spark, d):
    parts = _t(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("guess"))
    return metrics(rows.join(parts, F.col("l_partkey") == F.col("p_partkey")), "guess", "p_retailprice", ["l_returnflag"])


def v4_uncovered(spark, d):
    ids = _t(spark, d, "customer").select(F.col("c_custkey").alias("template"))
    return uncovered(ids, _t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("template")))


QUERIES = {f.__name__: f for f in (v1_label, v2_split, v3_metrics, v4_uncovered)}
ORACLE = {
    "v1_label": "SELECT user_id, event_type, round(avg(value) FILTER (k > 5), 6) AS latency FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) GROUP BY 1, 2",
    "v2_split": """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '/0'), event_id)
        <= greatest(1, least(count(*) OVER (PARTITION BY event_type) - 1, floor(count(*) OVER (PARTITION BY event_type) * 0.8))) AS is_train FROM events""",
    "v3_metrics": """WITH e AS (SELECT l_returnflag, l_extendedprice / l_quantity AS g, p_retailprice AS a FROM lineitem JOIN part ON l_partkey = p_partkey),
        x AS (SELECT l_returnflag, abs(g - a) AS off, abs(g - a) / a AS rel, greatest(g / a, a / g) AS q FROM e)
        SELECT l_returnflag, count(*) AS n, round(avg(off), 4) AS mae, round(quantile_cont(off, 0.5), 4) AS median_ae, round(avg(rel), 4) AS mean_relative, round(quantile_cont(q, 0.5), 4) AS median_q, round(avg(q), 4) AS mean_q,
        round(avg(CASE WHEN q <= 1.5 THEN 1.0 ELSE 0.0 END), 6) AS within_1_5, round(avg(CASE WHEN q <= 2 THEN 1.0 ELSE 0.0 END), 6) AS within_2, round(avg(CASE WHEN q <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within_5 FROM x GROUP BY 1""",
    "v4_uncovered": "SELECT c_custkey AS template FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
}
