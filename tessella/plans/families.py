"""The catalogue's families as templates with parameters, in one text for Spark SQL and the oracle, and the marketplace workload with its own.

``REGISTRY`` generates any number of instances (``templates.Registry``); the first ``SHOWN`` of each template are registered as queries
``t_<template>_<k>``, which run against the oracle as every other query does. Every ordered limit has a total order.
An instance of a marketplace query names it and its parameters, which its relational, document and graph forms all take.
"""

from __future__ import annotations

import inspect
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from . import marketplace as M
from .catalogue import run_sql
from .templates import Instance, Params, Registry, literal

SHOWN = 2
#: A day after the last order; dates are drawn back from it.
REGISTRY = Registry(datetime(2002, 1, 1))
_t = REGISTRY.query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["click", "error", "purchase", "signup", "view"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _since(p: Params, least: int = 200, most: int = 2000) -> str:
    return literal(p.date_minus_days(least, most))


@_t("point", "Lookup by key")
def _(p):
    return f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = {literal(p.unique_integer('key', 1, 1500))}"


@_t("keys", "Lookup of several keys")
def _(p):
    return f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN ({literal(p.integers('keys', 150, 3, 12))})"


@_t("range", "Closed range with a second predicate")
def _(p):
    low = p.integer("low", 1000, 300_000)
    return f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN {literal(low)} AND {literal(low)} + 20000 AND o_orderstatus <> {literal(p.choice('status', ['F', 'O', 'P']))}"


@_t("not_in", "Excluded values")
def _(p):
    return f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ({literal(p.choice('a', SEGMENTS))}, {literal(p.choice('b', SEGMENTS))})"


@_t("like", "Prefix and suffix")
def _(p):
    return f"SELECT p_partkey, p_type, p_brand FROM part WHERE p_type LIKE concat({literal(p.choice('type', TYPES))}, '%') AND p_brand LIKE concat('%', {literal(str(p.integer('digit', 0, 9)) if not p.raw else p.integer('digit', 0, 9))})"


@_t("either", "Disjunction and negation")
def _(p):
    return f"SELECT o_orderkey FROM orders WHERE (o_totalprice > {literal(p.integer('dear', 300_000, 480_000))} OR o_custkey % {literal(p.integer('mod', 3, 20))} = 0) AND NOT o_orderstatus = {literal(p.choice('status', ['F', 'O', 'P']))}"


@_t("modulo", "Remainders")
def _(p):
    return f"SELECT event_id, user_id FROM events WHERE user_id % {literal(p.integer('mod', 5, 40))} = 3 AND event_type = {literal(p.choice('kind', KINDS))}"


@_t("computed", "Computed columns")
def _(p):
    return f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * {literal(p.real('rate', 1.01, 1.3, 2))}, 3) AS charge FROM lineitem WHERE l_quantity > {literal(p.integer('quantity', 40, 48))}"


@_t("switch", "Conditional values")
def _(p):
    low = p.integer("low", -500, 4000)
    return f"SELECT c_custkey, CASE WHEN c_acctbal < {literal(low)} THEN 'low' WHEN c_acctbal < {literal(low)} + 3000 THEN 'mid' ELSE 'high' END AS band FROM customer"


@_t("inner", "Equi-join with a filter on each side")
def _(p):
    return f"SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = {literal(p.choice('segment', SEGMENTS))} AND o_orderdate >= {_since(p)}"


@_t("left", "Outer join with a filter in its condition")
def _(p):
    return f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > {literal(p.integer('least', 100_000, 400_000))} GROUP BY c_custkey"


@_t("full", "Full outer join of two aggregates")
def _(p):
    return f"""SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS lines FROM (SELECT o_custkey % {literal(p.integer('mod', 20, 200))} AS k, count(*) AS n FROM orders WHERE o_orderdate >= {_since(p)} GROUP BY 1) a
        FULL OUTER JOIN (SELECT l_partkey % 97 AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k"""


@_t("semi", "EXISTS")
def _(p):
    return f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {literal(p.integer('least', 200_000, 450_000))})"


@_t("anti", "NOT EXISTS")
def _(p):
    return f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= {_since(p, 200, 1200)})"


@_t("self", "Self-join")
def _(p):
    return f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > {literal(p.integer('least', 0, 6000))}"


@_t("band", "Rows of one key within a time of each other")
def _(p):
    return f"SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '{literal(p.integer('hours', 1, 6))}' HOUR WHERE a.event_type = {literal(p.choice('kind', KINDS))}"


@_t("multiway", "Join of five relations")
def _(p):
    return f"""SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= {_since(p)} AND c_mktsegment = {literal(p.choice('segment', SEGMENTS))} GROUP BY r_name"""


@_t("lateral", "Latest rows of each key")
def _(p):
    return f"""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t
        WHERE r <= {literal(p.integer('k', 1, 5))} AND o_custkey IN ({literal(p.integers('keys', 150, 5, 30))})"""


@_t("aggregates", "Aggregates of a filtered table")
def _(p):
    return f"SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS m, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate <= {_since(p)} GROUP BY l_returnflag"


@_t("distinct", "Distinct counts")
def _(p):
    return f"SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_totalprice > {literal(p.integer('least', 50_000, 300_000))} GROUP BY o_orderpriority"


@_t("having", "Groups by their aggregates")
def _(p):
    return f"SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= {literal(p.integer('least', 8, 16))}"


@_t("conditional", "Conditional aggregates")
def _(p):
    return f"SELECT user_id, count(*) FILTER (WHERE event_type = {literal(p.choice('kind', KINDS))}) AS own, round(sum(CASE WHEN value > {literal(p.real('least', 10, 90, 1))} THEN value ELSE 0 END), 4) AS large FROM events GROUP BY user_id"


@_t("spread", "Deviation and percentiles")
def _(p):
    return f"SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd, round(percentile_cont({literal(p.choice('share', [0.1, 0.25, 0.5, 0.9]))}) WITHIN GROUP (ORDER BY c_acctbal), 6) AS q FROM customer GROUP BY c_mktsegment"


@_t("rollup", "Subtotals")
def _(p):
    return f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= {_since(p)} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"


@_t("cube", "All subtotals")
def _(p):
    return f"SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS g, count(*) AS n FROM lineitem WHERE l_quantity > {literal(p.integer('quantity', 10, 45))} GROUP BY CUBE (l_returnflag, l_linestatus)"


@_t("sets", "Grouping sets")
def _(p):
    return f"SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > {literal(p.integer('least', 0, 8000))} GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())"


@_t("rank", "Ranks in a group")
def _(p):
    return f"SELECT * FROM (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part) t WHERE r <= {literal(p.integer('k', 2, 9))}"


@_t("tiles", "Tiles")
def _(p):
    return f"SELECT s_suppkey, ntile({literal(p.integer('tiles', 3, 12))}) OVER (PARTITION BY s_nationkey % 3 ORDER BY s_acctbal, s_suppkey) AS tile FROM supplier"


@_t("neighbours", "Values of rows before and after")
def _(p):
    n = literal(p.integer("steps", 1, 4))
    return f"SELECT event_id, lag(value, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events WHERE event_type = {literal(p.choice('kind', KINDS))}"


@_t("moving", "Sums over rows around")
def _(p):
    return f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {literal(p.integer('rows', 1, 9))} PRECEDING AND CURRENT ROW), 4) AS s FROM events"


@_t("share", "A row's share of its group")
def _(p):
    return f"SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders WHERE o_orderdate >= {_since(p)}"


@_t("page", "A page in order")
def _(p):
    return f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {literal(p.limit())} OFFSET {literal(p.skip(10, 200))}"


@_t("nulls", "Null placement in order")
def _(p):
    return f"SELECT c_custkey, CASE WHEN c_acctbal > {literal(p.integer('least', 0, 6000))} THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey LIMIT {literal(p.limit())}"


@_t("union", "Union")
def _(p):
    return f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > {literal(p.integer('a', 0, 9000))} UNION SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > {literal(p.integer('b', 0, 9000))}"


@_t("except", "Multiset difference")
def _(p):
    return f"SELECT l_partkey % {literal(p.integer('mod', 50, 90))} AS k FROM lineitem EXCEPT ALL SELECT p_partkey % 40 AS k FROM part"


@_t("intersect", "Multiset intersection")
def _(p):
    return f"SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > {literal(p.integer('quantity', 20, 45))} INTERSECT ALL SELECT o_custkey AS k FROM orders"


@_t("chain", "Chained common tables")
def _(p):
    return f"""WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders WHERE o_orderdate >= {_since(p)} GROUP BY o_custkey), top AS (SELECT k, s FROM spent WHERE s > {literal(p.integer('least', 200_000, 900_000))})
        SELECT c_mktsegment, count(*) AS n, round(sum(s), 2) AS s FROM top JOIN customer ON c_custkey = k GROUP BY c_mktsegment"""


@_t("recursive", "Recursion to a depth")
def _(p):
    return f"WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS n, 1 AS d UNION ALL SELECT n * {literal(p.integer('factor', 2, 5))} + 1 AS n, d + 1 AS d FROM t WHERE d < {literal(p.integer('depth', 3, 9))}) SELECT d, n FROM t"


@_t("scalar", "Comparison with an aggregate of the whole table")
def _(p):
    return f"SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * {literal(p.real('factor', 1.0, 1.04, 3))} FROM part)"


@_t("dates", "Groups by parts of a date")
def _(p):
    return f"SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE month(o_orderdate) = {literal(p.month())} GROUP BY 1"


@_t("json", "A field of a JSON text")
def _(p):
    return f"SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.n') AS INT) = {literal(p.integer('n', 0, 9))}"


def _spark(text: str) -> str:
    return text.replace("json_extract_string(", "get_json_object(")


#: How each parameter of the marketplace workload is drawn.
DRAWN = {
    "person": lambda p: p.integer("person", 1, 149),
    "since": lambda p: p.date_minus_days(200, 2000) if p.raw else f"{p.date_minus_days(200, 2000):%Y-%m-%d}",
    "persons": lambda p: p.integers("persons", 149, 20, 60),
    "products": lambda p: p.integers("products", 200, 10, 40),
    "sellers": lambda p: p.integers("sellers", 96, 5, 30),
    "categories": lambda p: p.integers("categories", 19, 2, 8),
    "countries": lambda p: p.choice("countries", [("C1", "C2", "C3"), ("C4", "C9"), ("C5", "C8", "C13", "C21")]),
    "limit": lambda p: p.limit(),
}


def _workload(f):
    @_t(f"market_{f.__name__}", (f.__doc__ or f.__name__).splitlines()[0])
    def build(p: Params):
        """(query's name, parameters): the three layouts' forms of the query take them alike."""
        return f.__name__, {k: DRAWN[k](p) for k in inspect.signature(f).parameters if k in DRAWN}


for _f in M.WORKLOAD:
    _workload(_f)


def market() -> list[Instance]:
    """Two instances of each marketplace query."""
    own = Registry(REGISTRY.now, {k: t for k, t in REGISTRY.templates.items() if k.startswith("market_")})
    return own.generate(SHOWN * len(own.templates), 0)


def shown() -> list[Instance]:
    """The registered instances of the SQL templates."""
    own = Registry(REGISTRY.now, {k: t for k, t in REGISTRY.templates.items() if not k.startswith("market_")})
    return own.generate(SHOWN * len(own.templates), 0)


def _bind(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, _spark(text))

    return run


def queries() -> dict:
    return {f"t_{x.template.name}_{x.index}": _bind(x.content) for x in shown()}


def oracle_sql() -> dict[str, str]:
    return {f"t_{x.template.name}_{x.index}": x.content for x in shown()}
