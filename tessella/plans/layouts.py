"""Document, graph and write queries of the catalogue, as DataFrames with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import documents as D
from tessella.operators import graph as G
from tessella.operators import relational as R
from tessella.operators import writes as U


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _orders_doc(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return D.embed_many(_t(spark, d, "orders"), lines, "o_orderkey", "l_orderkey", "lines", ["l_linenumber", "l_partkey"])


def _edges(spark, d):
    """Every order as an edge from its customer to one of 150 hub customers: a graph with cycles, loops and repeated edges."""
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % 150).alias("dst"))


#: The nodes that traversals start from.
STARTS = (1, 2, 4, 5, 7, 8)
_S = str(STARTS)
_E = "(SELECT o_orderkey AS id, o_custkey AS src, (o_orderkey * 7) % 150 AS dst FROM orders)"


def p3_nested_path(spark, d):
    c = D.embed_one(_t(spark, d, "customer"), _t(spark, d, "nation"), "c_nationkey", "n_nationkey", "nation")
    return c.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.n_regionkey").alias("r"))


def p3_replace_root(spark, d):
    return D.replace_root(D.embed_one(_t(spark, d, "supplier"), _t(spark, d, "nation"), "s_nationkey", "n_nationkey", "nation"), "nation")


def j3_lookup(spark, d):
    return _orders_doc(spark, d).select("o_orderkey", F.size("lines").alias("n"), F.round(F.coalesce(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_extendedprice"]), F.lit(0.0)), 2).alias("s"))


def f11_elem_match(spark, d):
    return _orders_doc(spark, d).filter(F.exists("lines", lambda x: (x["l_quantity"] > 45) & (x["l_linenumber"] == 1))).select("o_orderkey")


def e13_unwind(spark, d):
    return D.unwind(_orders_doc(spark, d), "lines", True).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("lines").alias("m"))


def d5_document_update(spark, d):
    docs = _orders_doc(spark, d)
    return docs.withColumn("lines", D.pull("lines", lambda x: x["l_quantity"] < 25)).select("o_orderkey", F.size("lines").alias("n"))


def a17_bucket(spark, d):
    return R.bucket(_t(spark, d, "part"), "p_retailprice", [900.0, 930.0, 960.0], "rest")


def a17_bucket_auto(spark, d):
    return R.bucket_auto(_t(spark, d, "part"), "p_size", 5)


def a19_facet(spark, d):
    c = _t(spark, d, "customer")
    row = R.facet({"by_segment": c.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "by_sign": c.groupBy((F.col("c_acctbal") > 0).alias("pos")).agg(F.count("*").alias("n"))})
    return row.select(F.size("by_segment").alias("segments"), F.aggregate("by_segment", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.aggregate("by_sign", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("m"))


def s4_densify(spark, d):
    return R.densify(_t(spark, d, "events").filter("hour(ts) = 3 AND event_type = 'error'"), "ts", "DAY", [F.count("*").alias("n")])


def s5_sample(spark, d):
    return R.sample_rows(_t(spark, d, "customer"), 50, "c_custkey").select("c_custkey")


def s5_sample_share(spark, d):
    return R.sample_share(_t(spark, d, "orders"), 0.1, "o_orderkey").select("o_orderkey")


def a17_bucket_auto_price(spark, d):
    return R.bucket_auto(_t(spark, d, "orders"), "o_totalprice", 7)


def j8_band_join(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", "user_id")
    b = e.select(F.col("event_id").alias("second_id"), F.col("ts").alias("ts2"), F.col("user_id").alias("user_id"))
    return R.band_join(e.withColumnRenamed("event_id", "first_id"), b, "user_id", "ts", "ts2", 3600).select("first_id", "second_id")


def j8_as_of(spark, d):
    e = _t(spark, d, "events")
    return R.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


def g1_one_hop(spark, d):
    return _edges(spark, d).groupBy("src").agg(F.count("*").alias("n"))


def g2_two_hop(spark, d):
    return G.k_hop(_edges(spark, d), 2)


def g3_variable_paths(spark, d):
    e = _edges(spark, d)
    return G.variable_paths(e.filter(F.col("src").isin(*STARTS)).select("src").distinct(), e, 1, 3).groupBy("src", "dst").agg(F.count("*").alias("n"))


def g3_graph_lookup(spark, d):
    e = _edges(spark, d)
    return G.reachable(e.filter(F.col("src").isin(*STARTS)).select("src").distinct(), e, 3)


def g4_shortest_path(spark, d):
    e = _edges(spark, d)
    return G.shortest_paths(e.filter(F.col("src").isin(*STARTS)).select("src").distinct(), e, 3).groupBy("src", "dst").agg(F.count("*").alias("n"), (F.min(F.size("nodes")) - 1).alias("hops"))


def g6_pattern_comprehension(spark, d):
    nodes = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    own = _edges(spark, d).join(nodes, "src", "left_semi")
    lists = own.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ",").alias("friends"))
    return nodes.join(lists, "src", "left")


def g7_triangles(spark, d):
    return G.triangles(_edges(spark, d))


def f11_quantifiers(spark, d):
    """ANY, NONE, SINGLE and ALL over an order's lines."""
    n = lambda test: F.size(F.filter("lines", test))
    return _orders_doc(spark, d).select(
        "o_orderkey", F.exists("lines", lambda x: x["l_quantity"] > 45).alias("some"), (~F.exists("lines", lambda x: x["l_quantity"] < 5)).alias("none"),
        (n(lambda x: x["l_quantity"] == 50) == 1).alias("single"), F.forall("lines", lambda x: x["l_quantity"] >= 10).alias("every"),
    )


def f11_all(spark, d):
    kinds = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("kinds"))
    return kinds.filter(D.all_of("kinds", ["F", "O"])).select("o_custkey")


def e11_json_path(spark, d):
    """jsonb_path_exists with a filter."""
    return _t(spark, d, "events").filter(D.json_path_exists("props", "$ ? (@.k > 5 && @.k <= 8 || @.k == 1)")).select("event_id")


def f4_document_not_in(spark, d):
    """Missing values pass $ne and $nin."""
    c = _t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return c.filter(D.ne("segment", "MACHINERY") & D.not_in("segment", ["HOUSEHOLD", "FURNITURE"]))


def e16_sort_array(spark, d):
    best = F.sort_array(F.transform("lines", lambda x: F.struct(x["l_extendedprice"].alias("p"), x["l_partkey"].alias("k"))), asc=False)
    return _orders_doc(spark, d).select("o_orderkey", F.get(best, F.lit(0))["k"].alias("dearest"))


def d5_set_fields(spark, d):
    """$set and $unset of nested fields, $inc, $push and $addToSet."""
    c = D.embed_one(_t(spark, d, "customer"), _t(spark, d, "nation"), "c_nationkey", "n_nationkey", "nation").withColumn("tags", F.array("c_mktsegment"))
    c = c.withColumn("nation", F.col("nation").withField("n_name", F.lower("nation.n_name")).dropFields("n_regionkey")).withColumn("c_acctbal", F.col("c_acctbal") + 10)
    c = c.withColumn("tags", D.push("tags", F.lit("new"))).withColumn("tags", D.add_to_set("tags", F.lit("BUILDING")))
    return c.select("c_custkey", "c_acctbal", "nation.*", F.array_join("tags", ",").alias("tags"))


def u1_union_with(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def g5_path_functions(spark, d):
    """length(), nodes() and relationships() of two-edge paths."""
    e = _edges(spark, d)
    paths = G.variable_paths(e.filter(F.col("src").isin(*STARTS)).select("src").distinct(), e, 2, 2)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return paths.select("src", "dst", F.size("path").alias("hops"), listed("nodes").alias("nodes"), listed("path").alias("edges"))


def _c(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


def d1_insert(spark, d):
    return U.insert(_c(spark, d), _c(spark, d).filter("c_custkey = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), "c_acctbal"))


def d2_insert_select(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return U.insert_select(_c(spark, d), s, "c_custkey", ["c_name"])


def d3_upsert(spark, d):
    new = _t(spark, d, "supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return U.upsert(_c(spark, d), new, "c_custkey", {"c_acctbal": F.col("new.c_acctbal")}, F.col("new.c_acctbal") > F.col("old.c_acctbal"))


def d3_upsert_nothing(spark, d):
    new = _t(spark, d, "supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return U.upsert(_c(spark, d), new, "c_custkey", None)


def d4_update(spark, d):
    return U.update(_c(spark, d), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_name": F.concat("c_name", F.lit("*"))})


def d4_update_from(spark, d):
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return U.update_from(_c(spark, d), n, "c_custkey", {"c_acctbal": F.col("top")})


def d6_delete(spark, d):
    return U.delete(_c(spark, d), F.col("c_acctbal") < 0)


def d6_delete_using(spark, d):
    return U.delete_using(_c(spark, d), _t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def d6_detach_delete(spark, d):
    e = _edges(spark, d)
    _, left = U.detach_delete(e.select("src").distinct(), e, "src", e.filter(F.col("src").isin(*STARTS)).select("src").distinct())
    return left


def d6_delete_limit(spark, d):
    """DELETE of the rows that a subquery with ORDER BY and LIMIT names."""
    gone = _c(spark, d).orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey")
    return U.delete_using(_c(spark, d), gone, "c_custkey")


def d6_delete_cte(spark, d):
    """WITH idle AS (customers without orders in a status) DELETE ... USING idle."""
    idle = _c(spark, d).select("c_custkey").join(_t(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return U.delete_using(_c(spark, d), idle, "c_custkey")


def d7_returning(spark, d):
    return U.returning(_c(spark, d), F.col("c_acctbal") < 0, [F.col("c_custkey"), F.lit(0.0).alias("c_acctbal")])


_L = "(SELECT o_orderkey, o_orderstatus, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"
_NEW = "(SELECT s_suppkey * 30 AS k, s_name AS n, s_acctbal AS b FROM supplier)"
ORACLE = {
    "p3_nested_path": "SELECT c_custkey, n_name, n_regionkey AS r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "p3_replace_root": "SELECT n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "j3_lookup": f"SELECT o_orderkey, CAST(count(l_orderkey) AS INT) AS n, round(coalesce(sum(l_extendedprice), 0), 2) AS s FROM {_L} GROUP BY o_orderkey",
    "f11_elem_match": "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 AND l_linenumber = 1",
    "e13_unwind": f"SELECT o_orderstatus, count(*) AS n, count(l_orderkey) AS m FROM {_L} GROUP BY o_orderstatus",
    "d5_document_update": f"SELECT o_orderkey, CAST(count(l_orderkey) FILTER (WHERE l_quantity >= 25) AS INT) AS n FROM {_L} GROUP BY o_orderkey",
    "a17_bucket": "SELECT CASE WHEN p_retailprice >= 900 AND p_retailprice < 930 THEN '900.0' WHEN p_retailprice >= 930 AND p_retailprice < 960 THEN '930.0' ELSE 'rest' END AS bucket, count(*) AS n FROM part GROUP BY 1",
    "a17_bucket_auto": "SELECT CAST(floor(b * 5 / t) AS INT) AS bucket, min(p_size) AS lo, max(p_size) AS hi, CAST(sum(c) AS BIGINT) AS n FROM (SELECT p_size, c, sum(c) OVER (ORDER BY p_size) - c AS b, sum(c) OVER () AS t FROM (SELECT p_size, count(*) AS c FROM part GROUP BY p_size)) GROUP BY 1",
    "a19_facet": "SELECT CAST((SELECT count(DISTINCT c_mktsegment) FROM customer) AS INT) AS segments, count(*) AS n, count(*) AS m FROM customer",
    "s4_densify": "WITH g AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE hour(ts) = 3 AND event_type = 'error' GROUP BY 1) SELECT CAST(b.t AS TIMESTAMP) AS ts, g.n FROM (SELECT unnest(generate_series((SELECT min(ts) FROM g), (SELECT max(ts) FROM g), INTERVAL 1 DAY)) AS t) b LEFT JOIN g ON g.ts = b.t",
    "s5_sample": "SELECT c_custkey FROM customer ORDER BY c_custkey % 2147483648 * 1103515245 % 2147483648, c_custkey LIMIT 50",
    "s5_sample_share": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2147483648 * 1103515245 % 2147483648 < 214748364",
    "a17_bucket_auto_price": "SELECT CAST(floor(b * 7 / t) AS INT) AS bucket, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(c) AS BIGINT) AS n FROM (SELECT o_totalprice, c, sum(c) OVER (ORDER BY o_totalprice) - c AS b, sum(c) OVER () AS t FROM (SELECT o_totalprice, count(*) AS c FROM orders GROUP BY o_totalprice)) GROUP BY 1",
    "j8_band_join": "SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
    "j8_as_of": "SELECT c.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts",
    "g1_one_hop": f"SELECT src, count(*) AS n FROM {_E} GROUP BY src",
    "g2_two_hop": f"SELECT a.src, b.dst, count(*) AS n FROM {_E} a JOIN {_E} b ON a.dst = b.src GROUP BY 1, 2",
    "g3_variable_paths": f"""WITH RECURSIVE p AS (SELECT src, dst, [id] AS path FROM {_E} WHERE src IN {_S} UNION ALL
        SELECT p.src, e.dst, list_append(p.path, e.id) FROM p JOIN {_E} e ON p.dst = e.src WHERE len(p.path) < 3 AND NOT list_contains(p.path, e.id))
        SELECT src, dst, count(*) AS n FROM p GROUP BY 1, 2""",
    "g3_graph_lookup": f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_E}), p AS (SELECT DISTINCT src, src AS dst, 0 AS depth FROM e WHERE src IN {_S} UNION
        SELECT p.src, e.dst, p.depth + 1 FROM p JOIN e ON p.dst = e.src WHERE p.depth < 3) SELECT src, dst, min(depth) AS depth FROM p GROUP BY 1, 2""",
    "g4_shortest_path": f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_E}), p AS (SELECT DISTINCT src, src AS dst, [src] AS nodes FROM e WHERE src IN {_S} UNION
        SELECT p.src, e.dst, list_append(p.nodes, e.dst) FROM p JOIN e ON p.dst = e.src WHERE len(p.nodes) <= 3),
        m AS (SELECT src, dst, min(len(nodes)) AS l FROM p GROUP BY 1, 2) SELECT p.src, p.dst, count(*) AS n, CAST(min(m.l) - 1 AS INT) AS hops FROM p JOIN m ON p.src = m.src AND p.dst = m.dst AND len(p.nodes) = m.l GROUP BY 1, 2""",
    "g6_pattern_comprehension": f"SELECT CAST(n_nationkey AS BIGINT) AS src, string_agg(DISTINCT CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS friends FROM nation LEFT JOIN {_E} e ON e.src = n_nationkey GROUP BY 1",
    "g7_triangles": f"WITH e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {_E} WHERE src <> dst) SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v",
    "f11_quantifiers": f"SELECT o_orderkey, count(*) FILTER (WHERE l_quantity > 45) > 0 AS some, count(*) FILTER (WHERE l_quantity < 5) = 0 AS none, count(*) FILTER (WHERE l_quantity = 50) = 1 AS single, count(*) FILTER (WHERE l_quantity < 10) = 0 AS every FROM {_L} GROUP BY o_orderkey",
    "e11_json_path": "SELECT event_id FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k > 5 AND k <= 8 OR k = 1",
    "f11_all": "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2",
    "f4_document_not_in": "SELECT c_custkey, segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) WHERE segment IS NULL OR segment NOT IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')",
    "e16_sort_array": f"SELECT o_orderkey, first(l_partkey ORDER BY l_extendedprice DESC, l_partkey DESC) AS dearest FROM {_L} GROUP BY o_orderkey",
    "d5_set_fields": "SELECT c_custkey, c_acctbal + 10 AS c_acctbal, n_nationkey, lower(n_name) AS n_name, c_mktsegment || ',new' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ',BUILDING' END AS tags FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "u1_union_with": "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "g5_path_functions": f"SELECT a.src, b.dst, 2 AS hops, a.src || '-' || a.dst || '-' || b.dst AS nodes, a.id || '-' || b.id AS edges FROM {_E} a JOIN {_E} b ON a.dst = b.src AND a.id <> b.id WHERE a.src IN {_S}",
    "d1_insert": "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 'new', c_acctbal FROM customer WHERE c_custkey = 1",
    "d2_insert_select": "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name, s_acctbal FROM supplier",
    "d3_upsert": f"SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, n) AS c_name, CASE WHEN c_custkey IS NULL OR b > c_acctbal THEN b ELSE c_acctbal END AS c_acctbal FROM customer FULL OUTER JOIN {_NEW} ON c_custkey = k",
    "d3_upsert_nothing": f"SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, n) AS c_name, coalesce(c_acctbal, b) AS c_acctbal FROM customer FULL OUTER JOIN {_NEW} ON c_custkey = k",
    "d4_update": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name || '*' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "d4_update_from": "SELECT c_custkey, c_name, coalesce(t.m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) t ON o_custkey = c_custkey",
    "d6_delete": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT c_acctbal < 0",
    "d6_delete_using": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "d6_detach_delete": f"SELECT id, src, dst FROM {_E} WHERE src NOT IN (SELECT src FROM {_E} WHERE src IN {_S}) AND dst NOT IN (SELECT src FROM {_E} WHERE src IN {_S})",
    "d6_delete_limit": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25)",
    "d6_delete_cte": "WITH idle AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM idle)",
    "d7_returning": "SELECT c_custkey, CAST(0.0 AS DOUBLE) AS c_acctbal FROM customer WHERE c_acctbal < 0",
}
QUERIES = {name: globals()[name] for name in ORACLE}
