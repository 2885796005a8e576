"""Relational part of the query catalogue: one entry per operator, as Spark SQL and as oracle SQL.

An entry whose two dialects agree has one text. Texts that need a rewrite in Spark (GROUPS frames, DISTINCT ON,
quantified comparisons, correlated sort keys, sampling) have two. Every ordered limit has a total order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text over the Parquet tables that it names; Catalyst pushes its filters and columns into the scans."""
    frames = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


#: name -> text, or (Spark text, oracle text)
SQL: dict[str, str | tuple[str, str]] = {
    "flagship": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""",
    "s1_scan": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "s2_point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    "s3_values": "SELECT v.seg, v.w, count(c_custkey) AS n FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('NONE', 3)) AS v(seg, w) LEFT JOIN customer ON c_mktsegment = v.seg GROUP BY v.seg, v.w",
    "s4_series": (
        "SELECT b.t AS bucket, count(event_id) AS n FROM (SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-02-05 00:00:00', INTERVAL '1' DAY)) AS t) b LEFT JOIN events e ON date_trunc('DAY', e.ts) = b.t GROUP BY b.t",
        "SELECT b.t AS bucket, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-05 00:00:00', INTERVAL 1 DAY)) AS t) b LEFT JOIN events e ON date_trunc('day', e.ts) = b.t GROUP BY b.t",
    ),
    "s6_locking_read": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey BETWEEN 10 AND 20",
    "p1_projection": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "p2_computed": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem WHERE l_quantity > 45",
    "p4_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "p5_distinct_on": (
        "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    ),
    "f1_comparison": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <> 15 AND p_retailprice < 950",
    "f2_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000",
    "f3_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')",
    "f4_not_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD')",
    "f5_like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PRO%' OR p_brand LIKE '%1' OR p_name LIKE '%7%'",
    "f6_regex": ("SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '(?i)brand#1[0-5]$'", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?i)brand#1[0-5]$')"),
    "f7_null_test": "SELECT c.c_custkey, o.o_orderkey IS NULL AS lonely FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL",
    "f8_boolean": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT (o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0)",
    "f9_quantified": (
        "SELECT p_partkey FROM part CROSS JOIN (SELECT max(p_retailprice) AS hi, count(*) AS n, count(p_retailprice) AS known FROM part WHERE p_brand = 'Brand#3') q WHERE n = 0 OR (n = known AND p_retailprice >= hi)",
        "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_brand = 'Brand#3')",
    ),
    "f10_cross_field": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 100 = l_suppkey % 100 AND l_quantity > l_linenumber * 6",
    "f12_modulo": "SELECT event_id, user_id FROM events WHERE user_id % 7 = 3",
    "j1_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "j2_comma": "SELECT n.n_name, count(*) AS n FROM customer c, orders o, nation n WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "j3_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "j4_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k",
    "j5_cross_stats": "SELECT s.s_suppkey, round(s.s_acctbal - t.m, 4) AS above FROM supplier s CROSS JOIN (SELECT avg(s_acctbal) AS m FROM supplier) t WHERE s.s_acctbal > t.m",
    "j6_lateral": (
        "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c CROSS JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
        "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    ),
    "j7_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "j8_range": "SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR",
    "j9_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "j10_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "j10_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)",
    "j11_multiway": """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
        JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name""",
    "a1_count": "SELECT count(*) AS n, count(o_orderkey) AS m FROM orders",
    "a2_aggregates": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus",
    "a3_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "a5_group_expression": "SELECT CASE WHEN p_retailprice < 930 THEN 'low' WHEN p_retailprice < 970 THEN 'mid' ELSE 'high' END AS band, p_size % 5 AS m, count(*) AS n FROM part GROUP BY 1, 2",
    "a6_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND sum(o_totalprice) > 1000000",
    "a7_conditional": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY o_orderpriority",
    "a8_stddev": "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS s, round(stddev_pop(p_retailprice), 6) AS p FROM part GROUP BY p_brand",
    "a9_percentiles": (
        "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY o_orderstatus",
    ),
    "a10_regression": "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS k, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_returnflag",
    "a11_collect": (
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "a12_first_last": (
        "SELECT user_id, min_by(event_type, struct(ts, event_id)) AS first_type, max_by(event_type, struct(ts, event_id)) AS last_type FROM events GROUP BY user_id",
        "SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, last(event_type ORDER BY ts, event_id) AS last_type FROM events GROUP BY user_id",
    ),
    "a13_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "a14_cube": "SELECT p_type, p_size % 3 AS m, count(*) AS n FROM part GROUP BY CUBE (p_type, p_size % 3)",
    "a15_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "a16_grouping": (
        "SELECT p_type, p_brand, CAST(grouping_id(p_type, p_brand) AS BIGINT) AS g, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)",
        "SELECT p_type, p_brand, CAST(grouping(p_type, p_brand) AS BIGINT) AS g, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)",
    ),
    "a18_sort_by_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "w1_row_number": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders",
    "w2_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "w3_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "w4_relative_rank": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS c FROM supplier",
    "w5_lag_lead": "SELECT event_id, lag(value, 1, 0.0) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "w6_positional": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w7_aggregate_over": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "w8_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS m FROM events",
    "w9_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "w10_groups_frame": (
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM (SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part)",
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part",
    ),
    "w12_conditional_window": "SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM events",
    "w13_top_k": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3",
    "o1_order": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey ASC NULLS LAST",
    "o2_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "o3_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "o4_nulls": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) ORDER BY c_mktsegment NULLS FIRST, c_nationkey NULLS LAST, n LIMIT 40",
    "o5_computed_order": (
        "SELECT n.n_name FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS m FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey ORDER BY coalesce(s.m, 0) DESC, n.n_name LIMIT 10",
        "SELECT n_name FROM nation ORDER BY (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) DESC, n_name LIMIT 10",
    ),
    "u1_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "u2_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "u3_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.05",
    "u3_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "u4_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 47",
    "u4_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "q1_cte": "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT CASE WHEN s < 500000 THEN 'small' WHEN s < 2000000 THEN 'mid' ELSE 'large' END AS band, s FROM t) SELECT band, count(*) AS n, round(avg(s), 2) AS m FROM b GROUP BY band",
    "q2_recursive": (
        # customers per doubling first: 64 rows at most meet the levels
        """WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS depth UNION ALL SELECT n * 2 AS n, depth + 1 AS depth FROM t WHERE depth < 10),
        b AS (SELECT CASE WHEN c_custkey <= 1 THEN 0 ELSE length(bin(c_custkey - 1)) END AS band, count(*) AS k FROM customer WHERE c_custkey IS NOT NULL GROUP BY 1)
        SELECT t.depth, t.n, coalesce(sum(k), 0) AS c FROM t LEFT JOIN b ON band <= t.depth GROUP BY t.depth, t.n""",
        "WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS depth UNION ALL SELECT n * 2 AS n, depth + 1 AS depth FROM t WHERE depth < 10) SELECT t.depth, t.n, count(c_custkey) AS c FROM t LEFT JOIN customer ON c_custkey <= t.n GROUP BY t.depth, t.n",
    ),
    "q3_materialized": (
        # the repartitioning is the fence: both sides read its one exchange
        "WITH big AS (SELECT /*+ REPARTITION(o_custkey) */ o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT a.o_custkey, count(*) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice GROUP BY a.o_custkey",
        "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT a.o_custkey, count(*) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice GROUP BY a.o_custkey",
    ),
    "q4_derived": "SELECT t.s, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY t.s",
    "q5_scalar": "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) AND p_size = (SELECT max(p_size) FROM part)",
    "e1_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS big FROM orders",
    "e2_coalesce": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer",
    "e3_greatest": "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS l FROM lineitem WHERE l_quantity = 50",
    "e4_math": ("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 50.0), 6) AS e, abs(25 - p_size) AS a, p_size div 7 AS d FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 50.0), 6) AS e, abs(25 - p_size) AS a, p_size // 7 AS d FROM part"),
    "e5_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(floor(o_totalprice) AS BIGINT) AS i, CAST(o_orderdate AS DATE) AS d FROM orders",
    "e6_string": ("SELECT c_custkey, lower(c_name) || '/' || c_mktsegment AS s, length(c_name) AS n, split(c_name, '#')[0] AS head FROM customer", "SELECT c_custkey, lower(c_name) || '/' || c_mktsegment AS s, length(c_name) AS n, string_split(c_name, '#')[1] AS head FROM customer"),
    "e7_date_trunc": ("SELECT CAST(date_trunc('WEEK', ts) AS TIMESTAMP_NTZ) AS w, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, count(*) AS n FROM events GROUP BY 1"),
    "e8_date_parts": ("SELECT year(ts) AS y, month(ts) AS m, dayofweek(ts) - 1 AS dow, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3, 4", "SELECT CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(dayofweek(ts) AS INT) AS dow, CAST(hour(ts) AS INT) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3, 4"),
    "e9_interval": "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01 00:00:00' - INTERVAL '3' MONTH AND o_orderdate <= TIMESTAMP '1999-01-01 00:00:00'",
    "e10_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "e11_json_predicate": ("SELECT event_id FROM events WHERE array_contains(json_object_keys(props), 'k') AND CAST(get_json_object(props, '$.k') AS INT) > 50", "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k') AND CAST(json_extract_string(props, '$.k') AS INT) > 50"),
    "e12_json_build": ("SELECT r_regionkey, to_json(named_struct('id', r_regionkey, 'name', r_name)) AS j FROM region", "SELECT r_regionkey, CAST(json_object('id', r_regionkey, 'name', r_name) AS VARCHAR) AS j FROM region"),
    "e13_explode": ("SELECT vec_id, pos, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, posexplode(embedding) AS (pos, x) FROM embeddings)", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "e14_array_parts": ("SELECT vec_id, size(embedding) AS n, embedding[0] AS head, size(slice(embedding, 3, 4)) AS part FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS head, CAST(len(embedding[3:6]) AS INT) AS part FROM embeddings"),
    "e15_array_functions": ("SELECT vec_id, size(filter(embedding, x -> x > 0)) AS pos, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS sq FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sq FROM embeddings"),
    "f11_array_predicates": ("SELECT vec_id FROM embeddings WHERE exists(embedding, x -> x > 0.35) AND NOT forall(embedding, x -> x > -0.3)", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0 AND len(list_filter(embedding, lambda x: x > -0.3)) < len(embedding)"),
    "e16_array_sets": ("SELECT o_custkey, array_join(array_sort(array_union(collect_set(o_orderstatus), collect_set(o_orderpriority))), '|') AS u FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(o_orderpriority)))), '|') AS u FROM orders GROUP BY o_custkey"),
    # names of the dialects beside the operators above
    "j1_merge_hint": "SELECT /*+ MERGE(c) */ c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "j1_shuffle_hash_hint": "SELECT /*+ SHUFFLE_HASH(c) */ c.c_nationkey, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey",
    "a4_group_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "w11_named_window": "SELECT o_orderkey, row_number() OVER w AS r, round(avg(o_totalprice) OVER w, 4) AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "q6_pipeline": "WITH matched AS (SELECT * FROM lineitem WHERE l_quantity >= 10), grouped AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS s FROM matched GROUP BY l_orderkey), kept AS (SELECT * FROM grouped WHERE n >= 3) SELECT n, count(*) AS orders, round(avg(s), 2) AS m FROM kept GROUP BY n",
    "a9_approximate": ("SELECT event_type, approx_percentile(value, 0.5, 1000000) AS med FROM events GROUP BY event_type", "SELECT event_type, quantile_disc(value, 0.5) AS med FROM events GROUP BY event_type"),
    "a11_array_agg": (
        "SELECT o_custkey, array_join(transform(array_sort(array_agg(o_orderkey)), x -> CAST(x AS STRING)), ',') AS keys FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey",
    ),
    "a11_json_agg": (
        "SELECT n_regionkey, to_json(array_sort(collect_list(named_struct('id', n_nationkey, 'name', n_name)))) AS j FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(to_json(list({'id': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey",
    ),
    "f12_type": (
        "SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k')) = 'BIGINT' AS whole FROM events",
        "SELECT event_id, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS whole FROM events",
    ),
    "e5_try_cast": (
        "SELECT event_id, try_cast(event_type AS DOUBLE) AS d, try_cast(get_json_object(props, '$.k') AS BIGINT) AS i FROM events",
        "SELECT event_id, try_cast(event_type AS DOUBLE) AS d, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS i FROM events",
    ),
    "e8_iso_week": (
        "SELECT CAST(extract(YEAROFWEEK FROM o_orderdate) AS INT) AS y, CAST(weekofyear(o_orderdate) AS INT) AS w, count(*) AS n FROM orders GROUP BY 1, 2",
        "SELECT CAST(isoyear(o_orderdate) AS INT) AS y, CAST(week(o_orderdate) AS INT) AS w, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "e9_age": (
        "SELECT o_orderkey, timestampdiff(DAY, o_orderdate, TIMESTAMP_NTZ '2001-09-01 00:00:00') AS days, timestampdiff(MONTH, o_orderdate, TIMESTAMP_NTZ '2001-09-01 00:00:00') AS months FROM orders",
        "SELECT o_orderkey, date_sub('day', o_orderdate, TIMESTAMP '2001-09-01 00:00:00') AS days, date_sub('month', o_orderdate, TIMESTAMP '2001-09-01 00:00:00') AS months FROM orders",
    ),
    "e12_object_to_array": (
        "SELECT event_id, x.key AS k, x.value AS v FROM (SELECT event_id, explode(map_entries(from_json(props, 'map<string,string>'))) AS x FROM events)",
        "SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    ),
    "p3_merge_objects": (
        "SELECT event_id, m['k'] AS k, m['type'] AS t FROM (SELECT event_id, map_concat(from_json(props, 'map<string,string>'), map('type', event_type)) AS m FROM events)",
        "SELECT event_id, json_extract_string(m, '$.k') AS k, json_extract_string(m, '$.type') AS t FROM (SELECT event_id, json_merge_patch(props, json_object('type', event_type)) AS m FROM events)",
    ),
    "e15_range_reduce": (
        "SELECT p_partkey, aggregate(sequence(1, p_size), CAST(0 AS BIGINT), (a, x) -> a + x * x) AS s FROM part WHERE p_size >= 1",
        "SELECT p_partkey, CAST(list_sum(list_transform(range(1, p_size + 1), lambda x: x * x)) AS BIGINT) AS s FROM part WHERE p_size >= 1",
    ),
    "e17_let": "SELECT p_partkey, 'fixed' AS tag, round(gross - net, 6) AS tax FROM (SELECT p_partkey, p_retailprice AS net, p_retailprice * 1.2 AS gross FROM part) t",
}


def queries() -> dict:
    def bind(text):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text)

    return {name: bind(t if isinstance(t, str) else t[0]) for name, t in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: t if isinstance(t, str) else t[1] for name, t in SQL.items()}
