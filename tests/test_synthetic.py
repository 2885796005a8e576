"""Synthetic tables: keys, references, distributions, and the same rows in every partitioning."""

from pyspark.sql import functions as F

from tessella.sources import synthetic as S


def _refers(child, key, parent, parent_key):
    known = parent.select(F.col(parent_key).alias("known"))
    return child.select(key).dropna().join(known, F.col(key) == F.col("known"), "left_anti").count() == 0


def test_network(spark):
    t = S.network(spark, -3)
    n = S.counts(S.NETWORK, -3)
    for name, key in (("grp", "grp_id"), ("node", "node_id"), ("log", "log_id"), ("measure", "measure_id"), ("doc", "doc_id")):
        assert t[name].count() == t[name].select(key).distinct().count() == n[name]
    assert _refers(t["grp"], "parent_id", t["grp"], "grp_id") and _refers(t["node"], "grp_id", t["grp"], "grp_id")
    assert all(_refers(t[k], "node_id", t["node"], "node_id") for k in ("log", "measure", "doc"))
    assert _refers(t["link"], "src_id", t["node"], "node_id") and _refers(t["link"], "dst_id", t["node"], "node_id")
    assert 0.9 * n["link"] <= t["link"].count() <= n["link"] and t["link"].filter("src_id = dst_id").count() == 0
    assert t["doc"].select("node_id").distinct().count() == n["doc"]
    assert 0.66 < t["node"].filter("is_active").count() / n["node"] < 0.74
    assert 0.77 < t["log"].filter("val IS NOT NULL").count() / n["log"] < 0.83
    hot = t["measure"].filter(F.col("node_id") <= n["node"] // 10).count() / n["measure"]
    assert 0.33 < hot < 0.39  # five tenths of fourteen
    assert t["measure"].filter("dim = 4").agg(F.min("val")).first()[0] >= 20
    tags = t["node"].groupBy("tag").count().orderBy(F.desc("count")).first()
    assert tags["tag"] == "T0000" and tags["count"] > 0.15 * n["node"]


def test_shop(spark):
    t = S.shop(spark, -3)
    n = S.counts(S.SHOP, -3)
    assert {k: t[k].count() for k in ("person", "seller", "product", "category", "order")} == {k: n[k] for k in ("person", "seller", "product", "category", "order")}
    for child, key, parent, parent_key in (("product", "seller_id", "seller", "seller_id"), ("has_category", "category_id", "category", "category_id"), ("has_interest", "person_id", "person", "person_id"),
                                           ("follows", "to_id", "person", "person_id"), ("customer", "person_id", "person", "person_id"), ("order_item", "product_id", "product", "product_id"), ("review", "product_id", "product", "product_id")):
        assert _refers(t[child], key, t[parent], parent_key)
    for child, keys in (("has_category", ["product_id", "category_id"]), ("has_interest", ["person_id", "category_id"]), ("follows", ["from_id", "to_id"]), ("review", ["customer_id", "product_id"]), ("order_item", ["order_item_id"]), ("person", ["email"])):
        assert t[child].count() == t[child].select(*keys).distinct().count()
    assert t["follows"].filter("from_id = to_id").count() == 0
    assert 1.4 < t["order_item"].count() / n["order"] < 1.7
    # computed where needed, yet equal to the table that holds them
    prices = t["order_item"].join(t["product"], "product_id").filter("unit_price_cents <> price_cents")
    sums = t["order_item"].groupBy("order_id").agg(F.sum("line_total_cents").alias("s")).join(t["order"], "order_id").filter("s <> total_cents")
    snapshots = t["customer"].join(t["person"].select("person_id", F.col("email").alias("e")), "person_id").filter("email <> e")
    bought = t["review"].join(t["order_item"].select(F.col("order_id").alias("customer_id"), "product_id"), ["customer_id", "product_id"], "left_anti")
    assert prices.count() == sums.count() == snapshots.count() == bought.count() == 0


def test_same_rows_in_every_partitioning(spark):
    a = S.network(spark, -6)["node"]
    b = S.network(spark, -6)["node"].repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())


def test_nested_collections(spark):
    t = S.network(spark, -5)
    d = S.nested(spark, -5, tables=t)
    n = S.counts(S.NETWORK | S.NESTED, -5)
    assert {k: v.count() for k, v in d.items()} == {"grp_tree": n["grp"], "node_rich": n["node"], "event_log": n["event_log"], "bucket": n["bucket"]}
    tree = {r.grp_id: r for r in d["grp_tree"].collect()}
    grp = {r.grp_id: r for r in t["grp"].collect()}
    for k, r in tree.items():
        below = sorted(x for x, g in grp.items() if g.parent_id == k)
        assert r.children == below[: S.CHILDREN_MOST] and r.stats.child_count == len(below) and r.ancestors == ([r.parent_id] if r.parent_id else [])
        assert r.path == ("/" + tree[r.parent_id].name if r.parent_id else "") + "/" + r.name
    assert sum(r.stats.node_count for r in tree.values()) == n["node"]
    degree = {r.src_id: r["count"] for r in t["link"].groupBy("src_id").count().collect()}
    rich = {r.node_id: r for r in d["node_rich"].select("node_id", "connections.out_degree", F.size("connections.outgoing").alias("shown"), "dimensions.d0.count").collect()}
    assert all(r.out_degree == degree.get(k, 0) and r.shown == min(r.out_degree, S.CHILDREN_MOST) for k, r in rich.items())
    assert sum(r["count"] or 0 for r in rich.values()) == t["measure"].filter("dim = 0").count()
    for r in d["bucket"].limit(50).collect():
        vals = [x.val for x in r.data]
        mean = sum(vals) / len(vals)
        assert r["count"] == len(vals) and r.min == min(vals) and abs(r.avg - mean) < 1e-9 and abs(r.stddev**2 - sum((x - mean) ** 2 for x in vals) / len(vals)) < 1e-6
    kinds = {r.event_type: set(r.keys) for r in d["event_log"].select("event_type", F.json_object_keys("payload").alias("keys")).filter("event_type <> 'measure_recorded'").distinct().collect()}
    assert set(kinds) == set(S.EVENTS) - {"measure_recorded"} and kinds["tag_changed"] == {"old_tag", "new_tag"} and kinds["doc_updated"] == {"doc_id", "changes"}
