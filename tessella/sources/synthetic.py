"""Synthetic tables of two schemas, ``network`` (groups, nodes, links, logs, measures, texts) and ``shop`` (persons,
buyers, sellers, products, orders, items, reviews, categories, interests, follows), at any scale.

Every value is a hash of (seed, table, column, key): the same in each run and partitioning, and computable from a
key alone. So a buyer's snapshot, an item's price and a review's product are computed where they are needed, without a
join, and a table is one map over ``spark.range``. Skewed picks invert the distribution function of a piecewise
power law instead of holding a table of weights. Links and reviews drop repeated pairs, so they may have a few rows
less than asked for.
"""

from __future__ import annotations

import math
import random
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed values.
NOW = datetime(2025, 1, 1)
NETWORK = {"grp": (200, 0.60), "node": (10_000, 1.00), "link": (30_000, 1.10), "log": (80_000, 1.05), "measure": (150_000, 1.05), "doc": (5_000, 0.90), "tag": (500, 0.70)}
SHOP = {"person": (5_000, 1.00), "seller": (500, 0.90), "product": (2_000, 0.95), "category": (200, 0.60), "order": (20_000, 1.05), "review": (10_000, 1.05), "follows": (20_000, 1.10)}
COUNTRIES = ["US", "GB", "DE", "FR", "CZ", "PL", "ES", "IT", "NL", "SE", "IN", "BR", "CA", "AU"]
STATUSES, STATUS_WEIGHTS = ["paid", "shipped", "canceled", "refunded"], [0.70, 0.20, 0.07, 0.03]
NODE_STATUS_WEIGHTS = [0.70, 0.15, 0.08, 0.04, 0.03]
DIM_RANGES = [(0, 100), (0, 100), (0, 1000), (0, 10000), (20, 100)]
FOLLOWED_MOST = 25


def counts(schema: dict[str, tuple[int, float]], scale: float) -> dict[str, int]:
    return {k: max(1, round(n * 2 ** (scale * power))) for k, (n, power) in schema.items()}


class Draw:
    """Values of one table's rows by key."""

    def __init__(self, seed: int, table: str, *key: Column):
        self.seed, self.table, self.key = seed, table, key

    def u(self, name: str, *more: Column) -> Column:
        """A number in [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(f"{self.seed}/{self.table}/{name}"), *self.key, *more), 11) / F.lit(float(1 << 53))

    def whole(self, name: str, least: int, most: int, *more: Column) -> Column:
        return (F.floor(self.u(name, *more) * (most - least + 1)) + least).cast("long")

    def real(self, name: str, least: float, most: float, digits: int) -> Column:
        return F.round(self.u(name) * (most - least) + least, digits)

    def chance(self, name: str, p: float, *more: Column) -> Column:
        return self.u(name, *more) < p

    def choice(self, name: str, values: list, weights: list[float] | None = None) -> Column:
        u, upto, out = self.u(name), 0.0, None
        for v, w in zip(values, weights or [1.0] * len(values), strict=True):
            upto += w / sum(weights or [1.0] * len(values))
            out = F.when(u < upto, F.lit(v)) if out is None else out.when(u < upto, F.lit(v))
        return out.otherwise(F.lit(values[-1]))

    def since(self, name: str, years: float | Column, least_days: int = 0) -> Column:
        seconds = F.floor(self.u(name) * years * (365 * 86400)) + least_days * 86400
        return F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    def word(self, name: str, *more: Column) -> Column:
        """One of a thousand made-up words: six hexadecimal digits of a number's hash as letters."""
        return F.translate(F.substring(F.hex(F.xxhash64(self.whole(name, 1, 1000, *more))), -6, 6), "0123456789ABCDEF", "bakedolimunopris")

    def text(self, name: str, least: int, most: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), self.whole(f"{name} n", least, most)), lambda i: self.word(name, i)), " ")

    def distinct(self, name: str, k: Column, most_k: int, n: int) -> Column:
        """``k`` (``most_k`` at most) different numbers from 0 to n - 1."""
        start, step = self.whole(f"{name} start", 0, n - 1), self.whole(f"{name} step", 1, max(1, n // most_k))
        return F.transform(F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(n)).cast("long")), lambda i: (start + i * step) % n)

    def skewed(self, name: str, n: int, hot: int, hot_weight: float, hot_power: float, power: float, *more: Column) -> Column:
        """1 to n by weight: hot_weight * i ** -hot_power for the first ``hot``, i ** -power for the others."""
        area = lambda a, b, s: (b ** (1 - s) - a ** (1 - s)) / (1 - s)
        a, b = hot_weight * area(1, hot + 1, hot_power), area(hot + 1, n + 1, power) if n > hot else 0.0
        share, u = a / (a + b), self.u(name, *more)
        pick = lambda v, lo, hi, s: F.pow(v * (hi ** (1 - s) - lo ** (1 - s)) + lo ** (1 - s), F.lit(1 / (1 - s)))
        x = F.when(u < share, pick(u / share, 1, hot + 1, hot_power)) if share > 0 else F.when(F.lit(False), 0.0)
        return F.least(F.floor(x.otherwise(pick((u - share) / max(1 - share, 1e-12), hot + 1, n + 1, power))), F.lit(n)).cast("long")


def _rows(spark: SparkSession, n: int, key: str) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", key)


def network(spark: SparkSession, scale: float, seed: int = 0) -> dict[str, DataFrame]:
    n, c = counts(NETWORK, scale), F.col
    roots = min(max(round(math.sqrt(n["grp"])), 5), 50)
    g, v, e, lo, m, t = (Draw(seed, name, c(key)) for name, key in (("grp", "grp_id"), ("node", "node_id"), ("link", "k"), ("log", "log_id"), ("measure", "measure_id"), ("doc", "doc_id")))
    child = c("grp_id") > roots
    grp = _rows(spark, n["grp"], "grp_id").select("grp_id", g.word("name").alias("name"), F.when(child, g.whole("parent", 1, roots)).alias("parent_id"), child.cast("int").alias("depth"), g.real("priority", 0, 1, 4).alias("priority"))
    status = v.choice("status", list(range(5)), NODE_STATUS_WEIGHTS)
    node = _rows(spark, n["node"], "node_id").select(
        "node_id", F.format_string("T%04d", v.skewed("tag", n["tag"], 0, 0.0, 1.2, 1.2) - 1).alias("tag"), v.whole("val_int", 1, 1000).alias("val_int"), v.real("val_float", 0, 1, 6).alias("val_float"),
        v.text("note", 10, 30).alias("note"), status.alias("status"), v.whole("grp", 1, n["grp"]).alias("grp_id"), v.since("created", 3).alias("created_at"), (status == 0).alias("is_active"),
    )
    src = e.skewed("src", n["node"], max(1, n["node"] // 50), 10.0, 0.5, 0.3)
    pairs = _rows(spark, n["link"], "k").select("k", src.alias("src_id"))
    pairs = pairs.select("k", "src_id", ((c("src_id") + e.whole("dst", 0, n["node"] - 2)) % n["node"] + 1).alias("dst_id")).groupBy("src_id", "dst_id").agg(F.min("k").alias("k"))
    link = pairs.select("src_id", "dst_id", e.whole("kind", 0, 4).alias("kind"), e.real("weight", 0, 1, 4).alias("weight"), e.since("created", 2).alias("created_at"))
    log = _rows(spark, n["log"], "log_id").select("log_id", lo.whole("node", 1, n["node"]).alias("node_id"), lo.whole("kind", 0, 7).alias("kind"), F.when(lo.chance("has", 0.8), lo.real("val", 0, 100, 4)).alias("val"), lo.since("at", 2).alias("occurred_at"))
    hot = max(1, n["node"] // 10)
    dim = m.choice("dim", list(range(5)))
    low, high = (F.element_at(F.array(*(F.lit(float(r[k])) for r in DIM_RANGES)), c("dim") + 1) for k in (0, 1))
    measure = _rows(spark, n["measure"], "measure_id").select("measure_id", dim.alias("dim")).select(
        "measure_id", m.skewed("node", n["node"], hot, 5.0, 0.0, 0.0).alias("node_id"), "dim", F.round(low + m.u("val") * (high - low), 2).alias("val"), F.to_date(m.since("at", F.pow(m.u("recent"), 1.5))).alias("recorded_at"),
    )
    step = next(p for p in (7919, 7907, 7901, 7883, 1) if math.gcd(p, n["node"]) == 1)
    meta = F.to_json(F.struct(t.choice("lang", ["en_US", "de_DE", "fr_FR", "es_ES"]).alias("lang"), t.whole("version", 1, 5).alias("version"), F.split(t.text("tags", 1, 5), " ").alias("tags"), t.real("score", 0, 10, 2).alias("score")))
    doc = _rows(spark, min(n["doc"], n["node"]), "doc_id").select("doc_id", (c("doc_id") * step % n["node"] + 1).alias("node_id"), t.text("body", 200, 500).alias("body"), meta.alias("meta"), t.since("created", 2).alias("created_at"))
    return {"grp": grp, "node": node, "link": link, "log": log, "measure": measure, "doc": doc}


# Event types and the units of the measures' dimensions.
EVENTS = ["status_changed", "link_added", "measure_recorded", "doc_updated", "activated", "deactivated", "tag_changed"]
EVENT_WEIGHTS = [0.2, 0.2, 0.3, 0.1, 0.08, 0.07, 0.05]
NESTED = {"event_log": (60_000, 1.05), "bucket": (5_000, 1.05)}
CHILDREN_MOST, READINGS_MOST = 20, 20


def _payload(d: Draw, nodes: int) -> dict[str, Column]:
    """An event's payload by its type: the fields differ, so it is kept as JSON."""
    status, trigger = ["new", "open", "closed", "failed"], ["rule", "user", "schedule"]
    by_rule = F.struct(d.choice("trigger", trigger).alias("trigger"), d.whole("rule", 1, 50).alias("rule_id"))
    return {
        "status_changed": F.struct(d.choice("from", status).alias("from_status"), d.choice("to", status).alias("to_status"), d.word("reason").alias("reason")),
        "link_added": F.struct(d.whole("src", 1, nodes).alias("src_id"), d.whole("dst", 1, nodes).alias("dst_id"), d.whole("kind", 0, 4).alias("kind")),
        "measure_recorded": F.struct(d.whole("dim", 0, 4).alias("dim"), d.real("val", 0, 100, 2).alias("val"), F.when(d.chance("had", 0.7), d.real("prev", 0, 100, 2)).alias("prev_val")),
        "doc_updated": F.struct(d.whole("doc", 1, nodes).alias("doc_id"), F.struct(d.whole("version", 2, 9).alias("version"), d.word("title").alias("title")).alias("changes")),
        "activated": by_rule,
        "deactivated": by_rule,
        "tag_changed": F.struct(d.word("old").alias("old_tag"), d.word("new").alias("new_tag")),
    }


def nested(spark: SparkSession, scale: float, seed: int = 0, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The network's document collections: ``grp_tree``, ``node_rich``, ``event_log`` (payloads of several shapes, as JSON) and ``bucket``.

    An array of a parent's children has a stated bound (children of a group, readings of a dimension): what lies beyond stays in its table.
    """
    t, n, c = tables or network(spark, scale, seed), counts(NETWORK | NESTED, scale), F.col
    grp, node = t["grp"], t["node"]
    up = grp.select(c("grp_id").alias("parent_id"), c("name").alias("parent_name"))
    path = F.when(c("parent_id").isNull(), F.concat(F.lit("/"), "name")).otherwise(F.concat(F.lit("/"), "parent_name", F.lit("/"), "name"))
    first = W.partitionBy("parent_id").orderBy("grp_id")
    below = grp.filter("parent_id IS NOT NULL").withColumn("k", F.row_number().over(first)).withColumn("child_count", F.count("*").over(W.partitionBy("parent_id"))).filter(c("k") <= CHILDREN_MOST)
    below = below.groupBy(c("parent_id").alias("grp_id")).agg(F.array_sort(F.collect_list("grp_id")).alias("children"), F.first("child_count").alias("child_count"))
    used = node.groupBy("grp_id").agg(F.count("*").alias("node_count"), F.count_if("is_active").alias("active_node_count"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    grp_tree = grp.join(up, "parent_id", "left").join(below, "grp_id", "left").join(used, "grp_id", "left").select(
        "grp_id", "name", "depth", "priority", path.alias("path"), "parent_id", F.when(c("parent_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("parent_id")).alias("ancestors"),
        F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), F.struct(zero("node_count"), zero("active_node_count"), zero("child_count")).alias("stats"),
    )

    m = t["measure"].withColumn("k", F.row_number().over(W.partitionBy("node_id", "dim").orderBy(F.desc("recorded_at"), "measure_id")))
    reading = F.sort_array(F.collect_list(F.when(c("k") <= READINGS_MOST, F.struct(c("recorded_at").alias("ts"), c("val").alias("val")))))
    per = m.groupBy("node_id", "dim").agg(F.struct(F.count("*").alias("count"), F.avg("val").alias("avg"), F.min("val").alias("min"), F.max("val").alias("max"), reading.alias("readings")).alias("own"))
    dims = per.groupBy("node_id").agg(F.struct(*(F.first(F.when(c("dim") == k, c("own")), ignorenulls=True).alias(f"d{k}") for k in range(len(DIM_RANGES)))).alias("dimensions"))
    label = F.when(c("weight") > 0.66, "strong").when(c("weight") > 0.33, "usual").otherwise("weak")
    out = t["link"].withColumn("k", F.row_number().over(W.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id")))
    outgoing = F.sort_array(F.collect_list(F.when(c("k") <= CHILDREN_MOST, F.struct("dst_id", "kind", "weight", F.struct(label.alias("label"), (c("weight") > 0.5).alias("strong")).alias("attrs")))))
    outs = out.groupBy(c("src_id").alias("node_id")).agg(outgoing.alias("outgoing"), F.count("*").alias("out_degree"))
    ins = t["link"].groupBy(c("dst_id").alias("node_id")).agg(F.count("*").alias("in_degree"))
    v = Draw(seed, "rich", c("node_id"))
    score = c("val_float") * 0.6 + c("val_int") / 1000 * 0.4
    history = F.transform(F.sequence(F.lit(1).cast("long"), v.whole("changes", 1, 4)), lambda i: F.struct(i.alias("version"), v.word("by", i).alias("changed_by")))
    node_rich = node.join(grp.select("grp_id", F.struct(c("grp_id"), c("name"), c("depth")).alias("grp")), "grp_id", "left").join(dims, "node_id", "left").join(outs, "node_id", "left").join(ins, "node_id", "left").select(
        "node_id",
        F.struct("tag", "status", "is_active", F.array_compact(F.array(F.when(c("is_active"), "live"), F.when(c("status") > 2, "trouble"))).alias("labels"), F.struct(v.chance("hot", 0.1).alias("is_hot"), v.chance("old", 0.05).alias("is_deprecated")).alias("flags")).alias("identity"),
        F.struct(F.struct("val_int", "val_float").alias("raw"), F.round(score, 6).alias("composite"), F.when(score > 0.66, "gold").when(score > 0.33, "silver").otherwise("bronze").alias("tier")).alias("scores"),
        F.struct("grp_id", "grp", "created_at", "note").alias("context"), "dimensions",
        F.struct(F.coalesce("outgoing", F.array().cast(outs.schema["outgoing"].dataType)).alias("outgoing"), zero("out_degree"), zero("in_degree")).alias("connections"),
        F.struct(F.lit(1).alias("schema_version"), v.word("by").alias("created_by"), history.alias("history")).alias("audit"),
    )

    e = Draw(seed, "event_log", c("event_id"))
    kind = e.choice("type", EVENTS, EVENT_WEIGHTS)
    shapes = _payload(e, n["node"])
    payload = F.lit(None).cast("string")
    for name in EVENTS:
        payload = F.when(c("event_type") == name, F.to_json(shapes[name])).otherwise(payload)
    event_log = _rows(spark, n["event_log"], "event_id").withColumn("event_type", kind).select(
        "event_id", e.whole("node", 1, n["node"]).alias("node_id"), "event_type", e.since("at", 1).alias("occurred_at"),
        F.struct(e.whole("user", 1, 200).alias("user_id"), e.choice("role", ["admin", "editor", "viewer", "system"]).alias("role"), F.hex(F.xxhash64(c("event_id"), F.lit(seed))).alias("session")).alias("actor"),
        payload.alias("payload"), F.struct(e.choice("source", ["api", "batch", "ui"]).alias("source"), F.sha1(c("event_id").cast("string")).alias("request_id")).alias("context"),
    )

    b = Draw(seed, "bucket", c("bucket_id"))
    low, high = (F.element_at(F.array(*(F.lit(float(r[k])) for r in DIM_RANGES)), c("dim") + 1) for k in (0, 1))
    data = F.transform(F.sequence(F.lit(0).cast("long"), b.whole("n", 20, 60) - 1), lambda i: F.struct((i * 60).alias("offset_s"), F.round(low + b.u("val", i) * (high - low), 2).alias("val"), F.when(b.chance("bad", 0.05, i), "suspect").otherwise("good").alias("quality")))
    raw = _rows(spark, n["bucket"], "bucket_id").withColumn("dim", b.whole("dim", 0, 4).cast("int")).select("bucket_id", b.whole("node", 1, n["node"]).alias("node_id"), "dim", F.date_trunc("HOUR", b.since("at", 1)).cast("timestamp_ntz").alias("hour_start"), F.lit(1).alias("span_hours"), data.alias("data"))
    vals = F.transform("data", lambda x: x["val"])
    add = lambda f: F.aggregate(vals, F.lit(0.0), lambda a, x: a + f(x))
    sized = raw.withColumn("count", F.size("data")).withColumn("sum", add(lambda x: x)).withColumn("avg", c("sum") / c("count"))
    bucket = sized.select("bucket_id", "node_id", "dim", "hour_start", "span_hours", "count", F.array_min(vals).alias("min"), F.array_max(vals).alias("max"), F.round("sum", 2).alias("sum"), "avg", F.sqrt(F.aggregate("data", F.lit(0.0), lambda a, x: a + F.pow(x["val"] - c("avg"), 2)) / c("count")).alias("stddev"), "data")
    return {"grp_tree": grp_tree, "node_rich": node_rich, "event_log": event_log, "bucket": bucket}


def _person(seed: int, key: Column) -> dict[str, Column]:
    d = Draw(seed, "person", key)
    name = F.initcap(F.concat_ws(" ", d.word("first"), d.word("last")))
    profile = F.to_json(F.struct(d.text("bio", 5, 20).alias("bio"), d.choice("tz", ["Europe/Prague", "Europe/London", "America/New_York", "Asia/Tokyo"]).alias("tz"), d.choice("lang", ["en_US", "de_DE", "fr_FR", "es_ES"]).alias("lang")))
    email = F.concat(F.translate(F.lower(name), " ", "."), key.cast("string"), F.lit("@"), d.word("host"), F.lit(".com"))
    return {"name": name, "email": email, "created_at": d.since("created", 3), "country_code": d.choice("country", COUNTRIES), "is_active": d.chance("active", 0.98), "profile": profile}


def _price(seed: int, product: Column) -> Column:
    return (F.round(F.pow(Draw(seed, "product", product).u("price"), 2) * 20_000) + 500).cast("long")


def _live(seed: int, product: Column) -> Column:
    return Draw(seed, "product", product).chance("active", 0.96)


def _items(seed: int, order: Column, products: int) -> Column:
    """An order's items as an array: mostly one to three, skewed to the first hundredth of the products, three draws at a live one."""
    d = Draw(seed, "item", order)
    n = F.lit(1) + d.chance("two", 0.30).cast("int") + d.chance("three", 0.12).cast("int") + F.when(d.chance("more", 0.03), d.whole("n", 2, 7)).otherwise(0)

    def item(i):
        first, second, last = (d.skewed(f"product {k}", products, max(1, products // 100), 40.0, 0.2, 0.2, i) for k in range(3))
        product = F.when(_live(seed, first), first).when(_live(seed, second), second).otherwise(last)
        quantity = F.when(d.chance("some", 0.05, i), d.whole("quantity", 3, 6, i)).when(d.chance("pair", 0.15, i), 2).otherwise(1)
        return F.struct(product.alias("product_id"), quantity.cast("long").alias("quantity"))

    picked = F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), item)
    return F.transform(picked, lambda x: F.struct(x["product_id"].alias("product_id"), _price(seed, x["product_id"]).alias("unit_price_cents"), x["quantity"].alias("quantity")))


def shop(spark: SparkSession, scale: float, seed: int = 0) -> dict[str, DataFrame]:
    n, c = counts(SHOP, scale), F.col
    p, s, o, r = (Draw(seed, name, c(key)) for name, key in (("product", "product_id"), ("seller", "seller_id"), ("order", "order_id"), ("review", "review_id")))
    someone = _person(seed, c("person_id"))
    person = _rows(spark, n["person"], "person_id").select("person_id", *(v.alias(k) for k, v in someone.items()))
    seller = _rows(spark, n["seller"], "seller_id").select("seller_id", F.initcap(s.text("name", 2, 2)).alias("display_name"), s.since("created", 5).alias("created_at"), s.choice("country", COUNTRIES).alias("country_code"), s.chance("active", 0.97).alias("is_active"))
    rng, paths = random.Random(seed), {}  # as many as the count of categories, a fixed power of the scale
    roots = min(max(round(math.sqrt(n["category"])), 10), 200)
    for k in range(1, n["category"] + 1):
        paths[k] = (paths[rng.randrange(1, k)] if k > roots else "") + f"/cat{k}"
    category = spark.createDataFrame(list(paths.items()), "category_id long, path string").select("category_id", Draw(seed, "category", c("category_id")).word("name").alias("name"), "path")
    hot = c("product_id") <= max(1, n["product"] // 100)
    stock = F.round(F.pow(p.u("stock"), 1.7) * 200).cast("long") + F.when(hot, p.whole("more", 500, 2000)).otherwise(0)
    attributes = F.to_json(F.struct(p.word("brand").alias("brand"), p.choice("color", ["black", "white", "red", "blue", "green"]).alias("color"), p.whole("weight", 50, 2049).alias("weight_g")))
    created = p.since("created", 5, 60)
    product = _rows(spark, n["product"], "product_id").select(
        "product_id", p.whole("seller", 1, n["seller"]).alias("seller_id"), F.format_string("SKU-%09d", c("product_id")).alias("sku"), p.text("title", 2, 5).alias("title"), p.text("description", 10, 20).alias("description"),
        _price(seed, c("product_id")).alias("price_cents"), p.choice("currency", ["USD", "EUR", "GBP"]).alias("currency"), stock.alias("stock_qty"), _live(seed, c("product_id")).alias("is_active"),
        created.alias("created_at"), (created + F.make_dt_interval(p.whole("updated", 0, 60).cast("int"))).alias("updated_at"), attributes.alias("attributes"),
    )
    k = F.lit(1) + p.chance("two", 0.35).cast("int") + p.chance("three", 0.10).cast("int")
    has_category = _rows(spark, n["product"], "product_id").select("product_id", F.explode(p.distinct("category", k, 3, n["category"])).alias("x")).select("product_id", (c("x") + 1).alias("category_id"), Draw(seed, "has_category", c("product_id"), c("x")).since("at", 1).alias("assigned_at"))
    w = Draw(seed, "has_interest", c("person_id"))
    each = Draw(seed, "has_interest", c("person_id"), c("x"))
    k = F.least(F.floor(F.pow(w.u("k"), 0.4) * 6) + 1, F.lit(6))
    has_interest = _rows(spark, n["person"], "person_id").select("person_id", F.explode(w.distinct("category", k, 6, n["category"])).alias("x")).select("person_id", (c("x") + 1).alias("category_id"), each.whole("strength", 1, 10).alias("strength"), each.since("at", 2).alias("created_at"))
    q = Draw(seed, "follows", c("from_id"))
    k = F.floor(F.pow(q.u("k"), 1.2) * FOLLOWED_MOST)
    # the number of followers grows faster than that of persons: as many persons follow as needed, each further time by another offset
    people = min(n["person"], math.ceil(n["follows"] / 10.9))
    ends = _rows(spark, people, "from_id").filter(k >= 1).select("from_id", F.explode(q.distinct("to", k, FOLLOWED_MOST, n["person"] - 1)).alias("x"))
    follows = ends.select("from_id", ((c("from_id") + c("x")) % n["person"] + 1).alias("to_id"), Draw(seed, "follows", c("from_id"), c("x")).since("at", 3).alias("created_at"))
    base = _rows(spark, n["order"], "order_id").select("order_id", o.whole("person", 1, n["person"]).alias("person_id"), o.since("at", 1).alias("ordered_at"), _items(seed, c("order_id"), n["product"]).alias("items"))
    customer = base.select(c("order_id").alias("customer_id"), "person_id", c("ordered_at").alias("snapshot_at"), *(v.alias(name) for name, v in someone.items() if name != "created_at"))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["unit_price_cents"] * x["quantity"])
    order = base.select(
        "order_id", c("order_id").alias("customer_id"), "ordered_at", o.choice("status", STATUSES, STATUS_WEIGHTS).alias("status"), total.alias("total_cents"), o.choice("currency", ["USD", "EUR", "GBP"]).alias("currency"),
        F.to_json(F.struct(o.choice("method", ["standard", "express"]).alias("method"), o.choice("country", COUNTRIES).alias("country"))).alias("shipping"),
        F.to_json(F.struct(o.choice("pays", ["card", "paypal", "bank"]).alias("method"), o.choice("provider", ["stripe", "paypal"]).alias("provider"))).alias("payment"),
    )
    line = base.select("order_id", "ordered_at", F.posexplode("items").alias("pos", "x"))
    order_item = line.select((c("order_id") * 16 + c("pos")).alias("order_item_id"), "order_id", "x.*", (c("x.unit_price_cents") * c("x.quantity")).alias("line_total_cents"), c("ordered_at").alias("created_at"))
    chosen = _rows(spark, n["review"], "review_id").select("review_id", r.whole("order", 1, n["order"]).alias("customer_id"))
    some = chosen.select("review_id", "customer_id", _items(seed, c("customer_id"), n["product"]).alias("items"))
    pairs = some.select("review_id", "customer_id", F.get("items", F.floor(r.u("item") * F.size("items")).cast("int"))["product_id"].alias("product_id")).groupBy("customer_id", "product_id").agg(F.min("review_id").alias("review_id"))
    review = pairs.select("review_id", "product_id", "customer_id", r.choice("rating", [5, 4, 3, 2, 1], [0.4, 0.3, 0.15, 0.1, 0.05]).alias("rating"), r.text("title", 2, 6).alias("title"), r.text("body", 20, 60).alias("body"), r.since("at", 1).alias("created_at"), r.whole("votes", 0, 50).alias("helpful_votes"))
    return {"person": person, "seller": seller, "category": category, "product": product, "has_category": has_category, "has_interest": has_interest, "follows": follows, "customer": customer, "order": order, "order_item": order_item, "review": review}


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}.parquet")
