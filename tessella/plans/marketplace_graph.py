"""The marketplace workload over a property graph: vertices by label, edges by type, patterns as chains of hops.
Results equal the relational forms', so one oracle serves all.

``hop`` follows one edge type from a column of vertex ids; a filter on the start or on an edge's properties is pushed
below the join by Catalyst, so the order of the hops is left to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources import stores

from . import marketplace as M
from .marketplace import CATEGORIES, COUNTRIES, DONE, N, PAGE, PERSON, PERSONS, PRODUCTS, SELLERS, SHOWN, SINCE, TOP, Shop, _mean, _total

#: label -> (relation, id)
VERTICES = {"Person": ("person", "person_id"), "Customer": ("buyer", "customer_id"), "Seller": ("seller", "seller_id"), "Product": ("product", "product_id"), "Order": ("purchase", "order_id"), "Review": ("review", "review_id")}
#: type -> (relation, source's column, target's column, properties)
EDGES = {
    "SNAPSHOT_OF": ("buyer", "customer_id", "person_id", ()),
    "PLACED": ("purchase", "customer_id", "order_id", ()),
    "CONTAINS": ("item", "order_id", "product_id", ("line", "unit_price_cents", "quantity", "line_total_cents")),
    "OFFERS": ("product", "seller_id", "product_id", ()),
    "HAS_CATEGORY": ("has_category", "product_id", "category_id", ()),
    "HAS_INTEREST": ("has_interest", "person_id", "category_id", ("strength",)),
    "FOLLOWS": ("follows", "from_id", "to_id", ()),
    "OF_PRODUCT": ("review", "review_id", "product_id", ()),
}


class Graph:
    def __init__(self, shop: Shop):
        self.shop = shop

    def vertices(self, label: str, *properties: str) -> DataFrame:
        relation, key = VERTICES[label]
        return getattr(self.shop, relation).select(key, *properties)

    def properties(self, label: str) -> list[str]:
        """All properties of a label's vertices."""
        relation, key = VERTICES[label]
        return [c for c in getattr(self.shop, relation).columns if c != key]

    def edges(self, kind: str, src: str = "src", dst: str = "dst", *properties: str) -> DataFrame:
        relation, a, b, known = EDGES[kind]
        return getattr(self.shop, relation).select(F.col(a).alias(src), F.col(b).alias(dst), *(p for p in properties if p in known))

    def hop(self, df: DataFrame, at: str, kind: str, to: str, *properties: str, back: bool = False) -> DataFrame:
        """Rows of ``df`` with, for each edge at vertex ``at``, the vertex at its other end as ``to``."""
        ends = (to, at) if back else (at, to)
        return df.join(self.edges(kind, *ends, *properties), at)

    def load(self, df: DataFrame, label: str, *properties: str) -> DataFrame:
        """Properties of the vertices that ``df`` names by the label's id."""
        return df.join(self.vertices(label, *properties), VERTICES[label][1])


class Stored(Graph):
    """The graph as ``store`` wrote it: a table per label and per type of edges."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def vertices(self, label: str, *properties: str) -> DataFrame:
        return stores.table(self.spark, self.path, label).select(VERTICES[label][1], *properties)

    def properties(self, label: str) -> list[str]:
        return [c for c in stores.table(self.spark, self.path, label).columns if c != VERTICES[label][1]]

    def edges(self, kind: str, src: str = "src", dst: str = "dst", *properties: str) -> DataFrame:
        known = EDGES[kind][3]
        return stores.table(self.spark, self.path, kind).select(F.col("src").alias(src), F.col("dst").alias(dst), *(p for p in properties if p in known))


def store(graph: Graph, path: str) -> None:
    """Write every label's vertices with all their properties, by id, and every type's edges, by source."""
    for label, (relation, key) in VERTICES.items():
        stores.load(getattr(graph.shop, relation), path, label, key)
    for kind, (_, _, _, known) in EDGES.items():
        stores.load(graph.edges(kind, "src", "dst", *known), path, kind, "src")


def kept(spark, sf_dir: str) -> Stored:
    """The session's stored graph over a folder of tables."""
    return Stored(spark, stores.once(spark, sf_dir, "graph", lambda path: store(Graph(Shop(spark, sf_dir)), path)))


def _since(since: str):
    return F.col("ordered_at") >= F.to_timestamp_ntz(F.lit(since))


def _orders(g: Graph, *properties: str) -> DataFrame:
    return g.vertices("Order", "status", *properties).filter(F.col("status").isin(*DONE))


def _sold(g: Graph, since: str, *properties: str) -> DataFrame:
    """(Order)-[CONTAINS]->(Product)<-[OFFERS]-(Seller) of completed orders since a day."""
    rows = g.hop(_orders(g, "ordered_at").filter(_since(since)), "order_id", "CONTAINS", "product_id", *properties)
    return g.hop(rows, "product_id", "OFFERS", "seller_id", back=True)


def _persons_orders(g: Graph, persons: DataFrame) -> DataFrame:
    """(Person)<-[SNAPSHOT_OF]-(Customer)-[PLACED]->(Order)"""
    return g.hop(g.hop(persons, "person_id", "SNAPSHOT_OF", "customer_id", back=True), "customer_id", "PLACED", "order_id")


def _one(g: Graph, label: str, *ids: int) -> DataFrame:
    return g.vertices(label).filter(F.col(VERTICES[label][1]).isin(*ids))


def order_history(g: Graph, person=PERSON):
    rows = g.load(_persons_orders(g, _one(g, "Person", person)), "Order", "ordered_at", "status", "total_cents", "currency")
    return rows.select("order_id", "ordered_at", "status", "total_cents", "currency").orderBy(F.desc("ordered_at"), "order_id")


def order_details(g: Graph, person=PERSON):
    orders = g.load(_persons_orders(g, _one(g, "Person", person)), "Order", "ordered_at", "status")
    rows = g.load(g.hop(orders, "order_id", "CONTAINS", "product_id", *EDGES["CONTAINS"][3]), "Product", "title")
    return rows.select("order_id", "ordered_at", "status", "line", "product_id", "title", "unit_price_cents", "quantity", "line_total_cents")


def purchase_count(g: Graph, persons=PERSONS, products=PRODUCTS):
    orders = _persons_orders(g, _one(g, "Person", *persons)).join(_orders(g), "order_id")
    return g.hop(orders, "order_id", "CONTAINS", "product_id").filter(F.col("product_id").isin(*products)).agg(N("*").alias("n"))


def seller_daily_revenue(g: Graph, since=SINCE, sellers=SELLERS):
    rows = _sold(g, since, "line_total_cents").filter(F.col("seller_id").isin(*sellers))
    return rows.groupBy(F.to_date("ordered_at").alias("day")).agg(_total("line_total_cents", "revenue_cents"), F.countDistinct("order_id").alias("orders"))


def top_products(g: Graph, since=SINCE, categories=CATEGORIES, limit=PAGE):
    """The two sides of (Order)-[CONTAINS]->(Product)-[HAS_CATEGORY]->(c) meet as sums by product."""
    times = g.edges("HAS_CATEGORY", "product_id", "category_id").filter(F.col("category_id").isin(*categories)).groupBy("product_id").agg(N("*").alias("times"))
    sums = g.hop(_orders(g, "ordered_at").filter(_since(since)), "order_id", "CONTAINS", "product_id", "line_total_cents", "quantity").groupBy("product_id").agg(_total("line_total_cents", "r"), _total("quantity", "u"))
    rows = g.load(sums.join(times, "product_id"), "Product", "title")
    return rows.select("product_id", "title", (F.col("r") * F.col("times")).alias("revenue_cents"), (F.col("u") * F.col("times")).alias("units")).orderBy(F.desc("revenue_cents"), "product_id").limit(limit)


def spend_buckets(g: Graph, since=SINCE, low=20_000_000, high=60_000_000):
    orders = g.hop(_orders(g, "ordered_at", "total_cents").filter(_since(since)), "order_id", "PLACED", "customer_id", back=True)
    spend = g.hop(orders, "customer_id", "SNAPSHOT_OF", "person_id").groupBy("person_id").agg(_total("total_cents", "spend"))
    band = F.when(F.col("spend") < low, "low").when(F.col("spend") < high, "mid").otherwise("high")
    return spend.groupBy(band.alias("bucket")).agg(N("*").alias("persons"))


def many_sellers(g: Graph, since=SINCE, least=3, limit=PAGE):
    rows = g.hop(g.hop(_sold(g, since), "order_id", "PLACED", "customer_id", back=True), "customer_id", "SNAPSHOT_OF", "person_id")
    sums = rows.groupBy("person_id").agg(F.countDistinct("seller_id").alias("distinct_sellers"), F.countDistinct("order_id").alias("orders"))
    return sums.filter(F.col("distinct_sellers") >= least).orderBy(F.desc("distinct_sellers"), "person_id").limit(limit)


def who_to_follow(g: Graph, person=PERSON, limit=PAGE):
    """(far)-[FOLLOWS]->(near)-[FOLLOWS]->(person) where not (far)-[FOLLOWS]->(person)"""
    near = g.edges("FOLLOWS", "near", "person_id").filter(F.col("person_id") == person).select("near")
    far = g.hop(near, "near", "FOLLOWS", "far", back=True).filter(F.col("far") != person)
    rows = far.join(near.withColumnRenamed("near", "far"), "far", "left_anti").groupBy(F.col("far").alias("person_id")).agg(N("*").alias("paths"))
    return rows.orderBy(F.desc("paths"), "person_id").limit(limit)


def feed(g: Graph, persons=PERSONS, limit=PAGE):
    """(Person)-[HAS_INTEREST]->(c)<-[HAS_CATEGORY]-(Product), strengths summed at c before the second hop."""
    weights = g.hop(_one(g, "Person", *persons), "person_id", "HAS_INTEREST", "category_id", "strength").groupBy("category_id").agg(_total("strength", "w"))
    rows = g.load(g.hop(weights, "category_id", "HAS_CATEGORY", "product_id", back=True), "Product", "is_active").filter("is_active")
    return rows.groupBy("product_id").agg(_total("w", "interest_score")).orderBy(F.desc("interest_score"), "product_id").limit(limit)


def product_page(g: Graph, products=PRODUCTS, shown=SHOWN):
    """Pattern comprehensions: lists of neighbours, null where there are none."""
    page = g.vertices("Product", "title", "price_cents").filter(F.col("product_id").isin(*products))
    joined = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    seen = g.load(g.hop(page.select("product_id"), "product_id", "OF_PRODUCT", "review_id", back=True), "Review", "helpful_votes")
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("helpful_votes")).alias("v"), "review_id"))), 1, shown), lambda x: x["review_id"])
    reviews = seen.groupBy("product_id").agg(joined(best).alias("reviews"))
    categories = g.hop(page.select("product_id"), "product_id", "HAS_CATEGORY", "category_id").groupBy("product_id").agg(joined(F.array_sort(F.collect_list("category_id"))).alias("categories"))
    return page.join(reviews, "product_id", "left").join(categories, "product_id", "left")


def also_bought(g: Graph, products=PRODUCTS, limit=TOP):
    """(chosen)<-[CONTAINS]-(Order)-[CONTAINS]->(other), chosen edges counted at the order."""
    chosen = F.col("product_id").isin(*products)
    seeds = g.edges("CONTAINS", "order_id", "product_id").filter(chosen).groupBy("order_id").agg(N("*").alias("k")).join(_orders(g), "order_id")
    others = g.hop(seeds, "order_id", "CONTAINS", "product_id").filter(~chosen)
    return others.groupBy("product_id").agg(_total("k", "co_buy")).orderBy(F.desc("co_buy"), "product_id").limit(limit)


def buyer_activity(g: Graph, countries=COUNTRIES):
    rows = g.hop(g.vertices("Customer", "country_code", "is_active").filter(F.col("country_code").isin(*countries)), "customer_id", "SNAPSHOT_OF", "person_id")
    return rows.groupBy("country_code", "is_active").agg(N("*").alias("customers"), F.countDistinct("person_id").alias("persons"))


def quantity_distribution(g: Graph, least=10_000):
    rows = g.edges("CONTAINS", "order_id", "product_id", *EDGES["CONTAINS"][3]).filter(F.col("unit_price_cents") >= least)
    return rows.groupBy("quantity").agg(N("*").alias("items"), _total("quantity", "units"), _total("line_total_cents", "revenue_cents"), _mean("unit_price_cents", "avg_unit_price_cents"))


def seller_sales(g: Graph, since=SINCE, sellers=SELLERS, limit=PAGE):
    rows = _sold(g, since, "quantity", "line_total_cents").filter(F.col("seller_id").isin(*sellers)).groupBy("seller_id")
    sums = rows.agg(F.countDistinct("order_id").alias("orders"), N("*").alias("items"), _total("quantity", "units"), _total("line_total_cents", "revenue_cents"))
    return sums.orderBy(F.desc("revenue_cents"), "seller_id").limit(limit)


def country_status(g: Graph, since=SINCE, countries=COUNTRIES):
    there = g.vertices("Customer", "country_code").filter(F.col("country_code").isin(*countries))
    rows = g.load(g.hop(there, "customer_id", "PLACED", "order_id"), "Order", "ordered_at", "status", "total_cents").filter(_since(since))
    return rows.groupBy("country_code", "status").agg(N("*").alias("orders"), _total("total_cents", "revenue_cents"), _mean("total_cents", "avg_order_cents"))


def review_summary(g: Graph, products=PRODUCTS, votes=5, limit=PAGE):
    rows = g.load(g.hop(_one(g, "Product", *products), "product_id", "OF_PRODUCT", "review_id", back=True), "Review", "rating", "helpful_votes").filter(F.col("helpful_votes") >= votes)
    sums = rows.groupBy("product_id").agg(N("*").alias("reviews"), _mean("rating", "avg_rating"), _total("helpful_votes", "helpful_votes"), F.max("helpful_votes").alias("max_helpful_votes"))
    return sums.orderBy(F.desc("reviews"), "product_id").limit(limit)


def interest_summary(g: Graph, categories=CATEGORIES, least=2, limit=PAGE):
    rows = g.hop(g.vertices("Person", "is_active").filter("is_active"), "person_id", "HAS_INTEREST", "category_id", "strength").filter(F.col("category_id").isin(*categories) & (F.col("strength") >= least))
    sums = rows.groupBy("category_id").agg(F.countDistinct("person_id").alias("interested_persons"), _mean("strength", "avg_strength"), F.max("strength").alias("max_strength"))
    return sums.orderBy(F.desc("interested_persons"), "category_id").limit(limit)


def catalog_summary(g: Graph, categories=CATEGORIES, most=99_000, least=5, limit=PAGE):
    live = g.vertices("Product", "is_active", "stock_qty", "price_cents").filter(F.col("is_active") & (F.col("price_cents") <= most) & (F.col("stock_qty") >= least))
    rows = g.hop(live, "product_id", "HAS_CATEGORY", "category_id").filter(F.col("category_id").isin(*categories)).groupBy("category_id")
    return rows.agg(F.countDistinct("product_id").alias("products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents")).orderBy(F.desc("products"), "category_id").limit(limit)


def catalog_health(g: Graph, sellers=SELLERS, limit=PAGE):
    own = g.edges("OFFERS", "seller_id", "product_id").filter(F.col("seller_id").isin(*sellers))
    rows = g.load(own, "Product", "is_active", "stock_qty", "price_cents").groupBy("seller_id")
    sums = rows.agg(N("*").alias("products"), F.count_if("is_active").alias("active_products"), F.count_if(~F.col("is_active")).alias("inactive_products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents"))
    return sums.orderBy(F.desc("products"), "seller_id").limit(limit)


def follow_countries(g: Graph, countries=COUNTRIES, limit=PAGE):
    start = g.vertices("Person", "country_code").filter(F.col("country_code").isin(*countries)).withColumnRenamed("country_code", "from_country")
    edges = g.hop(start, "person_id", "FOLLOWS", "to_id").select("from_country", F.col("to_id").alias("person_id"))
    sums = g.load(edges, "Person", "country_code", "is_active").groupBy("from_country", F.col("country_code").alias("to_country")).agg(N("*").alias("edges"), F.count_if("is_active").alias("active_targets"))
    return sums.orderBy(F.desc("edges"), "from_country", "to_country").limit(limit)


class _Labels:
    """Vertices by their relation's name, for queries that follow no edge."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def __getattr__(self, name: str) -> DataFrame:
        label = next(k for k, v in VERTICES.items() if v[0] == name)
        return self.graph.vertices(label, *self.graph.properties(label))


def query(f):
    """The graph form of a relational query: its own, or the relational text over one label's vertices."""
    own = globals().get(f.__name__)
    return own if own is not None else lambda g, **k: f(_Labels(g), **k)


def queries() -> dict:
    return {f"{M._name(k, f)}_graph": (lambda spark, sf_dir, q=query(f): q(kept(spark, sf_dir))) for k, f in enumerate(M.WORKLOAD)}


def oracle_sql() -> dict[str, str]:
    return {f"{k}_graph": v for k, v in M.oracle_sql().items()}
