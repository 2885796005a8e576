"""The marketplace workload over documents: orders with their buyer and items, products with seller, categories and
reviews, persons with interests and follows. Results equal the relational forms', so one oracle serves all.

``store`` writes the collections with all their parts; the registered queries read such a store, which the first of a
session loads, and leave the choice of parts to the scan's column pruning. ``Documents`` builds a collection on the way
with the parts that a query names. Where a fact lies inside one document, array functions find it without a
shuffle; orders are counted before their items are unwound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.documents import embed_many, embed_one, unwind
from tessella.sources import stores

from . import marketplace as M
from .marketplace import CATEGORIES, COUNTRIES, DONE, N, PAGE, PERSON, PERSONS, PRODUCTS, SELLERS, SHOWN, SINCE, TOP, Shop, _mean, _total

#: collection -> embedded part -> (kind, relation, the parent's key, the child's key, order of the array)
PARTS = {
    "purchase": {"customer": ("one", "buyer", "customer_id", "customer_id", None), "items": ("many", "item", "order_id", "order_id", ["line", "product_id"])},
    "product": {
        "seller": ("one", "seller", "seller_id", "seller_id", None),
        "categories": ("many", "has_category", "product_id", "product_id", ["category_id"]),
        "reviews": ("many", "review", "product_id", "product_id", ["review_id"]),
    },
    "person": {"interests": ("many", "has_interest", "person_id", "person_id", ["category_id"]), "follows": ("many", "follows", "person_id", "from_id", ["to_id"])},
    "seller": {},
    "review": {},  # a review whose product is gone lies in no product
}


class Documents:
    """The collections, built from relations."""

    def __init__(self, shop: Shop):
        self.shop = shop

    def get(self, collection: str, *parts: str) -> DataFrame:
        df = getattr(self.shop, collection)
        for part in parts:
            kind, relation, key, child_key, order = PARTS[collection][part]
            child = getattr(self.shop, relation)
            if relation == "item":
                child = embed_one(child, self.shop.product.select("product_id", "seller_id", "title"), "product_id", "product_id", "product")
            df = embed_one(df, child, key, child_key, part) if kind == "one" else embed_many(df, child, key, child_key, part, order)
        return df


class Stored(Documents):
    """The collections as ``store`` wrote them."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get(self, collection: str, *parts: str) -> DataFrame:
        return stores.table(self.spark, self.path, collection)


def store(documents: Documents, path: str) -> None:
    """Write every collection with all of its parts."""
    for collection, parts in PARTS.items():
        stores.load(documents.get(collection, *parts), path, collection)


def kept(spark, sf_dir: str) -> Stored:
    """The session's stored collections over a folder of tables."""
    return Stored(spark, stores.once(spark, sf_dir, "documents", lambda path: store(Documents(Shop(spark, sf_dir)), path)))


def _summed(array, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x[field])


def _since(since: str) -> Column:
    return F.col("ordered_at") >= F.to_timestamp_ntz(F.lit(since))


def _done() -> Column:
    return F.col("status").isin(*DONE)


def _known(items) -> Column:
    """Items whose product is known, as an inner join would keep them."""
    return F.filter(items, lambda x: x["product"]["product_id"].isNotNull())


def _listed(array, shown: int | None = None) -> Column:
    """Numbers joined by commas; null where there are none."""
    some = F.slice(array, 1, shown) if shown else F.col(array)
    return F.when(F.size(array) > 0, F.array_join(F.transform(some, lambda x: x.cast("string")), ","))


def order_history(d: Documents, person=PERSON):
    mine = d.get("purchase", "customer").filter(F.col("customer.person_id") == person)
    return mine.select("order_id", "ordered_at", "status", "total_cents", "currency").orderBy(F.desc("ordered_at"), "order_id")


def order_details(d: Documents, person=PERSON):
    mine = d.get("purchase", "customer", "items").filter(F.col("customer.person_id") == person).withColumn("items", _known("items"))
    x = F.col("items")
    return unwind(mine, "items").select(
        "order_id", "ordered_at", "status", x["line"].alias("line"), x["product_id"].alias("product_id"), x["product"]["title"].alias("title"),
        x["unit_price_cents"].alias("unit_price_cents"), x["quantity"].alias("quantity"), x["line_total_cents"].alias("line_total_cents"),
    )


def purchase_count(d: Documents, persons=PERSONS, products=PRODUCTS):
    mine = d.get("purchase", "customer", "items").filter(_done() & F.col("customer.person_id").isin(*persons))
    own = F.size(F.filter("items", lambda x: x["product_id"].isin(*products)))
    return mine.agg(F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("n"))


def seller_daily_revenue(d: Documents, since=SINCE, sellers=SELLERS):
    own = F.filter("items", lambda x: x["product"]["seller_id"].isin(*sellers))
    rows = d.get("purchase", "items").filter(_done() & _since(since)).withColumn("own", own).filter(F.size("own") > 0)
    return rows.groupBy(F.to_date("ordered_at").alias("day")).agg(F.sum(_summed("own", "line_total_cents")).alias("revenue_cents"), N("*").alias("orders"))


def top_products(d: Documents, since=SINCE, categories=CATEGORIES, limit=PAGE):
    """A product counts once for each chosen category that it is in."""
    times = F.size(F.filter("categories", lambda c: c["category_id"].isin(*categories)))
    chosen = d.get("product", "categories").select("product_id", "title", times.alias("times")).filter("times > 0")
    items = unwind(d.get("purchase", "items").filter(_done() & _since(since)), "items").select("items.product_id", "items.line_total_cents", "items.quantity")
    sums = items.groupBy("product_id").agg(_total("line_total_cents", "r"), _total("quantity", "u")).join(chosen, "product_id")
    return sums.select("product_id", "title", (F.col("r") * F.col("times")).alias("revenue_cents"), (F.col("u") * F.col("times")).alias("units")).orderBy(F.desc("revenue_cents"), "product_id").limit(limit)


def spend_buckets(d: Documents, since=SINCE, low=20_000_000, high=60_000_000):
    recent = d.get("purchase", "customer").filter(_done() & _since(since) & F.col("customer").isNotNull())
    spend = recent.groupBy(F.col("customer.person_id").alias("person_id")).agg(_total("total_cents", "spend"))
    band = F.when(F.col("spend") < low, "low").when(F.col("spend") < high, "mid").otherwise("high")
    return spend.groupBy(band.alias("bucket")).agg(N("*").alias("persons"))


def many_sellers(d: Documents, since=SINCE, least=3, limit=PAGE):
    sellers = F.array_distinct(F.transform(_known("items"), lambda x: x["product"]["seller_id"]))
    rows = d.get("purchase", "customer", "items").filter(_done() & _since(since) & F.col("customer").isNotNull())
    each = rows.select(F.col("customer.person_id").alias("person_id"), "order_id", F.explode(sellers).alias("seller_id"))
    sums = each.groupBy("person_id").agg(F.countDistinct("seller_id").alias("distinct_sellers"), F.countDistinct("order_id").alias("orders"))
    return sums.filter(F.col("distinct_sellers") >= least).orderBy(F.desc("distinct_sellers"), "person_id").limit(limit)


def who_to_follow(d: Documents, person=PERSON, limit=PAGE):
    """The anti join is a predicate on a person's own list."""
    follows = F.exists("follows", lambda x: x["to_id"] == person)
    people = d.get("person", "follows")
    near = people.filter(follows).select(F.col("person_id").alias("via"))
    far = unwind(people.filter(~follows & (F.col("person_id") != person)), "follows").select("person_id", F.col("follows.to_id").alias("via"))
    return far.join(near, "via").groupBy("person_id").agg(N("*").alias("paths")).orderBy(F.desc("paths"), "person_id").limit(limit)


def feed(d: Documents, persons=PERSONS, limit=PAGE):
    mine = unwind(d.get("person", "interests").filter(F.col("person_id").isin(*persons)), "interests")
    per_category = mine.groupBy(F.col("interests.category_id").alias("category_id")).agg(F.sum("interests.strength").alias("w"))
    live = unwind(d.get("product", "categories").filter("is_active"), "categories").select("product_id", F.col("categories.category_id").alias("category_id"))
    return live.join(per_category, "category_id").groupBy("product_id").agg(_total("w", "interest_score")).orderBy(F.desc("interest_score"), "product_id").limit(limit)


def product_page(d: Documents, products=PRODUCTS, shown=SHOWN):
    mine = d.get("product", "categories", "reviews").filter(F.col("product_id").isin(*products))
    best = F.transform(F.array_sort(F.transform("reviews", lambda x: F.struct((-x["helpful_votes"]).alias("v"), x["review_id"].alias("id")))), lambda x: x["id"])
    page = mine.select("product_id", "title", "price_cents", best.alias("reviews"), F.col("categories.category_id").alias("categories"))
    return page.select("product_id", "title", "price_cents", _listed("reviews", shown).alias("reviews"), _listed("categories").alias("categories"))


def also_bought(d: Documents, products=PRODUCTS, limit=TOP):
    seeds = F.size(F.filter("items", lambda x: x["product_id"].isin(*products)))
    rows = d.get("purchase", "items").filter(_done()).withColumn("k", seeds).filter("k > 0")
    others = rows.select("k", F.explode(F.filter("items", lambda x: ~x["product_id"].isin(*products))).alias("x"))
    return others.groupBy(F.col("x.product_id").alias("product_id")).agg(F.sum("k").alias("co_buy")).orderBy(F.desc("co_buy"), "product_id").limit(limit)


def buyer_activity(d: Documents, countries=COUNTRIES):
    rows = d.get("purchase", "customer").select("customer.*").filter(F.col("country_code").isin(*countries))
    return rows.groupBy("country_code", "is_active").agg(N("*").alias("customers"), F.countDistinct("person_id").alias("persons"))


def quantity_distribution(d: Documents, least=10_000):
    rows = d.get("purchase", "items").select(F.inline(F.filter("items", lambda x: x["unit_price_cents"] >= least)))
    return rows.groupBy("quantity").agg(N("*").alias("items"), _total("quantity", "units"), _total("line_total_cents", "revenue_cents"), _mean("unit_price_cents", "avg_unit_price_cents"))


def seller_sales(d: Documents, since=SINCE, sellers=SELLERS, limit=PAGE):
    own = F.filter("items", lambda x: x["product"]["seller_id"].isin(*sellers))
    rows = d.get("purchase", "items").filter(_done() & _since(since)).select("order_id", F.explode(own).alias("x"))
    sums = rows.groupBy(F.col("x.product.seller_id").alias("seller_id")).agg(F.countDistinct("order_id").alias("orders"), N("*").alias("items"), _total("x.quantity", "units"), _total("x.line_total_cents", "revenue_cents"))
    return sums.orderBy(F.desc("revenue_cents"), "seller_id").limit(limit)


def country_status(d: Documents, since=SINCE, countries=COUNTRIES):
    rows = d.get("purchase", "customer").filter(_since(since) & F.col("customer.country_code").isin(*countries))
    return rows.groupBy(F.col("customer.country_code").alias("country_code"), "status").agg(N("*").alias("orders"), _total("total_cents", "revenue_cents"), _mean("total_cents", "avg_order_cents"))


def review_summary(d: Documents, products=PRODUCTS, votes=5, limit=PAGE):
    """Each product's summary is made inside its document."""
    own = F.filter("reviews", lambda x: x["helpful_votes"] >= votes)
    rows = d.get("product", "reviews").filter(F.col("product_id").isin(*products)).select("product_id", own.alias("own")).filter(F.size("own") > 0)
    n = F.size("own").cast("long")
    return rows.select(
        "product_id", n.alias("reviews"), F.round(_summed("own", "rating") / n, 4).alias("avg_rating"), _summed("own", "helpful_votes").alias("helpful_votes"),
        F.array_max(F.transform("own", lambda x: x["helpful_votes"])).alias("max_helpful_votes"),
    ).orderBy(F.desc("reviews"), "product_id").limit(limit)


def interest_summary(d: Documents, categories=CATEGORIES, least=2, limit=PAGE):
    strong = F.filter("interests", lambda x: x["category_id"].isin(*categories) & (x["strength"] >= least))
    rows = d.get("person", "interests").filter("is_active").select("person_id", F.inline(strong))
    sums = rows.groupBy("category_id").agg(F.countDistinct("person_id").alias("interested_persons"), _mean("strength", "avg_strength"), F.max("strength").alias("max_strength"))
    return sums.orderBy(F.desc("interested_persons"), "category_id").limit(limit)


def catalog_summary(d: Documents, categories=CATEGORIES, most=99_000, least=5, limit=PAGE):
    live = d.get("product", "categories").filter(F.col("is_active") & (F.col("price_cents") <= most) & (F.col("stock_qty") >= least))
    rows = live.select("product_id", "stock_qty", "price_cents", F.inline(F.filter("categories", lambda c: c["category_id"].isin(*categories)))).groupBy("category_id")
    return rows.agg(F.countDistinct("product_id").alias("products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents")).orderBy(F.desc("products"), "category_id").limit(limit)


def follow_countries(d: Documents, countries=COUNTRIES, limit=PAGE):
    people = d.get("person", "follows")
    start = unwind(people.filter(F.col("country_code").isin(*countries)), "follows").select(F.col("country_code").alias("from_country"), F.col("follows.to_id").alias("to_id"))
    end = d.get("person").select(F.col("person_id").alias("to_id"), F.col("country_code").alias("to_country"), "is_active")
    sums = start.join(end, "to_id").groupBy("from_country", "to_country").agg(N("*").alias("edges"), F.count_if("is_active").alias("active_targets"))
    return sums.orderBy(F.desc("edges"), "from_country", "to_country").limit(limit)


class _Flat:
    """Top-level fields of the collections, for queries that read no embedded part."""

    def __init__(self, documents: Documents):
        self.documents = documents

    def __getattr__(self, name: str) -> DataFrame:
        return self.documents.get(name)


def query(f):
    """The document form of a relational query: its own, or the relational text over top-level fields."""
    own = globals().get(f.__name__)
    return own if own is not None else lambda d, **k: f(_Flat(d), **k)


def queries() -> dict:
    return {f"{M._name(k, f)}_doc": (lambda spark, sf_dir, q=query(f): q(kept(spark, sf_dir))) for k, f in enumerate(M.WORKLOAD)}


def oracle_sql() -> dict[str, str]:
    return {f"{k}_doc": v for k, v in M.oracle_sql().items()}
