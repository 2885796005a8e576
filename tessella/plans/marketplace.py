"""The marketplace workload: 24 queries over persons, buyers, sellers, products, purchases, items, reviews,
categories, interests and follows.

The relations are views over the driver's tables (``VIEWS``, one text for Spark and the oracle). Each query is a
DataFrame expression with parameters; ``ORACLE`` holds SQL at the default parameters. Sums are of integers (cents),
so no result depends on the order of addition; every limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.sources import stores

from .catalogue import run_sql

VIEWS = {
    "person": "SELECT c_custkey AS person_id, c_name AS name, 'C' || c_nationkey AS country_code, c_acctbal >= 0 AS is_active FROM customer",
    "buyer": "SELECT o_orderkey AS customer_id, o_custkey AS person_id, 'C' || c_nationkey AS country_code, c_acctbal >= 0 AS is_active FROM orders JOIN customer ON c_custkey = o_custkey",
    "seller": "SELECT s_suppkey AS seller_id, s_name AS name, 'C' || s_nationkey AS country_code, s_acctbal >= 0 AS is_active FROM supplier",
    "product": "SELECT p_partkey AS product_id, p_partkey % 97 AS seller_id, p_name AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(p_size AS BIGINT) AS stock_qty, p_size % 7 <> 0 AS is_active FROM part",
    "purchase": "SELECT o_orderkey AS order_id, o_orderkey AS customer_id, o_orderdate AS ordered_at, CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'paid' ELSE 'canceled' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, CASE WHEN o_orderpriority LIKE '1%' THEN 'EUR' ELSE 'USD' END AS currency FROM orders",
    "item": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product_id, CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_price_cents, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS line_total_cents FROM lineitem",
    "review": "SELECT event_id AS review_id, event_id * 7 % 200 + 1 AS product_id, user_id AS person_id, CAST(floor(value) AS BIGINT) % 5 + 1 AS rating, event_id % 40 AS helpful_votes FROM events",
    "has_category": "SELECT p_partkey AS product_id, CAST(p_size % 20 AS BIGINT) AS category_id FROM part UNION SELECT p_partkey AS product_id, p_partkey % 20 AS category_id FROM part",
    "has_interest": "SELECT user_id AS person_id, event_id % 20 AS category_id, least(count(*), 10) AS strength FROM events GROUP BY user_id, event_id % 20",
    "follows": "SELECT DISTINCT o_custkey AS from_id, o_orderkey * 7 % 150 AS to_id FROM orders WHERE o_custkey <> o_orderkey * 7 % 150",
}

PERSON, SINCE = 7, "1998-01-01"
PERSONS, PRODUCTS, SELLERS, CATEGORIES = tuple(range(1, 61)), tuple(range(1, 41)), tuple(range(30)), tuple(range(8))
COUNTRIES = ("C1", "C2", "C3", "C5", "C8", "C13", "C21")
DONE = ("paid", "shipped")
PAGE, TOP, SHOWN = 200, 20, 50


class Shop:
    """Lazy relations of one folder of tables."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return run_sql(self.spark, self.sf_dir, VIEWS[name])

    def store(self, path: str) -> None:
        """Bulk load of every relation into a store."""
        for name in VIEWS:
            stores.load(getattr(self, name), path, name)

    def done(self) -> DataFrame:
        return self.purchase.filter(F.col("status").isin(*DONE))

    def sold(self, since: str) -> DataFrame:
        """Items of completed purchases since a day, with their product's seller."""
        recent = self.done().filter(F.col("ordered_at") >= F.to_timestamp_ntz(F.lit(since)))
        return recent.join(self.item, "order_id").join(self.product.select("product_id", "seller_id", "title"), "product_id")


class StoredShop(Shop):
    """The relations as ``store`` wrote them."""

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return stores.table(self.spark, self.sf_dir, name)


def _total(name: str, alias: str):
    return F.sum(name).alias(alias)


def _mean(name: str, alias: str):
    return F.round(F.avg(name), 4).alias(alias)


N = F.count


def order_history(s: Shop, person=PERSON):
    return s.purchase.join(s.buyer.filter(F.col("person_id") == person), "customer_id").select("order_id", "ordered_at", "status", "total_cents", "currency").orderBy(F.desc("ordered_at"), "order_id")


def order_details(s: Shop, person=PERSON):
    mine = s.purchase.join(s.buyer.filter(F.col("person_id") == person), "customer_id").select("order_id", "ordered_at", "status")
    return mine.join(s.item, "order_id").join(s.product.select("product_id", "title"), "product_id").select("order_id", "ordered_at", "status", "line", "product_id", "title", "unit_price_cents", "quantity", "line_total_cents")


def purchase_count(s: Shop, persons=PERSONS, products=PRODUCTS):
    own = s.buyer.filter(F.col("person_id").isin(*persons)).select("customer_id")
    return s.done().join(own, "customer_id").join(s.item.filter(F.col("product_id").isin(*products)), "order_id").agg(N("*").alias("n"))


def seller_daily_revenue(s: Shop, since=SINCE, sellers=SELLERS):
    rows = s.sold(since).filter(F.col("seller_id").isin(*sellers))
    return rows.groupBy(F.to_date("ordered_at").alias("day")).agg(_total("line_total_cents", "revenue_cents"), F.countDistinct("order_id").alias("orders"))


def top_products(s: Shop, since=SINCE, categories=CATEGORIES, limit=PAGE):
    chosen = s.has_category.filter(F.col("category_id").isin(*categories)).select("product_id")
    sums = s.sold(since).join(chosen, "product_id").groupBy("product_id", "title").agg(_total("line_total_cents", "revenue_cents"), _total("quantity", "units"))
    return sums.orderBy(F.desc("revenue_cents"), "product_id").limit(limit)


def spend_buckets(s: Shop, since=SINCE, low=20_000_000, high=60_000_000):
    recent = s.done().filter(F.col("ordered_at") >= F.to_timestamp_ntz(F.lit(since)))
    spend = recent.join(s.buyer.select("customer_id", "person_id"), "customer_id").groupBy("person_id").agg(_total("total_cents", "spend"))
    band = F.when(F.col("spend") < low, "low").when(F.col("spend") < high, "mid").otherwise("high")
    return spend.groupBy(band.alias("bucket")).agg(N("*").alias("persons"))


def many_sellers(s: Shop, since=SINCE, least=3, limit=PAGE):
    rows = s.sold(since).join(s.buyer.select("customer_id", "person_id"), "customer_id")
    sums = rows.groupBy("person_id").agg(F.countDistinct("seller_id").alias("distinct_sellers"), F.countDistinct("order_id").alias("orders"))
    return sums.filter(F.col("distinct_sellers") >= least).orderBy(F.desc("distinct_sellers"), "person_id").limit(limit)


def who_to_follow(s: Shop, person=PERSON, limit=PAGE):
    near = s.follows.filter(F.col("to_id") == person).select(F.col("from_id").alias("via"))
    far = s.follows.join(near, F.col("to_id") == F.col("via")).filter(F.col("from_id") != person).select(F.col("from_id").alias("person_id"))
    return far.join(near, far["person_id"] == near["via"], "left_anti").groupBy("person_id").agg(N("*").alias("paths")).orderBy(F.desc("paths"), "person_id").limit(limit)


def feed(s: Shop, persons=PERSONS, limit=PAGE):
    per_category = s.has_interest.filter(F.col("person_id").isin(*persons)).groupBy("category_id").agg(_total("strength", "w"))
    live = s.has_category.join(s.product.filter("is_active").select("product_id"), "product_id")
    return live.join(per_category, "category_id").groupBy("product_id").agg(_total("w", "interest_score")).orderBy(F.desc("interest_score"), "product_id").limit(limit)


def product_page(s: Shop, products=PRODUCTS, shown=SHOWN):
    """A product with its categories and the ids of its most helpful reviews, best first."""
    mine = F.col("product_id").isin(*products)
    order = W.partitionBy("product_id").orderBy(F.desc("helpful_votes"), "review_id")
    best = s.review.filter(mine).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= shown)
    reviews = best.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "review_id"))), lambda x: x["review_id"].cast("string")), ",").alias("reviews"))
    categories = s.has_category.filter(mine).groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("category_id")), lambda x: x.cast("string")), ",").alias("categories"))
    return s.product.filter(mine).select("product_id", "title", "price_cents").join(reviews, "product_id", "left").join(categories, "product_id", "left")


def also_bought(s: Shop, products=PRODUCTS, limit=TOP):
    """Items of one order meet as (chosen items) x (other items) by count per order, not as pairs of rows."""
    chosen = F.col("product_id").isin(*products)
    items = s.item.select("order_id", "product_id")
    seeds = items.filter(chosen).groupBy("order_id").agg(N("*").alias("k")).join(s.done().select("order_id"), "order_id")
    return items.filter(~chosen).join(seeds, "order_id").groupBy("product_id").agg(_total("k", "co_buy")).orderBy(F.desc("co_buy"), "product_id").limit(limit)


def revenue_by_status(s: Shop, statuses=DONE):
    return s.purchase.filter(F.col("status").isin(*statuses)).groupBy("status", "currency").agg(N("*").alias("orders"), _total("total_cents", "revenue_cents"), _mean("total_cents", "avg_order_cents"))


def inventory_by_price(s: Shop, most=99_000, least=5):
    p = F.col("price_cents")
    band = F.when(p < 91_000, 0).when(p < 94_000, 1).when(p < 97_000, 2).otherwise(3)
    live = s.product.filter(F.col("is_active") & (p <= most) & (F.col("stock_qty") >= least))
    return live.groupBy(band.alias("price_band"), "currency").agg(N("*").alias("products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents"))


def rating_distribution(s: Shop, votes=5):
    return s.review.filter(F.col("helpful_votes") >= votes).groupBy("rating").agg(N("*").alias("reviews"), _mean("helpful_votes", "avg_helpful_votes"))


def buyer_activity(s: Shop, countries=COUNTRIES):
    return s.buyer.filter(F.col("country_code").isin(*countries)).groupBy("country_code", "is_active").agg(N("*").alias("customers"), F.countDistinct("person_id").alias("persons"))


def seller_activity(s: Shop, countries=COUNTRIES):
    return s.seller.filter(F.col("country_code").isin(*countries)).groupBy("country_code", "is_active").agg(N("*").alias("sellers"))


def quantity_distribution(s: Shop, least=10_000):
    return s.item.filter(F.col("unit_price_cents") >= least).groupBy("quantity").agg(N("*").alias("items"), _total("quantity", "units"), _total("line_total_cents", "revenue_cents"), _mean("unit_price_cents", "avg_unit_price_cents"))


def seller_sales(s: Shop, since=SINCE, sellers=SELLERS, limit=PAGE):
    rows = s.sold(since).filter(F.col("seller_id").isin(*sellers)).groupBy("seller_id")
    sums = rows.agg(F.countDistinct("order_id").alias("orders"), N("*").alias("items"), _total("quantity", "units"), _total("line_total_cents", "revenue_cents"))
    return sums.orderBy(F.desc("revenue_cents"), "seller_id").limit(limit)


def country_status(s: Shop, since=SINCE, countries=COUNTRIES):
    recent = s.purchase.filter(F.col("ordered_at") >= F.to_timestamp_ntz(F.lit(since)))
    there = s.buyer.filter(F.col("country_code").isin(*countries)).select("customer_id", "country_code")
    return recent.join(there, "customer_id").groupBy("country_code", "status").agg(N("*").alias("orders"), _total("total_cents", "revenue_cents"), _mean("total_cents", "avg_order_cents"))


def review_summary(s: Shop, products=PRODUCTS, votes=5, limit=PAGE):
    rows = s.review.filter(F.col("product_id").isin(*products) & (F.col("helpful_votes") >= votes)).groupBy("product_id")
    sums = rows.agg(N("*").alias("reviews"), _mean("rating", "avg_rating"), _total("helpful_votes", "helpful_votes"), F.max("helpful_votes").alias("max_helpful_votes"))
    return sums.orderBy(F.desc("reviews"), "product_id").limit(limit)


def interest_summary(s: Shop, categories=CATEGORIES, least=2, limit=PAGE):
    strong = s.has_interest.filter(F.col("category_id").isin(*categories) & (F.col("strength") >= least))
    rows = strong.join(s.person.filter("is_active").select("person_id"), "person_id").groupBy("category_id")
    sums = rows.agg(F.countDistinct("person_id").alias("interested_persons"), _mean("strength", "avg_strength"), F.max("strength").alias("max_strength"))
    return sums.orderBy(F.desc("interested_persons"), "category_id").limit(limit)


def catalog_summary(s: Shop, categories=CATEGORIES, most=99_000, least=5, limit=PAGE):
    live = s.product.filter(F.col("is_active") & (F.col("price_cents") <= most) & (F.col("stock_qty") >= least)).select("product_id", "stock_qty", "price_cents")
    rows = s.has_category.filter(F.col("category_id").isin(*categories)).join(live, "product_id").groupBy("category_id")
    return rows.agg(F.countDistinct("product_id").alias("products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents")).orderBy(F.desc("products"), "category_id").limit(limit)


def catalog_health(s: Shop, sellers=SELLERS, limit=PAGE):
    rows = s.product.filter(F.col("seller_id").isin(*sellers)).groupBy("seller_id")
    sums = rows.agg(N("*").alias("products"), F.count_if("is_active").alias("active_products"), F.count_if(~F.col("is_active")).alias("inactive_products"), _total("stock_qty", "stock_qty"), _mean("price_cents", "avg_price_cents"))
    return sums.orderBy(F.desc("products"), "seller_id").limit(limit)


def follow_countries(s: Shop, countries=COUNTRIES, limit=PAGE):
    start = s.person.filter(F.col("country_code").isin(*countries)).select(F.col("person_id").alias("from_id"), F.col("country_code").alias("from_country"))
    end = s.person.select(F.col("person_id").alias("to_id"), F.col("country_code").alias("to_country"), "is_active")
    sums = s.follows.join(start, "from_id").join(end, "to_id").groupBy("from_country", "to_country").agg(N("*").alias("edges"), F.count_if("is_active").alias("active_targets"))
    return sums.orderBy(F.desc("edges"), "from_country", "to_country").limit(limit)


WORKLOAD = (
    order_history, order_details, purchase_count, seller_daily_revenue, top_products, spend_buckets, many_sellers, who_to_follow, feed, product_page, also_bought, revenue_by_status,
    inventory_by_price, rating_distribution, buyer_activity, seller_activity, quantity_distribution, seller_sales, country_status, review_summary, interest_summary, catalog_summary, catalog_health, follow_countries,
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


_SOLD = f"purchase JOIN item USING (order_id) JOIN product USING (product_id) WHERE ordered_at >= TIMESTAMP '{SINCE}' AND status IN {_in(DONE)}"
_BIG = "CAST(sum({0}) AS BIGINT) AS {1}".format
_AVG = "round(avg({0}), 4) AS {1}".format

_SQL = {
    "order_history": f"SELECT order_id, ordered_at, status, total_cents, currency FROM purchase WHERE customer_id IN (SELECT customer_id FROM buyer WHERE person_id = {PERSON})",
    "order_details": f"SELECT order_id, ordered_at, status, line, product_id, title, unit_price_cents, quantity, line_total_cents FROM purchase JOIN item USING (order_id) JOIN product USING (product_id) WHERE customer_id IN (SELECT customer_id FROM buyer WHERE person_id = {PERSON})",
    "purchase_count": f"SELECT count(*) AS n FROM purchase JOIN item USING (order_id) JOIN buyer USING (customer_id) WHERE person_id IN {_in(PERSONS)} AND product_id IN {_in(PRODUCTS)} AND status IN {_in(DONE)}",
    "seller_daily_revenue": f"SELECT CAST(ordered_at AS DATE) AS day, {_BIG('line_total_cents', 'revenue_cents')}, count(DISTINCT order_id) AS orders FROM {_SOLD} AND seller_id IN {_in(SELLERS)} GROUP BY 1",
    "top_products": f"SELECT product_id, title, {_BIG('line_total_cents', 'revenue_cents')}, {_BIG('quantity', 'units')} FROM has_category JOIN (SELECT * FROM {_SOLD}) USING (product_id) WHERE category_id IN {_in(CATEGORIES)} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT {PAGE}",
    "spend_buckets": f"SELECT CASE WHEN t >= 60000000 THEN 'high' WHEN t >= 20000000 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS persons FROM (SELECT person_id, sum(total_cents) AS t FROM purchase JOIN buyer USING (customer_id) WHERE ordered_at >= TIMESTAMP '{SINCE}' AND status IN {_in(DONE)} GROUP BY 1) GROUP BY 1",
    "many_sellers": f"SELECT * FROM (SELECT person_id, count(DISTINCT seller_id) AS distinct_sellers, count(DISTINCT order_id) AS orders FROM (SELECT * FROM {_SOLD}) JOIN buyer USING (customer_id) GROUP BY 1) WHERE distinct_sellers >= 3 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "who_to_follow": f"WITH near AS (SELECT from_id FROM follows WHERE to_id = {PERSON}) SELECT from_id AS person_id, count(*) AS paths FROM follows WHERE to_id IN (SELECT from_id FROM near) AND from_id <> {PERSON} AND from_id NOT IN (SELECT from_id FROM near) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "feed": f"SELECT product_id, {_BIG('strength', 'interest_score')} FROM has_interest JOIN has_category USING (category_id) JOIN product USING (product_id) WHERE person_id IN {_in(PERSONS)} AND is_active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "product_page": f"""SELECT product_id, title, price_cents, r.reviews, c.categories FROM product LEFT JOIN (SELECT product_id, string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY k) AS reviews
        FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY helpful_votes DESC, review_id) AS k FROM review) WHERE k <= {SHOWN} GROUP BY 1) r USING (product_id)
        LEFT JOIN (SELECT product_id, string_agg(CAST(category_id AS VARCHAR), ',' ORDER BY category_id) AS categories FROM has_category GROUP BY 1) c USING (product_id) WHERE product_id IN {_in(PRODUCTS)}""",
    "also_bought": f"SELECT b.product_id, count(*) AS co_buy FROM item a JOIN item b USING (order_id) JOIN purchase USING (order_id) WHERE a.product_id IN {_in(PRODUCTS)} AND b.product_id NOT IN {_in(PRODUCTS)} AND status IN {_in(DONE)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}",
    "revenue_by_status": f"SELECT status, currency, count(*) AS orders, {_BIG('total_cents', 'revenue_cents')}, {_AVG('total_cents', 'avg_order_cents')} FROM purchase WHERE status IN {_in(DONE)} GROUP BY 1, 2",
    "inventory_by_price": f"SELECT CAST(CASE WHEN price_cents >= 97000 THEN 3 WHEN price_cents >= 94000 THEN 2 WHEN price_cents >= 91000 THEN 1 ELSE 0 END AS INT) AS price_band, currency, count(*) AS products, {_BIG('stock_qty', 'stock_qty')}, {_AVG('price_cents', 'avg_price_cents')} FROM product WHERE is_active AND price_cents <= 99000 AND stock_qty >= 5 GROUP BY 1, 2",
    "rating_distribution": f"SELECT rating, count(*) AS reviews, {_AVG('helpful_votes', 'avg_helpful_votes')} FROM review WHERE helpful_votes >= 5 GROUP BY 1",
    "buyer_activity": f"SELECT country_code, is_active, count(*) AS customers, count(DISTINCT person_id) AS persons FROM buyer WHERE country_code IN {_in(COUNTRIES)} GROUP BY 1, 2",
    "seller_activity": f"SELECT country_code, is_active, count(*) AS sellers FROM seller WHERE country_code IN {_in(COUNTRIES)} GROUP BY 1, 2",
    "quantity_distribution": f"SELECT quantity, count(*) AS items, {_BIG('quantity', 'units')}, {_BIG('line_total_cents', 'revenue_cents')}, {_AVG('unit_price_cents', 'avg_unit_price_cents')} FROM item WHERE unit_price_cents >= 10000 GROUP BY 1",
    "seller_sales": f"SELECT seller_id, count(DISTINCT order_id) AS orders, count(*) AS items, {_BIG('quantity', 'units')}, {_BIG('line_total_cents', 'revenue_cents')} FROM {_SOLD} AND seller_id IN {_in(SELLERS)} GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT {PAGE}",
    "country_status": f"SELECT country_code, status, count(*) AS orders, {_BIG('total_cents', 'revenue_cents')}, {_AVG('total_cents', 'avg_order_cents')} FROM purchase JOIN buyer USING (customer_id) WHERE country_code IN {_in(COUNTRIES)} AND ordered_at >= TIMESTAMP '{SINCE}' GROUP BY 1, 2",
    "review_summary": f"SELECT product_id, count(*) AS reviews, {_AVG('rating', 'avg_rating')}, {_BIG('helpful_votes', 'helpful_votes')}, max(helpful_votes) AS max_helpful_votes FROM review r WHERE product_id IN {_in(PRODUCTS)} AND r.helpful_votes >= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "interest_summary": f"SELECT category_id, count(DISTINCT person_id) AS interested_persons, {_AVG('strength', 'avg_strength')}, max(strength) AS max_strength FROM has_interest JOIN person USING (person_id) WHERE is_active AND strength >= 2 AND category_id IN {_in(CATEGORIES)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "catalog_summary": f"SELECT category_id, count(DISTINCT product_id) AS products, CAST(sum(p.stock_qty) AS BIGINT) AS stock_qty, {_AVG('price_cents', 'avg_price_cents')} FROM has_category JOIN product p USING (product_id) WHERE is_active AND price_cents <= 99000 AND p.stock_qty >= 5 AND category_id IN {_in(CATEGORIES)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "catalog_health": f"SELECT seller_id, count(*) AS products, count(*) FILTER (is_active) AS active_products, count(*) FILTER (NOT is_active) AS inactive_products, {_BIG('p.stock_qty', 'stock_qty')}, {_AVG('price_cents', 'avg_price_cents')} FROM product p WHERE seller_id IN {_in(SELLERS)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}",
    "follow_countries": f"SELECT a.country_code AS from_country, b.country_code AS to_country, count(*) AS edges, count(*) FILTER (b.is_active) AS active_targets FROM follows JOIN person a ON a.person_id = from_id JOIN person b ON b.person_id = to_id WHERE a.country_code IN {_in(COUNTRIES)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT {PAGE}",
}

_WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items())


def _name(k: int, f) -> str:
    return f"m{k}_{f.__name__}"


def queries() -> dict:
    return {_name(k, f): (lambda spark, sf_dir, f=f: f(Shop(spark, sf_dir))) for k, f in enumerate(WORKLOAD)}


def oracle_sql() -> dict[str, str]:
    return {_name(k, f): _WITH + (", " + t.removeprefix("WITH ") if (t := _SQL[f.__name__]).startswith("WITH ") else " " + t) for k, f in enumerate(WORKLOAD)}
