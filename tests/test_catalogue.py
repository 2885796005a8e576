"""Each catalogue query against its oracle SQL on the smallest tables."""

import re

import duckdb
import pytest

from tessella.plans import catalogue, evaluation, families, inspection, layouts, marketplace, marketplace_documents, marketplace_graph
from tessella.sources import stores

DIR = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql() | layouts.ORACLE | marketplace.oracle_sql() | marketplace_documents.oracle_sql() | marketplace_graph.oracle_sql() | evaluation.ORACLE | inspection.ORACLE | families.oracle_sql()
QUERIES = catalogue.queries() | layouts.QUERIES | marketplace.queries() | marketplace_documents.queries() | marketplace_graph.queries() | evaluation.QUERIES | inspection.QUERIES | families.queries()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 3) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = oracle.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_sample_is_exact_and_repeatable(spark):
    a = {r[0] for r in layouts.s5_sample(spark, DIR).collect()}
    assert len(a) == 50 and a == {r[0] for r in layouts.s5_sample(spark, DIR).collect()}


def test_stores_answer_as_the_layouts_they_hold(spark, tmp_path):
    shop, path = marketplace.Shop(spark, DIR), f"file://{tmp_path}"
    made, graph = marketplace_documents.Documents(shop), marketplace_graph.Graph(shop)
    for name, fill in (("relations", shop.store), ("documents", lambda p: marketplace_documents.store(made, p)), ("graph", lambda p: marketplace_graph.store(graph, p))):
        fill(stores.create(spark, f"{path}/{name}"))
        with pytest.raises(FileExistsError):
            stores.create(spark, f"{path}/{name}")
    kept = marketplace_documents.Stored(spark, f"{path}/documents")
    for f in (marketplace_documents.many_sellers, marketplace_documents.product_page, marketplace_documents.feed):
        assert sorted(f(kept).collect()) == sorted(f(made).collect())
    for f in (marketplace_graph.who_to_follow, marketplace_graph.also_bought):
        assert sorted(f(marketplace_graph.Stored(spark, f"{path}/graph")).collect()) == sorted(f(graph).collect())
    assert sorted(marketplace.many_sellers(marketplace.StoredShop(spark, f"{path}/relations")).collect()) == sorted(marketplace.many_sellers(shop).collect())


def test_reset_deletes_stores_only(spark, tmp_path):
    path = stores.create(spark, f"file://{tmp_path}/one")
    stores.load(spark.range(10), path, "t", "id")
    assert stores.exists(spark, path) and stores.table(spark, path, "t").count() == 10
    assert stores.reset(spark, path) and not stores.exists(spark, path) and not stores.reset(spark, path)
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        stores.reset(spark, f"file://{tmp_path}/other")
    assert (tmp_path / "other").exists()


def joins_over_tables(plan: str) -> list[str]:
    """Nested-loop joins and cartesian products of a plan."""
    return re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)


@pytest.mark.parametrize("name", ["j8_as_of", "a17_bucket_auto", "a17_bucket_auto_price", "g4_shortest_path", "q3_materialized", "j8_band_join", "d2_insert_select"])
def test_plans_have_no_nested_loops_but_on_one_row(spark, name):
    df = QUERIES[name](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    one_row = plan.count("BroadcastNestedLoopJoin BuildRight, Cross")
    assert len(joins_over_tables(plan)) <= one_row


def test_quantified_comparison_reads_one_row_of_the_subquery(spark):
    plan = QUERIES["f9_quantified"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Exists" not in plan and "LeftAnti" not in plan and "Aggregate [max(" in plan


def test_families_are_generated_with_their_parameters():
    own = families.shown()
    assert len(own) == families.SHOWN * len({x.template.name for x in own}) and len({x.content for x in own}) > 0.9 * len(own)
    assert all("{{" in families.REGISTRY.raw(x.template.name) for x in own)
    assert [x.content for x in own] == [x.content for x in families.shown()]
    assert len(families.REGISTRY.templates) == len(own) // families.SHOWN + len(marketplace.WORKLOAD)


def test_marketplace_instances_agree_in_all_layouts(spark):
    shop = marketplace.Shop(spark, DIR)
    docs, graph = marketplace_documents.kept(spark, DIR), marketplace_graph.kept(spark, DIR)
    some = [x for x in families.market() if x.content[1]]
    assert len(some) > 20
    for x in some[::3]:
        name, values = x.content
        f = getattr(marketplace, name)
        want = sorted(map(repr, (tuple(map(plain, r)) for r in f(shop, **values).collect())))
        for forms, layout in ((marketplace_documents, docs), (marketplace_graph, graph)):
            df = forms.query(f)(layout, **values)
            assert sorted(map(repr, (tuple(map(plain, r)) for r in df.select(*f(shop, **values).columns).collect()))) == want, (x.id, forms.__name__)
