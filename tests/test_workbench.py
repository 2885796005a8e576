"""Files, templates, plans, models and placement against small fixtures and brute force."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.plans import evaluation, inspection, models, placement, templates
from tessella.sources import files


def test_csv_round_trip_and_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, s string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == [(1, "a,b"), (2, None)]
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "c"), spark.createDataFrame([], "s int, k string").schema).collect()


def test_extended_json(spark, tmp_path):
    rows = [{"a": {"$numberLong": "5"}, "b": {"t": {"$date": "2024-01-02T03:04:05.000Z"}}, "c": [{"$oid": "x"}]}, {"a": {"$numberLong": "6"}, "b": None, "c": []}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), True).orderBy("a").collect()
    assert (got[0].a, got[0].b.t, got[0].c, got[1].b, got[1].c) == (5, datetime(2024, 1, 2, 3, 4, 5), ["x"], None, [])
    t = spark.createDataFrame([(datetime(2024, 1, 2),), (None,)], "t timestamp")
    files.write_jsonl(t, str(tmp_path / "y"), True)
    back = files.read_jsonl(spark, str(tmp_path / "y"), True)
    assert {r.t for r in back.collect()} == {datetime(2024, 1, 2), None}


def test_log_resumes(spark, tmp_path):
    path, ids = str(tmp_path / "log"), spark.createDataFrame([("a:0",), ("b:0",)], "id string")
    assert files.pending(spark, ids, path).count() == 2
    files.append_measurements(spark.createDataFrame([("a:0", "A", False, "q", "p", [1.0])], files.LOG), path)
    assert [r.id for r in files.pending(spark, ids, path).collect()] == ["b:0"]
    size = files.stored(spark, path, spark.read.parquet(path)).first()
    assert size.records == 1 and size.bytes > 0


def test_matrix_is_validated(spark, tmp_path):
    good = {"query_id": "q", "layout": "graph", "latency_ms": 1.5}
    for k, (rows, ok) in enumerate([([{"v": 1}, good], True), ([good, good], False), ([good | {"latency_ms": -1}], False)]):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        if ok:
            assert files.latency_matrix(spark, str(tmp_path / f"{k}.jsonl")).count() == 1
        else:
            with pytest.raises(ValueError):
                files.latency_matrix(spark, str(tmp_path / f"{k}.jsonl"))


def test_weighted_values(spark):
    u = files.uniform(F.col("id"), 7)
    n = {r.v: r["count"] for r in spark.range(20_000).select(files.weighted(u, ["a", "b"], [3, 1]).alias("v")).groupBy("v").count().collect()}
    assert abs(n["a"] / 20_000 - 0.75) < 0.02


def test_templates():
    r = templates.Registry(datetime(2024, 5, 1))
    r.query("a", "A")(lambda p: f"k = {templates.literal(p.unique_integer('k', 1, 3))}")
    r.query("b", "B", max_scale=2)(lambda p: p.limit())
    r.query("w", "W", is_write=True)(lambda p: p.month())
    got = r.generate(4, 1)
    assert [x.id for x in got] == ["a:0", "b:0", "a:1", "b:1"] and got[0].content != got[2].content and got == r.generate(4, 1)
    assert {x.template.name for x in r.generate(1, 3, writes=True)} == {"a", "w"} and r.raw("a") == "k = {{k}}"
    with pytest.raises(ValueError):
        r.generate(8, 3)
    assert templates.literal(["o'k", 2]) == "'o''k', 2" and not r.generate(0, 3)[1:]


def test_label_and_split(spark):
    rows = spark.createDataFrame([("a", k, [9.0] * 5 + [1.0, 3.0]) for k in range(10)] + [("b", 10, [1.0])], "t string, k int, times array<double>")
    assert {r.latency for r in evaluation.label(rows).collect()} == {2.0, None}
    n = {(r.t, r.is_train): r["count"] for r in evaluation.split(rows, "t", "k").groupBy("t", "is_train").count().collect()}
    assert n == {("a", True): 8, ("a", False): 2, ("b", True): 1}


def test_plan_features(spark):
    one = spark.range(10).filter("id > 3").groupBy("id").count()
    two = spark.range(99).filter("id > 5").groupBy("id").count()
    a, b = inspection.plan(one), inspection.plan(two)
    assert inspection.structure_hash(a) == inspection.structure_hash(b) != inspection.structure_hash(inspection.plan(spark.range(3)))
    f = dict(zip(inspection.NAMES, inspection.features(a), strict=True))
    assert f["n_Aggregate"] == 1 and f["n_Filter"] == 1 and f["leaves"] == 1
    assert len(inspection.measure(lambda: spark.range(5), 2)) == 2


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, [1, 2]), (None, []), (1, None)], "a int, b array<int>")
    got = {r["column"]: r for r in inspection.column_statistics(df).collect()}
    assert (got["a"].n, got["a"].present, got["a"].distinct, got["a"].least) == (3, 2, 1, "1") and got["b"].mean_length == 1.0


def test_models_learn_order(spark):
    rng = random.Random(1)
    rows = [([float(k), rng.random()], 10.0 * k + 1) for k in range(120)]
    df = spark.createDataFrame(rows, "features array<double>, latency double")
    for m in (models.forest(df, trees=10), models.tail_blend(df, [0])):
        for fitted in (m, models.calibrated(m, df), models.calibrated(m, df, how="scale")):
            r = evaluation.metrics(fitted.predict(df), "predicted", "latency").first()
            assert r.n == 120 and r.median_q < 1.3, r


def _workload(seed=3):
    rng = random.Random(seed)
    tables = {"q0": frozenset("a"), "q1": frozenset("ab"), "q2": frozenset("bc"), "q3": frozenset("c")}
    latency = {(q, x): rng.uniform(1, 9) for q in tables for x in "GNR"}
    return placement.Workload(latency, tables, {(t, x): rng.uniform(1, 9) for t in "abc" for x in "GNR"}, {"q1": 2.0})


def test_routing_is_optimal(spark):
    w = _workload()
    want = min(w.cost(dict(zip(w.queries, s, strict=True))) for s in itertools.product("GNR", repeat=4))
    routing, cost = placement.route_queries(w, dict.fromkeys(w.queries, "R"), iterations=3000)
    assert cost == pytest.approx(want)
    bound, _ = placement.route_queries(w, dict.fromkeys(w.queries, "R"), must={"q0": "G"}, must_not={("q1", "R")}, iterations=500)
    assert bound["q0"] == "G" and bound["q1"] != "R"
    frame = spark.createDataFrame
    got = placement.audit(
        frame([(q, x, w.weight.get(q, 1.0)) for q, x in routing.items()], "query_id string, layout string, weight double"), frame([(*k, v) for k, v in w.latency.items()], "query_id string, layout string, latency_ms double"),
        frame([(q, t) for q, ts in w.tables.items() for t in ts], "query_id string, table string"), frame([(*k, v) for k, v in w.storage.items()], "table string, layout string, size double"),
    ).first()
    assert got.cost == pytest.approx(cost)


def test_table_placement_is_optimal():
    w = _workload(5)
    every = sorted(w.storage)
    states = (frozenset(c) for n in range(len(every) + 1) for c in itertools.combinations(every, n))
    want = min(w._sum(r, s) for s in states if (r := placement.derive(w, s)) is not None)
    kept, routing, cost = placement.place_tables(w, frozenset((t, "R") for t in "abc"), iterations=4000)
    assert cost == pytest.approx(want) and routing == placement.derive(w, kept)


def test_selectivity_is_near_the_true_share(spark):
    rows = spark.createDataFrame([(float(k % 50) if k % 10 else None, k) for k in range(2000)], "x double, k long")
    s = inspection.Selectivity.of(rows, "x")
    assert s.null() == pytest.approx(0.1) and s.between(0, 49) == pytest.approx(0.9)
    assert s.equals(7.0) == pytest.approx(0.02, rel=0.3) and s.equals(99.0) == 0 and s.between(60, 70) == 0 and s.between(9, 3) == 0
    assert s.between(10, 30) == pytest.approx(rows.filter("x BETWEEN 10 AND 30").count() / 2000, abs=0.03)
    assert s.among([1.0, 2.0, 2.0]) == pytest.approx(0.04, rel=0.3)
    assert s.both(0.5, 0.5) == 0.25 and s.either(0.5, 0.5) == 0.75
    none = inspection.Selectivity.of(rows.filter("false"), "x")
    assert none.null() == none.equals(1.0) == none.between(0, 9) == 0


def test_plan_nodes_and_footprint(spark):
    d = "/root/testdata/sf0.001"
    orders, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    df = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_nationkey").count()
    root = inspection.plan(df)
    rows = inspection.node_features(root)
    assert [n for n, _, _ in rows] == list(range(len(list(root.walk())))) and rows[0][1] == -1 and all(p < n for n, p, _ in rows)
    assert all(len(x) == len(inspection.NODE_NAMES) and sum(x[: len(inspection.FAMILIES)]) == 1 for _, _, x in rows)
    mean, dev = inspection.scaled([x for *_, x in rows])
    assert len(mean) == len(dev) == len(inspection.NODE_NAMES) and min(dev) > 0
    text = inspection.rendered(root)
    assert len(text.split("\n")) == len(rows) and text.startswith("Aggregate") and "`- " in text
    assert set(inspection.footprint(df)) == {"orders", "customer"}


def test_measured_write_leaves_the_table_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).write.parquet(path)
    times = inspection.measure_write(spark, path, lambda df: df.filter("id % 2 = 0"), 3)
    assert len(times) == 3 and min(times) > 0 and spark.read.parquet(path).count() == 100 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_trees(spark):
    rows = spark.createDataFrame([([float(k % 7), float(k % 3)], 10.0 + 5 * (k % 7)) for k in range(200)], "features array<double>, latency double")
    for make in (models.tree, models.random_trees):
        got = make(rows).predict(rows).selectExpr("avg(abs(predicted - latency)) e").first().e
        assert got < 5


def test_json_paths(spark):
    from tessella.operators import documents as D

    texts = ['{"a": {"b": [{"c": 1, "t": "x"}, {"c": 7}]}}', '{"a": {"b": {"c": 9}}}', '{"a": []}', "no json", None, '{"a": {"b": [{"c": "9", "t": "y", "f": true}]}}']
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string")
    for path, want in (("$.a", {0, 1, 2, 5}), ("$.a.b[*]", {0, 1, 5}), ("$.a.b[*] ? (@.c > 5)", {0, 1, 5}), ('$.a.b[*] ? (@.t == "x" && @.c == 1)', {0}), ('$.a.b[*] ? (@.t == "y" || @.c >= 9)', {1, 5}), ("$.a.b[*] ? (@.f == true)", {5}), ("$.z", set())):
        assert {r.k for r in table.filter(D.json_path_exists("j", path)).collect()} == want, path
    with pytest.raises(ValueError):
        D.json_path_exists("j", "a.b")
