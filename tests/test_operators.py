"""Small fixtures for what the tables cannot show: gaps, ties, leap days, edges, empty input; and invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube import schema
from tidecube.functions import dates, scalars, stats
from tidecube.operators import aggregates, grid, joins, ordering, sampling, spatial
from tidecube.plans import features, models, scoring, weekly


def d(text):
    return dt.date.fromisoformat(text)


def test_leap_days_and_iso_weeks(spark):
    df = spark.createDataFrame([(d(x),) for x in ("2024-02-28", "2024-02-29", "2024-03-01", "2024-12-31", "2023-03-01", "2023-12-31", "2021-01-03", "2020-12-31", "2024-12-30")], "d date")
    got = df.select(dates.adjusted_doy(F.col("d")), dates.iso_year(F.col("d")), dates.iso_week(F.col("d"))).collect()
    assert [r[0] for r in got[:6]] == [59, 59, 60, 365, 60, 365]
    assert [(r[1], r[2]) for r in got[6:]] == [(2020, 53), (2020, 53), (2025, 1)]


def test_year_specs():
    assert dates.parse_years("2014-2016, 2015,2020", []) == [2014, 2015, 2016, 2020]
    assert dates.parse_years("all", [3, 1, 3]) == [1, 3]
    for bad in ("", "20x", "2016-2014"):
        with pytest.raises(ValueError):
            dates.parse_years(bad, [])


def test_means_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 5.0), (3.0, 1.0), (float("inf"), 2.0)], "v double, w double")
    assert df.agg(stats.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.0
    assert schema.nan_inf_to_null(df).agg(F.avg("v")).first()[0] == 2.0
    assert schema.drop_incomplete(df, ["v"]).count() == 2
    with pytest.raises(ValueError, match="v"):
        schema.require_complete(df, ["v", "w"])


def test_mean_variants(spark):
    df = schema.nan_inf_to_null(spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 2.0), ("c", float("nan")), ("c", 2.0)], "h3 string, v double"))
    one = lambda how, only=False: {r.h3: r.value for r in aggregates.map_aggregate(df, "v", how, positive_only=only).collect()}
    assert one("non_zero_mean") == {"a": 0.0, "b": 2.0, "c": 2.0}
    assert one("mean", True) == {"b": 2.0, "c": 2.0}
    assert one("mean") == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert one("positive_mean") == {"a": None, "b": 2.0, "c": 2.0}


def test_nearest_date_ties_and_ends(spark):
    src = spark.createDataFrame([(d("2024-01-02"),), (d("2024-01-10"),)], "source_date date")
    q = spark.createDataFrame([(d(x),) for x in ("2024-01-01", "2024-01-06", "2024-01-07", "2024-01-21")], "date date")
    got = {r.date.day: (r.source_date.day, r.day_offset) for r in joins.nearest_date(q, src).collect()}
    assert got == {1: (2, 1), 6: (2, -4), 7: (10, 3), 21: (10, -11)}
    assert [r.source_date for r in joins.nearest_date(q, src.limit(0)).collect()] == [None] * 4


def test_zero_rows_only_on_seen_days(spark):
    p = spark.createDataFrame([(1, d("2024-01-01"), "A"), (2, d("2024-01-01"), "B"), (1, d("2024-01-02"), "B")], "h3 long, date date, species string")
    got = sorted((r.h3, r.date.day, r.species) for r in joins.observed_days(p).collect())
    assert got == [(1, 1, "A"), (1, 1, "B"), (1, 2, "B"), (2, 1, "A"), (2, 1, "B")]
    with pytest.raises(ValueError):
        joins.many_to_one(p, spark.createDataFrame([(1, 1), (1, 2)], "h3 long, x long"), ["h3"])


def test_gradient(spark):
    cells = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate([(0, 0), *grid.STEPS])] + [(99, 50, 50)], "h3 long, q long, r long")
    edges = grid.lattice_edges(cells)
    v = spark.createDataFrame([(i, d("2024-01-01"), 0.0 if i == 0 else 3.0) for i in range(6)] + [(99, d("2024-01-01"), 1.0)], "h3 long, date date, sst double")
    got = {r.h3: r.sst_grad for r in grid.neighbor_gradient(v, edges, ["sst"]).collect()}
    assert got[0] == 3.0 and got[99] is None
    flat = v.withColumn("sst", F.lit(1.0))
    assert {r.sst_grad for r in grid.neighbor_gradient(flat, edges, ["sst"]).collect()} == {0.0, None}
    assert grid.disk(edges, cells, 2).where("h3 = 0").count() == 7


def test_parent_cell(spark):
    assert spark.range(1).select(grid.parent(grid.id_from_hex(F.lit("8928308280fffff")), 5)).first()[0] == int("85283083fffffff", 16)


def test_duplicate_edges_are_one_bin(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 4 + [(2.0, 2.0)], "x double, y double")
    assert [(r.bin, r.rows) for r in aggregates.binned_relationship(df, "x", "y", 4).collect()] == [(0, 5)]


def test_dominant_class_ties_go_to_the_lower(spark):
    df = spark.createDataFrame([(7, 2, 0.5, 1.0), (7, 1, 0.5, 1.0)], "h3 long, cls long, w double, p double")
    assert aggregates.dominant_share(df, "cls", "w", "p").first().cls == 1
    assert ordering.dominant_class(df, ["h3"], "cls", "w").first().cls == 1


def test_group_hold_out_takes_the_crossing_group(spark):
    df = spark.createDataFrame([(g,) for g, n in ((1, 50), (2, 30), (3, 20)) for _ in range(n)], "g long")
    got = sampling.hold_out_groups(df, "g", 0.12, F.col("g"))
    assert {r.g for r in got.where("is_test").distinct().collect()} == {1}


def test_gate_and_alpha(spark):
    df = spark.createDataFrame([("A", 0.0, 0.0), ("A", 1.0, 5.0), ("?", 0.0, 1e6)], "s string, p double, n double")
    got = df.select(scoring.gate(F.col("p"), F.col("s"), {"A": 0.1}), scoring.alpha("spatial", F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0.9, 0.1), (1.0, 0.5), (1.0, 0.9)]
    with pytest.raises(ValueError):
        scoring.alpha("other")


def test_entropy_bounds(spark):
    df = spark.createDataFrame([([0.25] * 4,), ([1.0, 0.0, 0.0, 0.0],)], "probabilities array<double>")
    assert [round(r.component_entropy, 9) for r in models.from_probabilities(df).collect()] == [1.0, 0.0]


def test_shared_edge_belongs_to_both_or_none(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    squares = spark.createDataFrame([(0, ring(0.0)), (1, ring(1.0))], "h3 long, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(1.0, 0.5), (0.5, 0.5)], "lon double, lat double")
    assert spatial.points_in_polygons(p, squares).count() == 3
    assert spatial.points_in_polygons(p, squares, edges=False).count() == 1


def test_overlay_weights(spark):
    square = spark.createDataFrame([(1, [(0.0, -0.5), (1.0, -0.5), (1.0, 0.5), (0.0, 0.5)])], "h3 long, ring array<struct<lon:double,lat:double>>")
    px = spark.createDataFrame([(i * 2 + j, i * 0.5, j * 0.5 - 0.5, i * 0.5 + 0.5, j * 0.5) for i in range(2) for j in range(2)] + [(9, 5.0, 5.0, 6.0, 6.0)], "pixel long, x0 double, y0 double, x1 double, y1 double")
    got = spatial.overlay(square, px).collect()
    assert len(got) == 4 and all(math.isclose(r.weight, 0.25, rel_tol=1e-9) for r in got)


def test_ranks_and_running_totals(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 1, 3, 2, 3)], "x double")
    assert sorted((r.x, r.k) for r in ordering.average_rank(df, "x", "k").collect()) == [(1, 1), (2, 2), (3, 4), (3, 4), (3, 4)]


def test_folds_keep_groups_whole():
    groups = [{"group": g, "rows": 10 + g, "A": g % 3, "B": 1 + g % 2} for g in range(13)]
    got = sampling.fold_assignment(groups, ["A", "B"], 5)
    assert sorted(got) == list(range(13)) and max(np.bincount(list(got.values()))) <= 3


def test_empty_tables_keep_their_schema(spark):
    e = spark.createDataFrame([], "h3 long, date date, species string, species_use_log_pred double, sst double, chl double, ssh double, wind_u10 double, wind_v10 double")
    assert weekly.climatology(weekly.weekly_by_year(e)).count() == 0
    assert features.derived(e).count() == 0 and aggregates.anomalies(e, ["sst"]).count() == 0
    assert aggregates.correlation(e, ["sst", "chl"]).count() == 1 and aggregates.histogram(e, "sst").count() == 0
    assert ordering.running_total(e, "h3", "sst", "t").count() == 0
    assert sampling.hold_out(e, 0.5, F.col("h3")).count() == 0
    with pytest.raises(ValueError):
        aggregates.ready(e, "table")


def test_models_reach_a_bound(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(600, 2))
    df = spark.createDataFrame([(float(a), float(b), float(max(a + b, 0))) for a, b in x], "a double, b double, y double")
    size = models.Size(trees=10, depth=6, rounds=10, step=0.3)
    for m in (models.forest(df, ["a", "b"], "y", size), models.boosting(df, ["a", "b"], "y", size)):
        assert aggregates.metrics(models.predict(m, df, "p"), "y", "p").first().r2 > 0.7
    som = models.self_organising_map(df, ["a", "b"], side=4, epochs=6)
    placed = models.with_prototype(df, som)
    assert placed.count() == 600 and models.map_errors(placed).first().quantization_error < 0.8
    assert len(set(models.ward(som.nodes, 3))) == 3
    m, _ = models.mixture(df, ["a", "b"], k=2)
    assert math.isclose(m.weights.sum(), 1, abs_tol=1e-6)
    assert scalars.buffered_box(0, 0, 1, 1, 0) == (0, 0, 1, 1)


def test_designs_modes_and_kinds_that_are_not_there(spark):
    df = spark.createDataFrame([], "h3 long, date date, block long, component long, seascape long")
    order = [F.col("h3"), F.col("date")]
    assert all(sampling.with_parts(df, v, order).count() == 0 for v in sampling.variants(["groups", "random", "time"]))
    with pytest.raises(ValueError, match="folds"):
        sampling.with_parts(df, sampling.variants(["class_folds"])[0], order)
    with pytest.raises(KeyError):
        sampling.variants(["no design"])
    with pytest.raises(ValueError, match="no mode"):
        scoring.predictions(df, "some", {})
    rows = spark.createDataFrame([("A", 1.0, 2.0)], "species string, x double, y double")
    with pytest.raises(ValueError, match="no training rows"):
        models.train_kinds(rows, rows, ["x"], "y", "species", ["N"], None)


EFFORT = ["A27_effort_by_month", "P25_labels", "A4_effort", "U2_distinct", "A26_effort_by_cell", "H9_prediction_modes", "J11_three_way"]


@pytest.mark.parametrize("name", EFFORT)
def test_orders_meet_their_supplier_by_an_equal_key(spark, small, name):
    """A key of both sides' columns made every order meet every supplier; now only one-row sides meet without a key."""
    from tidecube.queries import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert not [line for line in joined if "%" in line and "s_suppkey" in line]
    assert any("(cell" in line and "= s_suppkey" in line for line in joined)


def test_effort_is_that_of_the_shared_text(spark, tmp_path):
    """Null and negative customers, suppliers that are missing or come twice, and no supplier at all."""
    from tidecube.queries.registry import VIEWS, Tables

    orders = spark.createDataFrame([(1, None), (2, -7), (3, 0), (4, 5), (5, 6), (6, 11)], "o_orderkey long, o_custkey long").selectExpr("*", "DATE'2024-01-01' AS o_orderdate", "'a' AS o_orderpriority", "'F' AS o_orderstatus", "1e4 * o_orderkey AS o_totalprice")
    for n, keys in enumerate(([0, 1, 1, 3, -2], [])):
        orders.write.parquet(f"{tmp_path}/{n}/orders.parquet")
        supplier = spark.createDataFrame([(k,) for k in keys], "s_suppkey long")
        supplier.write.parquet(f"{tmp_path}/{n}/supplier.parquet")
        text = VIEWS["effort"].replace("FROM orders", "FROM {orders}").replace("FROM supplier", "FROM {supplier}")
        want = spark.sql(text, orders=orders, supplier=supplier)
        got = Tables(spark, f"{tmp_path}/{n}").effort
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema] and got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        assert bool(keys) == bool(got.count())


def test_folds_of_many_groups_are_the_greedy_ones(spark):
    """Over 10,000 groups, which were an error; the folds are those of the plain rule."""
    kinds = ["A", "B"]
    df = spark.range(30_000).selectExpr("id * id % 12007 AS g", "CASE WHEN id % 3 = 0 THEN 'A' ELSE 'B' END AS kind", "id % 5 AS v").union(spark.sql("SELECT id % 10500 AS g, 'A' AS kind, 1L AS v FROM range(10500)")).union(spark.sql("SELECT NULL, 'A', 1L"))
    got = sampling.with_folds(df, "g", "kind", F.col("v") > 1, kinds, 5)
    table = [r.asDict() for r in sampling.group_support(df.where("g is not null"), "g", "kind", F.col("v") > 1, kinds).withColumnRenamed("g", "group").collect()]
    assert len(table) > 10_000 and got.count() == 40_500
    assert dict(got.select("g", "fold").distinct().collect()) == sampling.fold_assignment(table, kinds, 5)


def test_grid_rollup_keeps_cells_that_are_no_supplier(spark, tmp_path):
    """Its SQL reads no supplier: items of a missing one, of one that is there twice, and of none at all count once."""
    from tidecube.queries import QUERIES

    items = spark.createDataFrame([(7, "A", 0.08), (7, "A", 0.08), (12, "A", 0.02), (None, "A", 0.02)], "l_suppkey long, l_returnflag string, l_tax double")
    items.selectExpr("*", "DATE'1996-03-05' AS l_shipdate", "0.1D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7,), (7,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["A33_grid_rollup"](spark, str(tmp_path)).collect()
    assert sorted((r.grid if r.grid is not None else -1, r.cells, r.display_mean) for r in got) == [(-1, 0, None), (0, 1, 1.0), (1, 1, None)]
