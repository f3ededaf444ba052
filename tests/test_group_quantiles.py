"""Exact quantiles of many groups against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidecube.operators.ordering import with_quantiles


def test_quantiles_of_groups_are_those_of_numpy(spark):
    g = random.Random(4)
    rows = [("hot", None, g.gauss(0, 1)) for _ in range(30_000)] + [("hot", 1, float(g.randrange(3))) for _ in range(5_000)]
    rows += [("tail", 1, g.paretovariate(0.4)) for _ in range(9_000)] + [("one", 2, 7.5), ("two", 2, 1.0), ("two", 2, 2.0), (None, 3, 4.0), (None, 3, None), ("none", 4, None)]
    rows += [("big", 5, float("inf")), ("big", 5, -float("inf")), ("big", 5, 3.0)]
    d = spark.createDataFrame(rows, "a string, b int, v double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.9, 0.9995, 1.0]
    wanted = {f"q{i}": (F.col("v"), q) for i, q in enumerate(qs)} | {"pos": (F.when(F.col("v") > 0, F.col("v")), 0.5)}
    got = {(r.a, r.b): r for r in with_quantiles(d, ["a", "b"], [F.count("*").alias("n"), F.max("v").alias("most")], wanted).collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    assert set(got) == set(groups)
    for key, own in groups.items():
        v, r = np.array([x for x in own if x is not None]), got[key]
        assert r.n == len(own) and (r.most == v.max() if len(v) else r.most is None)
        for i, q in enumerate(qs):
            if not len(v):
                assert r[f"q{i}"] is None
            elif key != ("big", 5) or q in (0.0, 0.5, 1.0):
                assert np.isclose(r[f"q{i}"], np.sort(v)[int(q * (len(v) - 1))] if key == ("big", 5) else np.quantile(v, q), rtol=1e-12), (key, q)
        up = v[v > 0] if len(v) else v
        assert (r.pos is None) if not len(up) else key == ("big", 5) or np.isclose(r.pos, np.median(up), rtol=1e-12)


def test_no_rows_and_no_percentile_in_the_plan(spark):
    d = spark.createDataFrame([], "a string, v double")
    out = with_quantiles(d, ["a"], [F.count("*").alias("n")], {"m": (F.col("v"), 0.5)})
    assert out.columns == ["a", "n", "m"] and out.count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
