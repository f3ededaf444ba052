"""Extremely randomised trees and histogram boosting against plain growers that see all rows at once; saved models."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.plans import models, saved, trees
from tidecube.queries import QUERIES

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 1_500
    a, b, c = rng.integers(0, 40, n), rng.integers(0, 9, n), np.ones(n)
    y = np.where(a > 17, 8, 0) + 3 * (b == 4) + rng.integers(0, 2, n)
    rows = np.stack([a, b, c, y, 1 + b % 3], 1).astype(float)
    return rows, spark.createDataFrame([tuple(map(float, r)) for r in rows] + [(None, 1.0, 1.0, 5.0, 1.0)], "a double, b double, c double, y double, w double").repartition(4)


def plain_tree(x, y, w, tree, depth, leaf, seed=42):
    """{node: (feature or -1, threshold, value)}, node by node, cut by cut."""
    out = {}

    def cut(node, rows):
        best, total, s = None, w[rows].sum(), (w[rows] * y[rows]).sum()
        if node.bit_length() <= depth and len(rows) >= 2 * leaf and len(set(y[rows])) > 1:
            for f in range(x.shape[1]):
                lo, hi = x[rows, f].min(), x[rows, f].max()
                t = lo + trees.draws(seed, tree, np.array([node]), x.shape[1])[0, f] * (hi - lo)
                left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                if min(len(left), len(right)) < leaf:
                    continue
                gain = sum((w[r] * y[r]).sum() ** 2 / w[r].sum() for r in (left, right)) - s * s / total
                if gain > 1e-12 * max(1, s * s / total) and (best is None or gain > best[0]):
                    best = (gain, f, t, left, right)
        out[node] = (best[1], best[2], s / total) if best else (-1, 0.0, s / total)
        if best:
            cut(2 * node, best[3])
            cut(2 * node + 1, best[4])

    cut(1, np.arange(len(y)))
    return out


@pytest.mark.parametrize("local_rows", [10**6, 100, 1])
@pytest.mark.parametrize("weight", [None, "w"])
def test_extra_trees_are_those_of_a_plain_grower(data, local_rows, weight):
    rows, df = data
    model = trees.extra_trees(df, X, "y", trees=3, depth=6, leaf=5, weight=weight, local_rows=local_rows, copies=3_000)
    w = rows[:, 4] if weight else np.ones(len(rows))
    plain = [plain_tree(rows[:, :3], rows[:, 3], w, t, 6, 5) for t in range(3)]
    want = trees._ensemble(X, plain, 0.0, 1 / 3)
    assert (model.feature == want.feature).all() and len(model.feature) > 60
    assert np.allclose(model.threshold, want.threshold) and np.allclose(model.value, want.value)
    got = trees.predict(df, model, "p").select("a", "b", "c", "p").toPandas()
    assert len(got) == len(rows) and np.allclose(got["p"], want.predict(got[X].to_numpy()))


def test_draws_are_uniform_and_differ():
    u = trees.draws(1, 2, np.arange(1, 20_001), 5)
    assert u.min() >= 0 and u.max() < 1 and np.allclose(u.mean(0), 0.5, atol=0.01) and np.allclose(np.histogram(u, 10)[0] / u.size, 0.1, atol=0.005)
    assert abs(np.corrcoef(u.T)[0, 1]) < 0.03 and (trees.draws(1, 3, np.arange(1, 20_001), 5) != u).all()


def plain_boosting(x, y, edges, rounds, rate, leaves, l2, leaf):
    """Predictions of boosting with best-first trees, each gain from the rows themselves."""
    p = np.full(len(y), y.mean())

    def best(rows):
        g, found = p[rows] - y[rows], (0.0, None)
        score = lambda v: v.sum() ** 2 / (len(v) + l2)
        for f, cuts in enumerate(edges):
            for t in cuts:
                on = x[rows, f] <= t
                if min(on.sum(), (~on).sum()) >= leaf and (gain := score(g[on]) + score(g[~on]) - score(g)) > found[0] + 1e-9:
                    found = (gain, (rows[on], rows[~on]))
        return found

    sizes = []
    for _ in range(rounds):
        gain, parts = best(np.arange(len(y)))
        queue, done, n = [(-gain, 1, np.arange(len(y)), parts)], [], 1
        while queue and n < leaves and queue[0][1] and queue[0][0] < 0:
            _, node, _, parts = heapq.heappop(queue)
            n += 1
            for k, rows in enumerate(parts):
                gain, own = best(rows)
                heapq.heappush(queue, (-gain, 2 * node + k, rows, own))
        done = [(rows, -rate * (p[rows] - y[rows]).sum() / (len(rows) + l2)) for _, _, rows, _ in queue]
        sizes.append(len(done))
        for rows, v in done:
            p[rows] += v
    return p, sizes


def test_sums_by_a_shuffle(data, monkeypatch):
    rows, df = data
    whole = trees.histogram_boosting(df, X, "y", rounds=2, leaves=5).predict(rows[:, :3])
    monkeypatch.setattr(trees, "DRIVER_BYTES", 0)
    assert np.allclose(trees.histogram_boosting(df, X, "y", rounds=2, leaves=5).predict(rows[:, :3]), whole)


@pytest.mark.parametrize(("leaves", "l2"), [(6, 0.1), (4, 2.0)])
def test_boosting_is_that_of_a_plain_grower(data, leaves, l2):
    rows, df = data
    x, y = rows[:, :3], rows[:, 3]
    model = trees.histogram_boosting(df, X, "y", rounds=3, rate=0.3, leaves=leaves, l2=l2, leaf=20)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]  # few values: every cut between them is a bin's edge
    want, sizes = plain_boosting(x, y, edges, 3, 0.3, leaves, l2, 20)
    assert [int(((model.feature < 0)[lo:hi]).sum()) for lo, hi in zip(model.roots, [*model.roots[1:], len(model.feature)])] == sizes
    assert max(sizes) == leaves and np.allclose(model.predict(x), want)


def test_predictions_are_written_between_trees(data, monkeypatch):
    rows, df = data
    whole = trees.histogram_boosting(df, X, "y", rounds=5, leaves=5)
    monkeypatch.setattr(trees, "REFRESH", 2)
    assert np.allclose(trees.histogram_boosting(df, X, "y", rounds=5, leaves=5).predict(rows[:, :3]), whole.predict(rows[:, :3]))


def test_no_rows_are_an_error(data):
    with pytest.raises(ValueError, match="no rows"):
        trees.extra_trees(data[1].where("a < -1"), X, "y", 2)
    with pytest.raises(ValueError, match="no rows"):
        trees.histogram_boosting(data[1].where("a < -1"), X, "y", 2)


def test_one_value_of_the_target(data):
    df = data[1].withColumn("y", F.lit(2.5))
    assert trees.extra_trees(df, X, "y", 2).predict(data[0][:5, :3]).tolist() == [2.5] * 5
    assert np.allclose(trees.histogram_boosting(df, X, "y", 2).predict(data[0][:5, :3]), 2.5)


def test_saved_models_come_back(spark, data, tmp_path):
    rows, df = data
    own = [trees.extra_trees(df, X, "y", 2, 4), models.mixture(df, ["a", "b"], 2)[0], models.self_organising_map(df, ["a", "b"], 3, 2)]
    for k, m in enumerate(own):
        saved.save(spark, m, f"{tmp_path}/m{k}")
        back = saved.load(spark, type(m), f"{tmp_path}/m{k}", m.features)
        for f in m.__dataclass_fields__:
            a, b = getattr(m, f), getattr(back, f)
            assert type(a) is type(b) and (np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b)
    with pytest.raises(ValueError, match="fitted to a, b, c"):
        saved.load(spark, trees.Ensemble, f"{tmp_path}/m0", ["b", "a", "c"])
    with pytest.raises(ValueError, match="Mixture, not"):
        saved.load(spark, trees.Ensemble, f"{tmp_path}/m1", X)
    forest = models.forest(df.na.drop(), X, "y", models.Size(trees=2, depth=3))
    saved.save(spark, forest, f"{tmp_path}/f", X)
    again = saved.load(spark, type(forest), f"{tmp_path}/f", X)
    assert models.predict(again, df.na.drop()).select("prediction").collect() == models.predict(forest, df.na.drop()).select("prediction").collect()


def test_loaded_model_scores_as_the_fitted_one(spark, small):
    from tidecube.queries.models import _X, data
    from tidecube.queries.registry import Tables

    own = data(Tables(spark, small))
    direct = trees.predict(own, trees.extra_trees(own, _X, "target", trees=10, depth=8), "p").select("h3", F.col("date").cast("string").alias("date"), F.round("p", 6).alias("prediction"))
    got = QUERIES["K7_saved_model"](spark, small)
    key = ["h3", "date"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (direct, got))
    assert (a[key] == b[key]).all().all() and np.allclose(a["prediction"], b["prediction"], atol=2e-6)


@pytest.mark.parametrize(("name", "least"), [("L2_extra_trees", 0.8), ("L3_histogram_boosting", 0.6)])
def test_models_on_all_features(spark, small, name, least):
    (got,) = QUERIES[name](spark, small).collect()
    assert got["r2"] > least and got["n"] > 0


def test_boosting_reads_blocks_of_columns(data, monkeypatch):
    written, kept = [], trees._kept
    monkeypatch.setattr(trees, "_kept", lambda df: written.append(kept(df)) or written[-1])
    trees.histogram_boosting(data[1], X, "y", rounds=1, leaves=3)
    blocks = written[0].collect()
    assert sum(len(r.y) // 8 for r in blocks) == data[1].na.drop().count() > 100 * len(blocks)
    assert all(len(r.b) == 3 * len(r.y) // 8 and not r.w for r in blocks)
