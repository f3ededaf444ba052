"""Models on data whose answer is known: two clusters of positive rows, a target of one feature, three nodes on a line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.plans import models
from tidecube.queries import QUERIES


@pytest.fixture(scope="module")
def two_kinds(spark):
    """Two clusters of 60 and 40 positive rows, and zeros far from both."""
    rows = [(i, float(i % 7) / 10, float(i % 5) / 10, 1.0 + i % 3) for i in range(60)] + [(60 + i, 20 + float(i % 7) / 10, 20 + float(i % 5) / 10, 4.0) for i in range(40)]
    return spark.createDataFrame(rows + [(100 + i, 90.0 + i, -90.0, 0.0) for i in range(30)], "id long, a double, b double, y double")


def test_sweep_counts_positive_rows_by_component(two_kinds):
    got = {r.k: r.asDict() for r in models.component_sweep(two_kinds, ["a", "b"], "y", [2, 3]).collect()}
    assert sorted(got[2][f"component_{c}_positive_rows"] for c in range(2)) == [40, 60] and got[2]["component_2_positive_rows"] is None
    assert sorted(got[2][f"component_{c}_positive_fraction"] for c in range(2)) == [0.4, 0.6]
    assert all(r["positive_rows"] == 100 == sum(r[f"component_{c}_positive_rows"] or 0 for c in range(3)) for r in got.values())


def test_blend_of_fitted_models(two_kinds):
    got = models.density_and_prior(two_kinds, two_kinds, ["a", "b"], "y", k=2, size=models.Size(rounds=5)).collect()
    density = {r.id: r.density_log for r in models.density_score(two_kinds, models.density_regressor(two_kinds, ["a", "b"], "y", 2)).collect()}
    prior = {r.id: r.p for r in models.predict(models.boosting(two_kinds, ["a", "b"], "y", models.Size(rounds=5), depth=4), two_kinds, "p").collect()}
    assert len(got) == 130 and all(r.score == pytest.approx(0.5 * density[r.id] + 0.5 * prior[r.id]) for r in got)
    assert len({round(r.prior, 6) for r in got}) > 1 and len({round(r.density_log, 6) for r in got}) > 1


@pytest.mark.parametrize("name", ["L4_density_regressor", "L9_component_sweep"])
def test_queries_left_out_elsewhere(spark, small, name):
    got = QUERIES[name](spark, small)
    assert got.count() == (2 if name == "L9_component_sweep" else got.select("h3", "date").distinct().count()) > 0


@pytest.fixture(scope="module")
def positive(two_kinds):
    return two_kinds.where("y > 0")


def test_density_is_high_in_the_clusters_only(two_kinds):
    fitted = models.density_regressor(two_kinds, ["a", "b"], "y", 2)
    got = models.density_score(two_kinds, fitted).collect()
    assert all(0 <= r.plausibility <= 1 and r.density_log == pytest.approx(r.plausibility * fitted[3]) for r in got)
    assert all(r.plausibility == 0 for r in got if r.id >= 100) and np.mean([r.plausibility for r in got if r.id < 100]) > 0.3


@pytest.mark.parametrize("kept", [["a", "b"], ["b"]])
def test_posterior_tells_the_clusters_apart(positive, kept):
    m, _ = models.mixture(positive, ["a", "b"], 2)
    got = models.with_component(positive, m.marginal(kept)).collect()
    assert len({(r.id >= 60, r.component) for r in got}) == 2
    assert all(r.component_probability > 0.999 and r.component_entropy < 0.01 and sum(r.probabilities) == pytest.approx(1) for r in got)


def test_report_is_in_raw_units(positive):
    m, _ = models.mixture(positive, ["a", "b"], 2)
    low, high = sorted(m.report(), key=lambda r: r["a_mean"])
    for r, ids, w in ((low, range(60), 0.6), (high, range(60, 100), 0.4)):
        a = [i % 7 / 10 if i < 60 else 20 + (i - 60) % 7 / 10 for i in ids]
        assert r["weight"] == pytest.approx(w, abs=0.01) and r["a_mean"] == pytest.approx(np.mean(a), abs=0.01) and r["a_std"] == pytest.approx(np.std(a), rel=0.05)


def test_clusters_and_distances(positive):
    got = [r.asDict() for r in models.clusters(positive, ["a", "b"], 2).collect()]
    assert len({(r["id"] >= 60, r["seascape"]) for r in got}) == 2
    x = np.array([[r["a"], r["b"]] for r in got])
    z, c = (x - x.mean(0)) / x.std(0, ddof=1), np.array([r["seascape"] for r in got])
    want = [np.linalg.norm(v - z[c == k].mean(0)) for v, k in zip(z, c)]
    assert [r["seascape_distance"] for r in got] == pytest.approx(want)


def test_map_classes_keep_the_clusters_apart(positive):
    m = models.self_organising_map(positive, ["a", "b"], side=4, epochs=12)
    cls = dict(models.prototypes_table(positive, m, 2).select("som_prototype", "seascape").collect())
    got = models.with_prototype(positive, m).collect()
    assert len(cls) == 16 and len({(r.id >= 60, cls[r.som_prototype]) for r in got}) == 2


def test_cuts_of_three_nodes():
    (got,) = models.compare_cuts(np.array([[0.0], [1.0], [10.0]]), [2])
    want = {"k": 2, "singletons": 1, "within": 0.5, "silhouette": (0.9 + 8 / 9) / 3, "centroid_distance": 9.5, "davies_bouldin": 0.5 / 9.5}
    assert {k: got[k] for k in want} == pytest.approx(want)


@pytest.fixture(scope="module")
def slope(spark):
    return spark.range(400).select(F.col("id"), (F.col("id") % 100).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("b"), (3.0 * (F.col("id") % 100)).alias("y"), (F.col("id") % 4).alias("fold"))


def test_importance_and_dependence_follow_the_one_feature(slope):
    fitted = models.forest(slope, ["a", "b"], "y", models.Size(trees=5, depth=6, leaf=1))
    top, rest = models.importances(fitted, ["a", "b"], slope).collect()
    assert top.feature == "a" and top.importance > 0.9 and top.importance + rest.importance == pytest.approx(1)
    got = sorted(models.partial_dependence(fitted, slope, "a", 5).collect())
    assert [r.value for r in got] == pytest.approx(np.linspace(got[0].value, got[-1].value, 5)) and (got[0].value, got[-1].value) == pytest.approx((2, 97), abs=1.1)
    assert [r.prediction for r in got] == pytest.approx([3 * r.value for r in got], abs=15)


def test_folds_are_scored_by_models_that_have_not_seen_them(slope):
    seen = []

    def fit(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        return models.forest(train, ["a"], "y", models.Size(trees=3, depth=6, leaf=1))

    got = models.cross_validate(slope, ["a"], "y", 4, fit).orderBy("fold").collect()
    assert seen == [set(range(4)) - {f} for f in range(4)] and [r.n for r in got] == [100] * 4 and all(r.rmse < 15 for r in got)


def test_mixture_is_that_of_plain_rounds_over_all_rows(spark):
    """The fit goes on from its start by the textbook's rounds, in any partitioning, and ends by the gain of a row."""
    draw = np.random.default_rng(3)
    rows = np.concatenate([draw.normal(0, 1, (900, 2)), draw.normal([6, 2], [2, 0.5], (600, 2))])
    df = spark.createDataFrame(rows.tolist(), "a double, b double")
    m, total = models.mixture(df.repartition(7), ["a", "b"], 2)
    other, again = models.mixture(df.repartition(3), ["a", "b"], 2)
    assert np.allclose(m.means, other.means, atol=1e-6) and abs(total - again) < 1e-3
    z = (rows - rows.mean(0)) / rows.std(0)
    j = m.log_joint(rows)
    assert abs(np.logaddexp.reduce(j, axis=1).sum() - total) < 1e-4 * len(rows)
    r = np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])
    assert np.allclose(r.mean(0), m.weights, atol=0.01) and np.allclose((r.T @ z) / r.sum(0)[:, None], m.means, atol=0.02)
    with pytest.raises(ValueError, match="no rows"):
        models.mixture(df.where("a > 1000"), ["a", "b"], 2)


def test_components_without_their_probabilities(positive):
    m, _ = models.mixture(positive, ["a", "b"], 2)
    whole, short = models.with_component(positive, m), models.with_component(positive, m, probabilities=False)
    assert "probabilities" not in short.columns and sorted(whole.drop("probabilities").collect()) == sorted(short.collect())


def test_nearest_nodes_are_those_of_a_stable_order():
    """Equal distances too: nodes that come twice, rows halfway between two."""
    draw = np.random.default_rng(1)
    nodes = np.concatenate([draw.integers(-2, 3, (7, 2)), [[0, 0], [0, 0]]]).astype(float)
    m = models.Map(("a", "b"), np.zeros(2), np.ones(2), nodes, 3)
    x = draw.integers(-4, 5, (500, 2)) / 2
    d = ((x[:, None] - nodes[None, :]) ** 2).sum(2)
    two = np.argsort(d, axis=1, kind="stable")[:, :2]
    first, apart, second = m.nearest(x)
    assert (first == two[:, 0]).all() and (second == two[:, 1]).all() and (m.nearest_one(x) == first).all()
    assert np.allclose(apart, np.sqrt(d.min(1)))
