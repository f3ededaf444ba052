"""L: models on the cube's features. Mixtures, clusters and the map have their production sizes, trees smaller ones (``_SMALL``). Fits have no SQL; tests check them on data with a known answer."""

from pyspark.sql import functions as F

from tidecube.operators import aggregates as ag
from tidecube.operators import grid, sampling
from tidecube.operators.ordering import written
from tidecube.plans import features, models, saved, trees
from tidecube.queries.joins import _EDGES
from tidecube.queries.registry import N, R, query
from tidecube.schema import FEATURES
from tidecube.sources.store import shared_folder

_X = ["sst", "chl", "ssh", "wind_u10", "wind_v10"]
_SMALL = models.Size(trees=10, depth=6, leaf=5, rounds=8)


def data(t):
    """Daily features and a target that follows from them in part."""
    target = F.log1p(F.greatest(F.col("sst") - 20, F.lit(0.0)) + 100 * F.col("chl"))
    return t.env.withColumn("target", target)


def split(t):
    own = sampling.hold_out(data(t), 0.25, sampling.integer_key(F.col("h3") * 10007 + F.datediff("date", F.lit("1990-01-01").cast("date"))), F.col("h3"), F.col("date"))
    return own.where("NOT is_test"), own.where("is_test")


def _accuracy(fit):
    def run(t):
        train, test = split(t)
        return ag.metrics(models.predict(fit(train), test, "p"), "target", "p")

    return run


query("L1_random_forest")(_accuracy(lambda d: models.forest(d, _X, "target", _SMALL)))
query("L2_whole_sample_forest")(_accuracy(lambda d: models.forest(d, _X, "target", _SMALL, bootstrap=False)))
query("L3_boosting")(_accuracy(lambda d: models.boosting(d, _X, "target", _SMALL)))


@query("L4_density_regressor")
def _(t):
    own = written(data(t))
    return models.density_score(own, models.density_regressor(own, _X[:3], "target")).select("h3", "date", "plausibility", "density_log")


@query("L5_blend", "env", f"SELECT h3, date, {R('0.5e0 * sst + 0.5e0 * greatest(wind_v10, 0)', 'score')} FROM env", days="date")
def _(t):
    return models.blended(t.env, "sst", "wind_v10", "score").select("h3", "date", "score")


@query("L5_density_and_prior")
def _(t):
    """The whole operator; L5_blend is its last step alone, on two columns, which SQL can express."""
    train, test = map(written, split(t))
    return models.density_and_prior(train, test, _X[:3], "target").select("h3", "date", "density_log", "prior", "score")


@query("L7_component_posterior")
def _(t):
    own = written(t.env)
    m, _ = models.mixture(own, _X)
    return models.with_component(own, m.marginal(_X[:3]), probabilities=False).select("h3", "date", "component", "component_probability", "component_entropy")


@query("L7_from_probabilities", oracle=f"WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / (l_quantity + 20) AS a, 20 / (l_quantity + 20) AS b FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, {N('l_linenumber', 'l_linenumber')}, CASE WHEN a >= b THEN 0::BIGINT ELSE 1 END AS component, {R('greatest(a, b)', 'component_probability')}, {R('(-a * ln(a) - b * ln(b)) / ln(2e0)', 'component_entropy')} FROM x")
def _(t):
    q = F.col("l_quantity")
    own = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array(q / (q + 20), 20 / (q + 20)).alias("probabilities"))
    return models.from_probabilities(own).drop("probabilities")


@query("L8_mixture_report")
def _(t):
    m, _ = models.mixture(t.env, _X[:3])
    return t.spark.createDataFrame(m.report())


@query("L9_component_sweep")
def _(t):
    return models.component_sweep(split(t)[0], _X[:3], "target", [2, 3])


@query("L10_kmeans")
def _(t):
    return models.clusters(t.env, _X).select("h3", "date", "seascape", "seascape_distance")


def _map(t):
    return models.self_organising_map(t.env, _X)


@query("L11_som_errors")
def _(t):
    own = written(t.env)
    return models.map_errors(models.with_prototype(own, models.self_organising_map(own, _X)))


@query("L12_som_classes")
def _(t):
    """Rows with their map node and its Ward class."""
    from tidecube.operators.joins import class_of_prototype

    own = written(t.env)
    m = models.self_organising_map(own, _X)
    return class_of_prototype(models.with_prototype(own, m), models.prototypes_table(own, m, 5)).select("h3", "date", "som_prototype", "seascape", "seascape_distance")


@query("L13_nearest_prototype", oracle=f"WITH p AS (SELECT vec_id AS prototype, embedding AS v FROM embeddings WHERE vec_id < 8), d AS (SELECT vec_id, prototype, round(sqrt(list_sum([(CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE)) FOR i IN range(1, 65)])), 9) AS d FROM embeddings CROSS JOIN p) SELECT vec_id, prototype, {R('d', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, prototype) AS k FROM d) WHERE k = 1")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return models.nearest_prototype(e, e.where("vec_id < 8").select(F.col("vec_id").alias("prototype"), F.col("v").alias("prototype_vector")), "v").select("vec_id", "prototype", "distance")


@query("L14_compare_cuts")
def _(t):
    return t.spark.createDataFrame(models.compare_cuts(_map(t).nodes, [3, 5, 8]))


@query("L15_prototype_table")
def _(t):
    return models.prototypes_table(t.env, _map(t), 4)


@query("L16_importances")
def _(t):
    return models.importances(models.forest(data(t), _X, "target", _SMALL), _X, t.env)


@query("L17_partial_dependence")
def _(t):
    own = data(t)
    sample = sampling.sample_n(own, 500, sampling.mixed_key(F.col("h3"), F.col("date")), F.col("h3"), F.col("date"))
    return models.partial_dependence(models.forest(own, _X, "target", _SMALL), sample, "sst", 8)


@query("L18_residuals", "pred", f"SELECT h3, date, species, {R('species_use_log_pred', 'observed')}, {R('plausibility', 'predicted')}, {R('species_use_log_pred - plausibility', 'residual')} FROM pred", days="date")
def _(t):
    o, p = F.col("species_use_log_pred"), F.col("plausibility")
    return t.pred.select("h3", "date", "species", o.alias("observed"), p.alias("predicted"), (o - p).alias("residual"))


@query("L19_joint_and_single")
def _(t):
    own = t.pred.withColumn("target", F.col("species_use_log_pred")).withColumn("day", F.dayofyear("date").cast("double"))
    order = sampling.integer_key(F.col("h3") * 10007 + F.datediff("date", F.lit("1990-01-01").cast("date"))), F.col("h3"), F.col("date"), F.col("species")
    held = sampling.hold_out(own, 0.25, *order)
    return models.train_kinds(held.where("NOT is_test"), held.where("is_test"), ["plausibility", "day"], "target", "species", ["A", "N", "R"], lambda d, x: models.forest(d, x, "target", _SMALL))


@query("L20_cross_validation")
def _(t):
    own = data(t).withColumn("fold", F.col("h3") % 3)
    return models.cross_validate(own, _X, "target", 3, lambda d: models.forest(d, _X, "target", models.Size(trees=4, depth=4)))


_DAYS = "SELECT h3, date, sst, 0.7310585786e0 * ssh AS ssh, sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10) AS wind_speed, ln(1 + chl) AS chl_log, dayofyear(date) - CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366 AND dayofyear(date) > 59 THEN 1 ELSE 0 END AS doy FROM env"
_GRAD = "sqrt(avg(power(v.{c} - n.{c}, 2))) AS {c}_grad"
_ALL = [*("sst", "ssh", "wind_speed", "chl_log"), *(f"{c} - avg({c}) OVER w AS {c}_anom" for c in ("sst", "ssh", "wind_speed", "chl_log")), "sin(2 * pi() * (doy - 1) / 365) AS doy_sin", "cos(2 * pi() * (doy - 1) / 365) AS doy_cos"]


def _feature_grid(t):
    """The feature stage with all its columns: derived ones, anomalies, gradients and static features."""
    static = t.cells.select("h3", (F.col("q") * 10).alias("depth_m"), F.lit(0.0).alias("slope"), F.lit(1.0).alias("dist_coast_m"), (F.col("r") - 57).alias("lat"), (F.col("q") - 64).alias("lon"))
    env = features.environment(t.env.withColumn("ssh", F.lit(0.7310585786) * F.col("ssh")), grid.lattice_edges(t.cells))  # scaled, so that no mean lies on the edge of rounding
    return features.feature_grid(env, static).select("h3", "date", *(F.col(c).cast("double") for c in FEATURES))


@query("feature_grid", "env cells", f"""WITH {_EDGES}, d AS ({_DAYS}), a AS (SELECT h3, date, {', '.join(_ALL)} FROM d WINDOW w AS (PARTITION BY h3, doy)),
    g AS (SELECT v.h3, v.date, {', '.join(_GRAD.format(c=c) for c in ('sst', 'ssh', 'chl_log'))} FROM d v JOIN e ON v.h3 = e.h3 JOIN d n ON n.h3 = e.neighbor AND n.date = v.date GROUP BY 1, 2),
    s AS (SELECT h3 AS cell, q * 10 AS depth_m, 0 AS slope, 1 AS dist_coast_m, sin(radians(r - 57)) AS lat_sin, cos(radians(r - 57)) AS lat_cos, sin(radians(q - 64)) AS lon_sin, cos(radians(q - 64)) AS lon_cos FROM cells)
    SELECT a.h3, a.date, {', '.join(R(c, c) for c in FEATURES)} FROM a LEFT JOIN g ON a.h3 = g.h3 AND a.date = g.date LEFT JOIN s ON a.h3 = s.cell""", days="date")
def _(t):
    return _feature_grid(t)


def _production_rows(t):
    """(training rows, held-out rows) with all features and a target that follows from some of them."""
    target = F.log1p(F.greatest(F.col("sst") - 20, F.lit(0.0)) + 100 * F.expm1("chl_log"))
    own = written(_feature_grid(t).na.drop(subset=list(FEATURES)).withColumn("target", target))
    own = sampling.hold_out(own, 0.25, sampling.integer_key(F.col("h3") * 10007 + F.datediff("date", F.lit("1990-01-01").cast("date"))), F.col("h3"), F.col("date"))
    return own.where("NOT is_test"), own.where("is_test")


@query("L2_extra_trees")
def _(t):
    """The production model at its production size: 300 trees of depth 20 over all features; metrics on held-out rows."""
    train, test = _production_rows(t)
    return ag.metrics(trees.predict(test, trees.extra_trees(train, FEATURES, "target"), "p"), "target", "p")


@query("L3_histogram_boosting")
def _(t):
    """31 leaves, l2 0.1 and a rate of 0.05 over all features; 20 of the 300 rounds."""
    train, test = _production_rows(t)
    return ag.metrics(trees.predict(test, trees.histogram_boosting(train, FEATURES, "target", rounds=20), "p"), "target", "p")


@query("K7_saved_model")
def _(t):
    """Train, save, load with the list of features checked, and score every row with what was loaded."""
    own = data(t)
    path = shared_folder(t.spark, "model")
    saved.save(t.spark, trees.extra_trees(own, _X, "target", trees=10, depth=8), path)
    return trees.predict(own, saved.load(t.spark, trees.Ensemble, path, _X), "p").select("h3", "date", F.col("p").alias("prediction"))


@query("species_training", "presence", "WITH k AS (SELECT DISTINCT c.h3, c.date, s.species FROM presence c JOIN presence s ON c.date = s.date) SELECT k.h3, k.date, k.species, coalesce(presence_count, 0) AS presence_count, CAST(coalesce(presence_count * individual_count, 0) AS DOUBLE) AS residence_index FROM k LEFT JOIN presence p ON k.h3 = p.h3 AND k.date = p.date AND k.species = p.species", days="date")
def _(t):
    seen = t.telemetry.select("h3", "date").distinct().withColumn("sst", F.lit(1.0))
    return features.species_training(t.presence, seen).select("h3", "date", "species", "presence_count", "residence_index")


@query("fishing_training", "env daily_effort", f"WITH e AS (SELECT h3, date, sum(fishing_hours) AS h, sum(vessel_count) AS v FROM daily_effort GROUP BY 1, 2) SELECT env.h3, env.date, {R('coalesce(h, 0)', 'fishing_hours')}, CAST(coalesce(v, 0) AS BIGINT) AS vessel_count, {R('coalesce(h * v, 0)', 'fishing_activity')} FROM env LEFT JOIN e ON env.h3 = e.h3 AND env.date = e.date", days="date")
def _(t):
    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    return features.fishing_training(t.env.select("h3", "date"), e)
