"""A, W and O: aggregates, windows and orders."""

from pyspark.sql import functions as F

from tidecube.operators import aggregates as ag
from tidecube.operators import grid, ordering, spatial
from tidecube.plans.climatology import Climatology
from tidecube.queries.joins import _EDGES
from tidecube.queries.registry import N, R, query
from tidecube.queries.scalars import _DOY
from tidecube.sources.scan import raster_rows
from tidecube.sources.store import shared_folder

_RASTER = "v AS (SELECT vec_id AS lat_idx, i - 1 AS lon_idx, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def raster(t):
    return raster_rows(t.embeddings, "embedding", ["vec_id"]).select(F.col("vec_id").alias("lat_idx"), F.col("pixel").alias("lon_idx"), "value")


@query("A1_area_weighted_mean", oracle=f"SELECT l_suppkey, {R('sum(l_extendedprice * l_quantity) / sum(l_quantity)', 'value')} FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1")
def _(t):
    from tidecube.functions.stats import weighted_mean

    v = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(weighted_mean(v, F.col("l_quantity")).alias("value"))


@query("A2_static_means", oracle=f"SELECT l_suppkey, {R('-sum(l_extendedprice * l_quantity) / sum(l_quantity)', 'depth_m')}, {R('sum(l_tax * l_quantity) / sum(l_quantity)', 'slope')} FROM lineitem GROUP BY 1")
def _(t):
    from tidecube.functions.stats import weighted_mean

    w = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(weighted_mean(-F.col("l_extendedprice"), w).alias("depth_m"), weighted_mean(F.col("l_tax"), w).alias("slope"))


@query("A3_merge_frames", "env", f"SELECT h3, date, {R('sst', 'sst')}, {R('CASE WHEN h3 % 2 = 0 THEN chl END', 'chl')} FROM env", days="date")
def _(t):
    return ag.merge_frames([t.env.select("h3", "date", "sst"), t.env.where("h3 % 2 = 0").select("h3", "date", "chl")], ["h3", "date"], ["sst", "chl"])


@query("A4_effort", "effort", f"SELECT h3, date, {R('sum(hours)', 'fishing_hours')}, count(DISTINCT vessel_id) AS vessel_count FROM effort GROUP BY 1, 2", days="date")
def _(t):
    return ag.effort_by(t.effort, ["h3", "date"])


@query("A5_presence", "presence", "SELECT * FROM presence", days="date")
def _(t):
    return ag.presence(t.telemetry)


@query("A6_effort_gear_flag", "daily_effort", f"SELECT h3, date, gear_type, flag, {R('fishing_hours', 'fishing_hours')}, vessel_count FROM daily_effort", days="date")
def _(t):
    return ag.effort_by(t.effort, ["h3", "date", "gear_type", "flag"])


@query("A7_anomaly", "env", f"WITH d AS (SELECT *, {_DOY} AS doy FROM env) SELECT h3, date, {R('sst - avg(sst) OVER w', 'sst_anom')}, {R('chl - avg(chl) OVER w', 'chl_anom')} FROM d WINDOW w AS (PARTITION BY h3, doy)", days="date")
def _(t):
    return ag.anomalies(t.env.select("h3", "date", "sst", "chl"), ["sst", "chl"]).select("h3", "date", "sst_anom", "chl_anom")


@query("A7_anomaly_kept_up", "env", f"WITH d AS (SELECT *, {_DOY} AS doy FROM env) SELECT h3, date, {R('sst - avg(sst) OVER w', 'sst_anom')}, {R('chl - avg(chl) OVER w', 'chl_anom')} FROM d WINDOW w AS (PARTITION BY h3, doy)", days="date")
def _(t):
    """A7 from means that are kept up: the first years, the later ones beside them, then the last one once more as a correction."""
    env = t.env.select("h3", "date", "sst", "chl")
    lo, hi = env.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    held = Climatology(t.spark, shared_folder(t.spark, "climatology"), ["sst", "chl"])
    held.add(env, range(lo, (lo + hi) // 2 + 1))
    held.add(env, range(lo, hi + 1))
    held.add(env, [hi], correct=True)
    return held.anomalies(env).select("h3", "date", "sst_anom", "chl_anom")


@query("A8_neighbor_gradient", "env cells", f"WITH {_EDGES}, g AS (SELECT v.h3, v.date, sqrt(avg(power(v.sst - n.sst, 2))) AS g FROM env v JOIN e ON v.h3 = e.h3 JOIN env n ON n.h3 = e.neighbor AND n.date = v.date GROUP BY 1, 2) SELECT env.h3, env.date, {R('g', 'sst_grad')} FROM env LEFT JOIN g ON env.h3 = g.h3 AND env.date = g.date", days="date")
def _(t):
    return grid.neighbor_gradient(t.env.select("h3", "date", "sst"), grid.lattice_edges(t.cells), ["sst"])


def _diff(along, across, step):
    w = f"(PARTITION BY {across} ORDER BY {along})"
    return f"CASE WHEN lag(value) OVER {w} IS NULL THEN (lead(value) OVER {w} - value) / {step} WHEN lead(value) OVER {w} IS NULL THEN (value - lag(value) OVER {w}) / {step} ELSE (lead(value) OVER {w} - lag(value) OVER {w}) / (2 * {step}) END"


@query("A9_raster_slope", oracle=f"WITH {_RASTER}, g AS (SELECT lat_idx, lon_idx, {_diff('lon_idx', 'lat_idx', '(1 + lat_idx / 1000e0)')} AS gx, {_diff('lat_idx', 'lon_idx', '2e0')} AS gy FROM v) SELECT lat_idx, lon_idx, {R('sqrt(gx * gx + gy * gy)', 'slope')} FROM g")
def _(t):
    return spatial.raster_slope(raster(t), 1 + F.col("lat_idx") / 1000, F.lit(2.0)).select("lat_idx", "lon_idx", "slope")


@query("A10_support", "pred", f"SELECT species, h3, count(*) AS support_rows, {R('sum(species_use_log_pred)', 'support_sum')} FROM pred WHERE species_use_log_pred > 0 GROUP BY 1, 2")
def _(t):
    return ag.support(t.pred, "species_use_log_pred")


_USE = "b AS (SELECT species, seascape, species_use_log_pred AS u FROM pred JOIN regimes USING (h3, date))"


def _use(t):
    return t.pred.join(t.regimes, ["h3", "date"])


@query("A15_observed_use", "pred regimes", f"WITH {_USE}, g AS (SELECT species, seascape, count(*) AS rows, sum(u) AS s, avg(u) AS m, median(u) AS d FROM b WHERE u > 0 GROUP BY 1, 2) SELECT species, seascape, rows, {R('s', 'use_sum')}, {R('m', 'use_mean')}, {R('d', 'use_median')}, {R('100 * s / sum(s) OVER (PARTITION BY species)', 'use_percent')} FROM g")
def _(t):
    return ag.observed_use(_use(t), "species_use_log_pred")


@query("A16_predicted_use", "pred regimes", f"WITH {_USE}, x AS (SELECT species, seascape, 0.97e0 * u AS u FROM b) SELECT species, seascape, count(*) AS rows, {R('avg(u)', 'log_mean')}, {R('median(u)', 'log_median')}, {R('avg(greatest(exp(u) - 1, 0))', 'raw_mean')}, {R('median(greatest(exp(u) - 1, 0))', 'raw_median')}, {R('median(CASE WHEN u > 0 THEN u END)', 'positive_median')}, {R('avg(CASE WHEN u > 0 THEN 1e0 ELSE 0e0 END)', 'positive_fraction')} FROM x GROUP BY 1, 2")
def _(t):
    return ag.predicted_use(_use(t).withColumn("u", 0.97 * F.col("species_use_log_pred")), "u")


@query("A17_class_profile", "env regimes", f"SELECT seascape, count(*) AS rows, count(DISTINCT component) AS prototypes, {R('avg(sst)', 'sst_mean')}, {R('avg(chl)', 'chl_mean')}, {R('stddev_samp(sst)', 'sst_std')}, {R('stddev_samp(chl)', 'chl_std')} FROM env JOIN regimes USING (h3, date) GROUP BY 1")
def _(t):
    return ag.class_profile(t.env.join(t.regimes, ["h3", "date"]), "seascape", ["sst", "chl"], "component")


@query("A18_crosswalk", "regimes", "SELECT seascape, component, count(*) AS rows FROM regimes GROUP BY 1, 2")
def _(t):
    return ag.crosswalk(t.regimes, "seascape", "component")


@query("A18_purity", "regimes", f"WITH c AS (SELECT seascape, component, count(*) AS n FROM regimes GROUP BY 1, 2) SELECT {R('(SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY seascape)) / (SELECT sum(n) FROM c)', 'purity_a')}, {R('(SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY component)) / (SELECT sum(n) FROM c)', 'purity_b')}")
def _(t):
    return ag.purity(ag.crosswalk(t.regimes, "seascape", "component"), "seascape", "component")


@query("A19_class_balance", "regimes", f"WITH c AS (SELECT month(date) AS month, seascape, count(*) AS n FROM regimes GROUP BY 1, 2), p AS (SELECT month, n, n / sum(n) OVER (PARTITION BY month) AS p FROM c) SELECT {N('month', 'month')}, count(*) AS classes, {R('max(n) / CAST(min(n) AS DOUBLE)', 'balance_ratio')}, {R('sum(-p * ln(p)) / ln(count(*))', 'entropy')}, {R('max(p)', 'dominant_share')} FROM p GROUP BY month")
def _(t):
    return ag.class_balance(t.regimes.withColumn("month", F.month("date")), "seascape", ["month"])


for _name, _how, _sql, _only in (
    ("A20_map_non_zero_mean", "non_zero_mean", "coalesce(avg(u) FILTER (u > 0), 0)", False),
    ("A20_map_non_zero_median", "non_zero_median", "coalesce(median(u) FILTER (u > 0), 0)", False),
    ("A20_map_median", "median", "median(u)", False),
    ("A20_map_max", "max", "max(u)", False),
    ("A21_map_positive_rows_mean", "mean", "avg(u)", True),
    ("A22_map_mean_with_zeros", "mean", "avg(u)", False),
    ("A23_map_positive_mean", "positive_mean", "avg(u) FILTER (u > 0)", False),
):

    @query(_name, "pred", f"WITH x AS (SELECT h3, date, CASE WHEN h3 % 4 = 0 THEN 0 ELSE species_use_log_pred END AS u FROM pred) SELECT h3, {R(_sql, 'value')} FROM x {'WHERE u > 0' if _only else ''} GROUP BY h3")
    def _(t, how=_how, only=_only):
        return ag.map_aggregate(t.pred.select("h3", F.when(F.col("h3") % 4 == 0, 0.0).otherwise(F.col("species_use_log_pred")).alias("u")), "u", how, positive_only=only)


@query("A24_hazard", "pred", f"WITH g AS (SELECT h3, avg(species_use_log_pred) AS v FROM pred GROUP BY 1) SELECT h3, {R('v', 'value')}, {R('v + ln(1.5e0)', 'hazard')} FROM g WHERE v > 0.4e0")
def _(t):
    return ag.hazard(t.pred, "species_use_log_pred", least=0.4)


@query("A25_monthly_matrix", "pred", f"SELECT {N('month(date)', 'month')}, h3, {R('avg(u)', 'value_mean')}, {R('median(u)', 'value_median')}, {R('min(u)', 'value_min')}, {R('max(u)', 'value_max')} FROM (SELECT h3, date, species_use_log_pred AS u FROM pred WHERE species_use_log_pred > 0) GROUP BY 1, 2")
def _(t):
    u = F.col("species_use_log_pred")
    return t.pred.where(u > 0).groupBy(F.month("date").alias("month"), "h3").agg(F.avg(u).alias("value_mean"), F.median(u).alias("value_median"), F.min(u).alias("value_min"), F.max(u).alias("value_max"))


@query("A26_effort_by_cell", "effort", f"WITH x AS (SELECT h3, CASE WHEN vessel_id % 3 = 0 THEN 0 ELSE round(hours, 2) END AS h FROM effort) SELECT h3, {R('avg(h) FILTER (h > 0)', 'mean')}, {R('median(h)', 'median')}, {R('max(h)', 'max')}, {R('sum(h)', 'sum')} FROM x GROUP BY 1")
def _(t):
    from tidecube.functions.stats import map_stat

    h = F.when(F.col("vessel_id") % 3 == 0, 0.0).otherwise(F.round("hours", 2))
    return t.effort.groupBy("h3").agg(map_stat(h, "positive_mean").alias("mean"), *(map_stat(h, k).alias(k) for k in ("median", "max", "sum")))


@query("A27_effort_by_month", "effort", f"WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, sum(hours) AS s, count(DISTINCT vessel_id) AS v FROM effort GROUP BY 1) SELECT {N('month(period)', 'month')}, {R('sum(s)', 'fishing_hours')}, max(v) AS vessel_count FROM m GROUP BY 1")
def _(t):
    months = ag.effort_by_period(t.effort, F.trunc("date", "MM"))
    return months.groupBy(F.month("period").alias("month")).agg(F.sum("fishing_hours").alias("fishing_hours"), F.max("vessel_count").alias("vessel_count"))


@query("A28_daily_means", "env", "SELECT date, " + ", ".join(R(f"avg({c})", c) for c in ("sst", "wind_u10")) + " FROM env GROUP BY 1", days="date")
def _(t):
    return ag.column_means(t.env, ["date"], ["sst", "wind_u10"])


@query("A29_gradient_means", "env cells", f"WITH {_EDGES}, g AS (SELECT v.h3, v.date, sqrt(avg(power(v.sst - n.sst, 2))) AS g FROM env v JOIN e ON v.h3 = e.h3 JOIN env n ON n.h3 = e.neighbor AND n.date = v.date GROUP BY 1, 2) SELECT h3, {R('avg(g)', 'sst_grad')} FROM g GROUP BY 1")
def _(t):
    return ag.column_means(grid.neighbor_gradient(t.env.select("h3", "date", "sst"), grid.lattice_edges(t.cells), ["sst"]), ["h3"], ["sst_grad"], drop_empty=True)


@query("A30_plausibility_months", "pred", f"SELECT species, h3, {N('month(date)', 'month')}, {R('avg(plausibility)', 'plausibility')}, count(*) AS n FROM pred WHERE plausibility > 0 GROUP BY 1, 2, 3")
def _(t):
    return t.pred.where("plausibility > 0").groupBy("species", "h3", F.month("date").alias("month")).agg(F.avg("plausibility").alias("plausibility"), F.count("*").alias("n"))


@query("A30_plausibility_years", "pred", f"SELECT species, {N('year(date)', 'year')}, {R('avg(plausibility)', 'mean')}, {R('avg(plausibility) FILTER (plausibility > 0)', 'positive_mean')}, {R('median(plausibility) FILTER (plausibility > 0)', 'positive_median')}, count(*) AS rows, {N('count(*) FILTER (plausibility > 0)', 'positives')} FROM pred GROUP BY 1, 2")
def _(t):
    from tidecube.functions.stats import count_where, map_stat

    p = F.col("plausibility")
    return t.pred.groupBy("species", F.year("date").alias("year")).agg(F.avg(p).alias("mean"), map_stat(p, "positive_mean").alias("positive_mean"), map_stat(p, "positive_median").alias("positive_median"), F.count("*").alias("rows"), count_where(p > 0).alias("positives"))


@query("A32_week_ranking", "pred", f"SELECT species, {N('week(date)', 'iso_week')}, count(DISTINCT h3) AS cells, {R('avg(plausibility)', 'value_mean')}, {R('quantile_cont(plausibility, 0.9)', 'value_q')}, {R('max(plausibility)', 'value_max')}, {R('sum(plausibility)', 'value_sum')} FROM pred GROUP BY 1, 2")
def _(t):
    return ag.week_ranking(t.pred.withColumn("iso_week", F.weekofyear("date")), "plausibility", ["species", "iso_week"])


@query("A33_grid_rollup", "pred", f"SELECT h3 // 10 AS grid, species, {N('week(date)', 'iso_week')}, count(DISTINCT h3) AS cells, {R('avg(species_use_log_pred)', 'species_use_log_pred_mean')}, {R('avg(CASE WHEN plausibility > 0.5e0 THEN plausibility END)', 'display_mean')} FROM pred GROUP BY 1, 2, 3")
def _(t):
    p = t.pred.withColumn("iso_week", F.weekofyear("date")).withColumn("grid", F.expr("h3 div 10")).withColumn("display", F.when(F.col("plausibility") > 0.5, F.col("plausibility")))
    return ag.grid_means(p, ["species", "iso_week"], ["species_use_log_pred", "display"])


@query("A37_dominant_share", "regimes", f"WITH p AS (SELECT h3, seascape, sum(component_probability) AS w, sum(component_probability * seascape_distance) / nullif(sum(component_probability), 0) AS p FROM regimes WHERE seascape <> 0 GROUP BY 1, 2), k AS (SELECT *, sum(w) OVER (PARTITION BY h3) AS total, row_number() OVER (PARTITION BY h3 ORDER BY round(w, 9) DESC, seascape) AS k FROM p) SELECT h3, seascape, {R('w / total', 'class_share')}, {R('p', 'probability')} FROM k WHERE k = 1")
def _(t):
    return ag.dominant_share(t.regimes, "seascape", "component_probability", "seascape_distance", exclude_zero=True)


@query("A38_split_diagnostics", "pred", f"SELECT h3 // 10 AS block, species, count(*) AS rows, {N('count(*) FILTER (u > 0)', 'positives')}, {N('count(*) FILTER (NOT u > 0)', 'zeros')}, {R('avg(CASE WHEN u > 0 THEN 1e0 ELSE 0e0 END)', 'positive_fraction')}, {R('avg(u)', 'target_mean')}, {R('max(u)', 'target_max')} FROM (SELECT *, species_use_log_pred AS u FROM pred) GROUP BY 1, 2")
def _(t):
    return ag.split_diagnostics(t.pred.withColumn("block", F.expr("h3 div 10")), "species_use_log_pred", ["block", "species"])


@query("A39_positive_pivot", "pred", f"WITH g AS (SELECT h3, " + ", ".join(f"{N(f'count(*) FILTER (species = {chr(39)}{s}{chr(39)} AND species_use_log_pred > 0)', s)}" for s in "ANR") + " FROM pred GROUP BY 1) SELECT h3, A, N, R, A + N + R AS total, least(A, N, R) AS least FROM g")
def _(t):
    return ag.positive_pivot(t.pred, "h3", "species", "species_use_log_pred", ["A", "N", "R"])


@query("A40_metric_summary", "pred", f"SELECT species, count(*) AS folds, {R('avg(species_use_log_pred)', 'species_use_log_pred_mean')}, {R('avg(plausibility)', 'plausibility_mean')}, {R('stddev_samp(species_use_log_pred)', 'species_use_log_pred_std')}, {R('stddev_samp(plausibility)', 'plausibility_std')} FROM pred GROUP BY 1")
def _(t):
    return ag.metric_summary(t.pred, ["species"], ["species_use_log_pred", "plausibility"])


@query("A41_component_coverage", "regimes", f"SELECT component, count(*) AS rows, count(DISTINCT h3) AS h3_distinct, count(DISTINCT date) AS date_distinct, {R('avg(component_probability)', 'component_probability_mean')}, min(date) AS date_min, max(date) AS date_max FROM regimes GROUP BY 1", days="date_min date_max")
def _(t):
    return ag.coverage(t.regimes, ["component"], ["h3", "date"], ["component_probability"], ["date"])


@query("A42_regime_coverage", "regimes", f"SELECT count(*) AS rows, count(DISTINCT h3) AS h3_distinct, count(DISTINCT date) AS date_distinct, {R('avg(component_probability)', 'component_probability_mean')}, min(date) AS date_min, max(date) AS date_max, {N('count(*) FILTER (seascape IS NULL)', 'seascape_missing')} FROM regimes", days="date_min date_max")
def _(t):
    return ag.coverage(t.regimes, [], ["h3", "date"], ["component_probability"], ["date"], ["seascape"])


@query("A43_class_support", "pred regimes", f"WITH {_USE}, g AS (SELECT species, seascape, count(*) FILTER (u > 0.3e0) AS p FROM b GROUP BY 1, 2) SELECT species, count(DISTINCT seascape) AS classes, min(p) AS positives_min, {R('median(p)', 'positives_median')} FROM g GROUP BY 1")
def _(t):
    own = _use(t).withColumn("target", F.col("species_use_log_pred") - 0.3)
    return ag.class_support(own, "target")[1]


@query("A43_class_support_rows", "pred regimes", f"WITH {_USE} SELECT species, seascape, count(*) AS rows, {N('count(*) FILTER (u > 0)', 'positives')}, {R('avg(u)', 'target_mean')} FROM b GROUP BY 1, 2")
def _(t):
    return ag.class_support(_use(t), "species_use_log_pred")[0]


@query("A44_profile", oracle=f"SELECT {N('count(*)', 'rows')}, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows, CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date, {R('0', 'l_quantity_missing')}, {R('min(l_quantity)', 'l_quantity_min')}, {R('max(l_quantity)', 'l_quantity_max')}, {R('avg(l_quantity)', 'l_quantity_mean')} FROM lineitem", days="first_date last_date")
def _(t):
    return ag.profile(t.lineitem.withColumn("date", F.to_date("l_shipdate")), ["l_orderkey", "l_linenumber"], ["l_quantity"], "date")


@query("A45_ready", oracle="SELECT n_name FROM nation")
def _(t):
    return ag.ready(t.nation, "nation").select("n_name")


_RANKS = "x AS (SELECT round(sst, 6) AS a, round(chl, 6) AS b FROM env), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM x)"


@query("A46_spearman", "env", f"WITH {_RANKS} SELECT 'sst' AS a, 'chl' AS b, {R('corr(ra, rb)', 'correlation')}, count(*) AS n FROM k")
def _(t):
    return ag.correlation(t.env.select(F.round("sst", 6).alias("sst"), F.round("chl", 6).alias("chl")), ["sst", "chl"])


@query("A46_pearson", "env", f"SELECT 'sst' AS a, 'ssh' AS b, {R('corr(sst, ssh)', 'correlation')}, count(*) AS n FROM env")
def _(t):
    return ag.correlation(t.env, ["sst", "ssh"], "pearson")


@query("A47_binned_relationship", "env", f"WITH x AS (SELECT round(ssh, 6) AS x, sst AS y FROM env), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{', '.join(str(k / 20) for k in range(21))}]))) AS e FROM x), b AS (SELECT x, y, greatest(len(list_filter(e, lambda q: q < x)) - 1, 0) AS bin FROM x, e) SELECT {N('bin', 'bin')}, {R('avg(x)', 'x_mean')}, {R('avg(y)', 'y_mean')}, count(*) AS rows FROM b GROUP BY 1")
def _(t):
    return ag.binned_relationship(t.env.select(F.round("ssh", 6).alias("x"), F.col("sst").alias("y")), "x", "y", 20)


_YP = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p, l_orderkey, l_linenumber, l_partkey FROM lineitem"


def _yp(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), "l_orderkey", "l_linenumber", "l_partkey")


@query("A48_regression_metrics", oracle=f"WITH x AS ({_YP}), m AS (SELECT avg(y) AS my FROM x) SELECT {R('1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my))', 'r2')}, {R('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {R('avg(abs(y - p))', 'mae')}, {R('avg(p - y)', 'bias')}, {R('corr(y, p)', 'pearson')}, count(*) AS n FROM x, m")
def _(t):
    return ag.metrics(_yp(t), "y", "p")


@query("A49_hotspots", oracle=f"WITH x AS ({_YP}), h AS (SELECT quantile_cont(y, 0.9) AS threshold FROM x), m AS (SELECT x.*, y >= threshold AS hot, threshold, row_number() OVER (ORDER BY p DESC, y, l_orderkey, l_linenumber, l_partkey) AS k FROM x, h), n AS (SELECT count(*) FILTER (hot) AS n FROM m) SELECT {R('max(threshold)', 'threshold')}, max(n) AS k, count(*) FILTER (hot AND k <= n) AS hits, {R('count(*) FILTER (hot AND k <= n) / max(n)', 'recall')}, {R('sum(y) FILTER (k <= n) / sum(y)', 'captured_fraction')} FROM m, n")
def _(t):
    return ag.hotspots(_yp(t), "y", "p", ["y", "l_orderkey", "l_linenumber", "l_partkey"])


@query("P30_robust_range", "env", f"SELECT {R('quantile_cont(wind_u10, 0.005)', 'lo')}, {R('quantile_cont(wind_u10, 0.995)', 'hi')} FROM env")
def _(t):
    return ag.robust_range(t.env, "wind_u10")


@query("A50_histogram", oracle=f"WITH q AS (SELECT -quantile_cont(abs(l_quantity - 25), 0.995) AS lo, quantile_cont(abs(l_quantity - 25), 0.995) AS hi FROM lineitem) SELECT {N('least(floor((l_quantity - 25 - lo) * 30 / (hi - lo)), 29)', 'bin')}, count(*) AS rows FROM lineitem, q WHERE l_quantity - 25 BETWEEN lo AND hi GROUP BY 1")
def _(t):
    return ag.histogram(t.lineitem.select((F.col("l_quantity") - 25).alias("v")), "v", 30, symmetric=True)


@query("A51_colour_breaks", oracle=f"WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM lineitem WHERE l_extendedprice > 1e-6) SELECT {N('i - 1', 'step')}, {R('q[i]', 'value')} FROM (SELECT q, unnest(range(1, 6)) AS i FROM q)")
def _(t):
    return t.spark.createDataFrame(list(enumerate(ag.colour_breaks(t.lineitem, "l_extendedprice", 4))), "step long, value double")


@query("A52_presence_totals", "presence", f"SELECT h3, {N('sum(presence_count)', 'total')} FROM presence WHERE species = 'click' GROUP BY 1")
def _(t):
    return ag.totals(t.presence, "presence_count", ["h3"], species="click")


@query("A53_density", oracle=f"SELECT {N('floor(l_extendedprice / 5000)', 'x_bin')}, {N('floor(l_quantity * 1500 / 5000)', 'y_bin')}, count(*) AS rows FROM lineitem GROUP BY 1, 2")
def _(t):
    return ag.density(_yp(t), "y", "p", 5000)


for _name, _score, _asc, _skip in (("W1_dominant_component", "component_probability", False, ()), ("W3_dominant_class", "seascape_distance", True, (0, 29))):
    _cls = "component" if _name[1] == "1" else "seascape"
    _where = f"WHERE {_cls} NOT IN ({', '.join(map(str, _skip))})" if _skip else ""

    @query(_name, "regimes", f"WITH g AS (SELECT h3, {_cls}, count(*) AS days, round(avg({_score}), 9) AS s FROM regimes {_where} GROUP BY 1, 2) SELECT h3, {_cls}, days, {R('s', 'mean_score')} FROM (SELECT *, row_number() OVER (PARTITION BY h3 ORDER BY days DESC, s {'ASC' if _asc else 'DESC'}, {_cls}) AS k FROM g) WHERE k = 1")
    def _(t, cls=_cls, score=_score, asc=_asc, skip=_skip):
        return ordering.dominant_class(t.regimes, ["h3"], cls, score, asc, skip)


@query("W2_dominant_by_month", "regimes", f"WITH g AS (SELECT h3, month(date) AS month, component, count(*) AS days, round(avg(component_probability), 9) AS s FROM regimes GROUP BY 1, 2, 3) SELECT h3, {N('month', 'month')}, component, days, {R('s', 'mean_score')} FROM (SELECT *, row_number() OVER (PARTITION BY h3, month ORDER BY days DESC, s DESC, component) AS k FROM g) WHERE k = 1")
def _(t):
    return ordering.dominant_class(t.regimes.withColumn("month", F.month("date")), ["h3", "month"], "component", "component_probability")


@query("W4_top_one", oracle=f"SELECT o_orderpriority, o_orderkey, {R('o_totalprice', 'o_totalprice')} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(t):
    return ordering.top_one(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("W5_share_of_total", "pred regimes", f"WITH {_USE}, g AS (SELECT species, seascape, sum(u) AS s FROM b GROUP BY 1, 2) SELECT species, seascape, {R('100 * s / sum(s) OVER (PARTITION BY species)', 'percent')} FROM g")
def _(t):
    g = _use(t).groupBy("species", "seascape").agg(F.sum("species_use_log_pred").alias("s"))
    return ordering.share_of_total(g, "s", ["species"], "percent", 100.0).select("species", "seascape", "percent")


@query("W6_group_mean", "env", f"SELECT h3, date, {R('avg(sst) OVER (PARTITION BY h3)', 'sst_mean')} FROM env", days="date")
def _(t):

    return t.env.select("h3", "date").join(t.env.groupBy("h3").agg(F.avg("sst").alias("sst_mean")), "h3")


@query("W9_row_differences", oracle=f"WITH {_RASTER} SELECT lat_idx, lon_idx, {R('lead(value) OVER (PARTITION BY lat_idx ORDER BY lon_idx) - lag(value) OVER (PARTITION BY lat_idx ORDER BY lon_idx)', 'difference')} FROM v")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("lat_idx").orderBy("lon_idx")
    return raster(t).select("lat_idx", "lon_idx", (F.lead("value").over(w) - F.lag("value").over(w)).alias("difference"))


@query("O1_sorted_output", "presence", "SELECT * FROM presence", days="date")
def _(t):
    return t.presence.sortWithinPartitions("date", "h3", "species")


@query("O2_time_split", oracle=f"SELECT l_orderkey, {N('l_linenumber', 'l_linenumber')}, l_partkey, l_suppkey, row_number() OVER (ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= CAST(floor(0.75 * (SELECT count(*) FROM lineitem)) AS BIGINT) AS is_first FROM lineitem")
def _(t):
    own = t.lineitem.withColumn("date", F.to_date("l_shipdate"))
    return ordering.first_part(own, "date", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 0.75).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_first")


@query("O3_top_n_reversed", oracle=f"SELECT * FROM (SELECT p_partkey, {R('p_retailprice', 'p_retailprice')} FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) ORDER BY p_retailprice, p_partkey DESC")
def _(t):
    """A top list is the feature."""
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).orderBy("p_retailprice", F.desc("p_partkey"))


@query("O4_multi_key_order", oracle=f"SELECT o_orderstatus, o_orderpriority, {R('avg(o_totalprice)', 'mean')} FROM orders GROUP BY 1, 2 ORDER BY 1 DESC, 3")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean")).orderBy(F.desc("o_orderstatus"), "mean")
