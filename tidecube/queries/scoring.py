"""H and L6: hybrid scoring on synthetic scores."""

from pyspark.sql import functions as F

from tidecube.operators import aggregates as ag
from tidecube.plans import scoring
from tidecube.queries.registry import R, query

_CUTS = {"A": 0.9, "N": 0.5}
_CUT = "CASE species WHEN 'A' THEN 0.9e0 WHEN 'N' THEN 0.5e0 ELSE 0e0 END"
_GATE = f"(1 - {_CUT} * (1 - plausibility))"
_SUPPORT = "s AS (SELECT species, h3, CAST(count(*) AS DOUBLE) AS support FROM pred WHERE species_use_log_pred > 0.6e0 GROUP BY 1, 2), b AS (SELECT pred.*, coalesce(support, 0) AS support FROM pred LEFT JOIN s ON pred.species = s.species AND pred.h3 = s.h3)"


def supported(t):
    own = t.pred.withColumn("__t", F.when(F.col("species_use_log_pred") > 0.6, F.col("species_use_log_pred")).otherwise(0.0))
    return scoring.with_support(t.pred, ag.support(own, "__t"))


@query("H1_prediction_base", "env daily_effort", f"WITH e AS (SELECT h3, date, sum(fishing_hours) AS h, sum(vessel_count) AS v FROM daily_effort GROUP BY 1, 2) SELECT env.h3, env.date, {R('sst', 'sst')}, {R('coalesce(h, 0)', 'fishing_hours')}, CAST(coalesce(v, 0) AS BIGINT) AS vessel_count, {R('CASE WHEN h * v > 0 THEN ln(1 + h * v) ELSE 0 END', 'fishing_activity_log')} FROM env LEFT JOIN e ON env.h3 = e.h3 AND env.date = e.date", days="date")
def _(t):
    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    return scoring.base(t.env.select("h3", "date", "sst"), e)


@query("H2_species_fan_out", "env", f"SELECT h3, date, species, {R('greatest((sst - 25) * k, 0)', 'score')} FROM env CROSS JOIN (VALUES ('A', 1e0), ('N', -1e0)) s(species, k)", days="date")
def _(t):
    k = F.when(F.col("species") == "A", 1.0).otherwise(-1.0)
    return scoring.fan_out(t.env.select("h3", "date", "sst"), ["A", "N"]).select("h3", "date", "species", F.greatest((F.col("sst") - 25) * k, F.lit(0.0)).alias("score"))


for _mode, _sql in (("constant", "0.8e0"), ("spatial", "greatest(0.1e0, least(0.9e0, support / (support + 5)))"), ("conditional", "CASE WHEN support >= 1 THEN 0.8e0 ELSE 0.1e0 END")):

    @query(f"H3_alpha_{_mode}", "pred", f"WITH {_SUPPORT} SELECT h3, date, species, {R(_sql, 'alpha')} FROM b", days="date")
    def _(t, mode=_mode):
        return supported(t).select("h3", "date", "species", scoring.alpha(mode, F.col("support")).alias("alpha"))


@query("H4_support", "pred", f"WITH {_SUPPORT} SELECT h3, date, species, {R('support', 'support')} FROM b", days="date")
def _(t):
    return supported(t).select("h3", "date", "species", "support")


@query("H5_gate", "pred", f"SELECT h3, date, species, {R(_GATE, 'gate')} FROM pred", days="date")
def _(t):
    return t.pred.select("h3", "date", "species", scoring.gate(F.col("plausibility"), F.col("species"), _CUTS).alias("gate"))


@query("H6_gated_log", "pred", f"SELECT h3, date, species, {R(f'ln(1 + greatest(exp(species_use_log_pred) - 1, 0) * {_GATE})', 'use_log')} FROM pred", days="date")
def _(t):
    return t.pred.select("h3", "date", "species", scoring.gated_log(F.col("species_use_log_pred"), scoring.gate(F.col("plausibility"), F.col("species"), _CUTS)).alias("use_log"))


_HYBRID = f"WITH {_SUPPORT}, e AS (SELECT h3, date, sum(fishing_hours) AS h, sum(vessel_count) AS v FROM daily_effort GROUP BY 1, 2), x AS (SELECT b.*, greatest(0.1e0, least(0.9e0, support / (support + 5))) AS alpha, {_GATE} AS gate, CASE WHEN h * v > 0 THEN ln(1 + h * v) ELSE 0e0 END AS effort FROM b LEFT JOIN e ON b.h3 = e.h3 AND b.date = e.date), u AS (SELECT *, ln(1 + greatest(exp(alpha * species_use_log_pred + (1 - alpha) * 0.9713177e0 * plausibility) - 1, 0) * gate) AS use_log FROM x)"


@query("H7_hybrid_risk", "pred daily_effort", f"{_HYBRID} SELECT h3, date, species, {R('use_log', 'species_use_log_pred')}, {R('alpha', 'hybrid_alpha')}, {R('u.species_use_log_pred', 'ml_log')}, {R('plausibility', 'plausibility')}, {R('gate', 'plausibility_gate')}, {R('effort', 'fishing_activity_log')}, {R('use_log + effort', 'risk_log_pred')} FROM u", days="date")
def _(t):
    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    scores = supported(t).withColumn("ml_log", F.col("species_use_log_pred")).withColumn("density_log", 0.9713177 * F.col("plausibility")).drop("species_use_log_pred")
    return scoring.product(scoring.hybrid(scoring.base(scores, e), "spatial", _CUTS), "hybrid")


@query("H8_single_product", "pred", f"SELECT h3, date, species, {R('species_use_log_pred', 'species_use_log_pred')}, {R('plausibility', 'fishing_activity_log')}, {R('species_use_log_pred + plausibility', 'risk_log_pred')} FROM pred", days="date")
def _(t):
    own = t.pred.withColumn("fishing_activity_log", F.col("plausibility")).withColumn("risk_log_pred", F.col("species_use_log_pred") + F.col("plausibility"))
    return scoring.product(own, "single")


_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{n}' AS model, h3, date, species, {R(c, 'species_use_log_pred')}, {R(f'{c} + effort', 'risk_log_pred')} FROM u" for m, n, c in (("single", "ml", "u.species_use_log_pred"), ("all", "ml", "u.species_use_log_pred"), ("all", "density", "0.9713177e0 * plausibility"), ("hybrid", "hybrid", "use_log")))


@query("H9_prediction_modes", "pred daily_effort", f"{_HYBRID} {_MODES}", days="date")
def _(t):
    from functools import reduce

    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    own = scoring.base(supported(t).withColumnRenamed("species_use_log_pred", "ml"), e)
    known = {"ml": F.col("ml"), "density": 0.9713177 * F.col("plausibility")}
    one = lambda mode: scoring.predictions(own, mode, known, active="ml", blend=("ml", "density"), cuts=_CUTS).select(F.lit(mode).alias("mode"), "*")
    return reduce(lambda a, b: a.unionByName(b), map(one, ("single", "all", "hybrid")))


@query("H10_class_values", "regimes", f"SELECT h3, date, seascape, {R('CASE WHEN seascape < 20 THEN seascape / 10e0 ELSE 0e0 END', 'class_value')} FROM regimes", days="date")
def _(t):
    values = t.spark.createDataFrame([(k, k / 10) for k in range(20)], "seascape long, value double")
    return scoring.class_values(t.regimes.select("h3", "date", "seascape"), values)


@query("L6_plausibility", oracle=f"SELECT l_orderkey, {R('greatest(0e0, least(1e0, (l_extendedprice - 5000) / 59321e0))', 'plausibility')}, {R('0e0', 'flat')} FROM lineitem")
def _(t):
    v = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", scoring.plausibility(v, F.lit(5000.0), F.lit(64321.0)).alias("plausibility"), scoring.plausibility(v, F.lit(1.0), F.lit(1.0)).alias("flat"))


@query("A35_gate_sensitivity", "pred", f"WITH g AS (SELECT h3, species, plausibility AS p, ln(1 + greatest(exp(species_use_log_pred) - 1, 0) * (1 - 0.1e0 * (1 - plausibility))) AS u FROM pred), n AS (SELECT h3, species, ln(1 + greatest(exp(u) - 1, 0) / (1 - 0.1e0 * (1 - p)) * (1 - 0.6e0 * (1 - p))) AS v FROM g) SELECT species, h3, {R('coalesce(avg(v) FILTER (v > 1e-9), 0)', 'value')} FROM n GROUP BY 1, 2")
def _(t):
    p = F.col("plausibility")
    gated = t.pred.select("h3", "species", "plausibility", scoring.gated_log(F.col("species_use_log_pred"), 1 - 0.1 * (1 - p)).alias("u"))
    v = scoring.regated(F.col("u"), p, 0.1, 0.6)
    return gated.select("h3", "species", F.when(v > 1e-9, v).otherwise(0.0).alias("v")).groupBy("species", "h3").agg(F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("value"))
