"""Hybrid scoring: model use blended by support, gated by plausibility, plus effort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.functions import scalars
from tidecube.operators.joins import attach, for_each, zero_fill

#: A blend's constant; the support at which a cell counts half; the bounds of a support blend.
ALPHA, HALF_SUPPORT, ALPHA_BOUNDS = 0.8, 5.0, (0.1, 0.9)


def base(features: DataFrame, effort: DataFrame) -> DataFrame:
    """Features with observed effort (0 where none) and the logarithm of hours times vessels."""
    own = zero_fill(features, effort.select("h3", "date", "fishing_hours", "vessel_count"), ["h3", "date"])
    return own.withColumn("fishing_activity_log", scalars.guarded_log1p(F.col("fishing_hours") * F.col("vessel_count")))


def fan_out(df: DataFrame, species: Sequence[str]) -> DataFrame:
    """Every row for each species that there is a model for."""
    return for_each(df, "species", species)


def alpha(mode: str, support: Column | None = None) -> Column:
    """constant; spatial: support / (support + 5) within bounds; conditional: the constant where there is any support, else the lower bound."""
    lo, hi = ALPHA_BOUNDS
    if mode == "constant":
        return F.lit(ALPHA)
    if mode == "spatial":
        return F.greatest(F.lit(lo), F.least(F.lit(hi), support / (support + HALF_SUPPORT)))
    if mode == "conditional":
        return F.when(support >= 1, ALPHA).otherwise(lo)
    raise ValueError(f"no blend {mode!r}")


def with_support(df: DataFrame, support: DataFrame) -> DataFrame:
    """Positive rows of the species in the cell, 0 if none."""
    return zero_fill(df, support.select("species", "h3", F.col("support_rows").cast("double").alias("support")), ["species", "h3"])


def plausibility(logp: Column, lo: Column, hi: Column) -> Column:
    """Log density between two anchors, 0 to 1; 0 if they do not rise."""
    return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logp - lo) / F.nullif(hi - lo, F.lit(0.0))))).otherwise(0.0)


def gate(p: Column, species: Column, cuts: Mapping[str, float]) -> Column:
    """1 - cut * (1 - plausibility); species without a cut are not gated."""
    return 1 - scalars.mapped(species, cuts, 0.0) * (1 - p)


def gated_log(use_log: Column, gate: Column) -> Column:
    """The gate applied to raw use, back in logarithms."""
    return F.log1p(scalars.inverse_log_target(use_log) * gate)


def regated(use_log: Column, p: Column, old_cut: float, new_cut: float) -> Column:
    """A gated logarithm with its cut undone and another one put in its place."""
    raw = scalars.inverse_log_target(use_log)
    undone = F.try_divide(raw, 1 - F.lit(old_cut) * (1 - p))
    return F.log1p(F.coalesce(undone, F.lit(0.0)) * (1 - F.lit(new_cut) * (1 - p)))


def hybrid(df: DataFrame, mode: str, cuts: Mapping[str, float], ml: str = "ml_log", density: str = "density_log", p: str = "plausibility") -> DataFrame:
    """df (with support, two log scores, plausibility, fishing_activity_log) with alpha, gate, use and risk."""
    blended = F.col("hybrid_alpha") * F.col(ml) + (1 - F.col("hybrid_alpha")) * F.col(density)
    out = df.withColumn("hybrid_alpha", alpha(mode, F.col("support"))).withColumn("plausibility_gate", gate(F.col(p), F.col("species"), cuts))
    return out.withColumn("species_use_log_pred", gated_log(blended, F.col("plausibility_gate"))).withColumn("risk_log_pred", F.col("species_use_log_pred") + F.col("fishing_activity_log"))


#: Columns that each kind of product returns besides h3, date and species.
PRODUCTS = {
    "single": ("species_use_log_pred", "fishing_activity_log", "risk_log_pred"),
    "hybrid": ("species_use_log_pred", "hybrid_alpha", "ml_log", "plausibility", "plausibility_gate", "fishing_activity_log", "risk_log_pred"),
}


def product(df: DataFrame, kind: str) -> DataFrame:
    """The columns of one kind of product; ``all`` is the hybrid's with everything else that df has."""
    if kind == "all":
        return df
    if kind not in PRODUCTS:
        raise ValueError(f"no product {kind!r}")
    return df.select("h3", "date", "species", *PRODUCTS[kind])


def predictions(own: DataFrame, mode: str, models: Mapping[str, Column], active: str | None = None, blend: tuple[str, str] | None = None, alpha_mode: str = "spatial", cuts: Mapping[str, float] | None = None) -> DataFrame:
    """(model, h3, date, species, use, risk) of ``own`` (with fishing_activity_log) under a mode of prediction.

    ``models`` gives every model's log score. ``single``: the active model; ``all``: every model, in one pass over the
    rows; ``hybrid``: the two models of ``blend`` blended by support and gated by plausibility, which ``own`` then needs.
    """
    keys = ["h3", "date", "species"]
    if mode == "hybrid":
        scores = own.withColumns({"ml_log": models[blend[0]], "density_log": models[blend[1]]})
        return hybrid(scores, alpha_mode, cuts or {}).select(F.lit("hybrid").alias("model"), *keys, "species_use_log_pred", "risk_log_pred")
    if mode not in ("single", "all"):
        raise ValueError(f"no mode {mode!r}")
    names = [active] if mode == "single" else list(models)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), models[n].cast("double").alias("species_use_log_pred")) for n in names)))
    fanned = own.select(*keys, "fishing_activity_log", each.alias("m")).select("m.model", *keys, "m.species_use_log_pred", "fishing_activity_log")
    return fanned.withColumn("risk_log_pred", F.col("species_use_log_pred") + F.col("fishing_activity_log")).drop("fishing_activity_log")


def class_values(df: DataFrame, values: DataFrame, cls: str = "seascape", name: str = "class_value") -> DataFrame:
    """df with the value of its class, 0 for a missing one."""
    return attach(df, values.select(cls, F.col("value").alias(name)), [cls]).withColumn(name, F.coalesce(name, F.lit(0.0)))
