"""Weekly products: by ISO year and week, one year's sequence, the climatology over years, and risk by gear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.functions import dates
from tidecube.functions.scalars import above_or_null


def with_iso_week(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("iso_year", dates.iso_year(F.col(date))).withColumn("iso_week", dates.iso_week(F.col(date)))


def weekly_by_year(pred: DataFrame, use: str = "species_use_log_pred", baseline: float = 0.5, years: tuple[int, int] | None = None, threshold: float = 0.0) -> DataFrame:
    """Days, mean use, mean use plus the baseline, and that value for display (null where the mean use is not above the threshold)."""
    own = with_iso_week(pred).groupBy("h3", "species", "iso_year", "iso_week").agg(F.count("*").alias("n_days"), F.avg(use).alias("use_mean"), F.avg(F.col(use) + F.log1p(F.lit(baseline))).alias("latent_mean"))
    if years:
        own = own.where(F.col("iso_year").between(*years))
    return own.withColumn("display_mean", above_or_null(F.col("latent_mean"), F.col("use_mean"), threshold))


def sequence(weekly: DataFrame, year: int) -> DataFrame:
    """One year's weeks in order."""
    return weekly.where(F.col("iso_year") == year).orderBy("iso_week", "species", "h3")


def climatology(weekly: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Over the years of each week: years, days, and means of the weekly means, each year counting the same."""
    out = weekly.groupBy("h3", "species", "iso_week").agg(F.count_distinct("iso_year").alias("n_years"), F.sum("n_days").alias("n_days"), F.avg("use_mean").alias("use_mean"), F.avg("latent_mean").alias("latent_mean"))
    return out.withColumn("display_mean", above_or_null(F.col("latent_mean"), F.col("use_mean"), threshold))


def week_summary(table: DataFrame) -> DataFrame:
    """Cells, displayed cells, mean and greatest latent value of each species and week."""
    return table.groupBy("species", "iso_week").agg(F.count("*").alias("cells"), F.count("display_mean").alias("displayed"), F.avg("latent_mean").alias("latent_mean"), F.max("latent_mean").alias("latent_max"))


def gear_risk(pred: DataFrame, effort: DataFrame, pairs: DataFrame, use: str = "species_use_log_pred") -> DataFrame:
    """Weekly risk for pairs (species, gear_type): predictions meet the effort of the gears they are paired with, by cell and day.

    effort: h3, date, gear_type, fishing_hours, vessel_count. Risk is use plus ln(1 + hours * vessels).
    """
    activity = F.col("fishing_hours") * F.col("vessel_count")
    met = pred.join(pairs, "species").join(effort, ["h3", "date", "gear_type"]).withColumn("activity", activity).withColumn("risk", F.col(use) + F.log1p(activity))
    return with_iso_week(met).groupBy("h3", "iso_year", "iso_week", "species", "gear_type").agg(
        F.count("*").alias("n_days"), F.avg(use).alias("use_mean"), F.sum("activity").alias("activity"), F.coalesce(F.avg(F.when(F.col(use) > 0, F.col("risk"))), F.lit(0.0)).alias("risk_mean")
    )


def flag_activity(effort: DataFrame, year: int) -> DataFrame:
    """Weekly hours and vessels by flag in one year, where there were any hours."""
    own = with_iso_week(effort).where(F.col("iso_year") == year).groupBy("flag", "iso_year", "iso_week").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    return own.where(F.col("fishing_hours") > 0)


def daily_gear_risk(pred: DataFrame, effort: DataFrame, species: str, gear: str, use: str = "species_use_log_pred") -> DataFrame:
    """One species and gear by cell and day."""
    own = effort.where(F.col("gear_type") == gear).groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    return pred.where(F.col("species") == species).join(own, ["h3", "date"]).select("h3", "date", F.col(use).alias("use"), "fishing_hours", "vessel_count", (F.col(use) + F.log1p(F.col("fishing_hours") * F.col("vessel_count"))).alias("risk"))
