"""Days, seasons and weeks. The session's time zone is UTC."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc_day(c: Column) -> Column:
    """The UTC day of a timestamp; one without a zone is taken as UTC."""
    return F.to_date(c)


def utc_day_of_nanoseconds(c: Column) -> Column:
    return F.to_date(F.timestamp_micros(F.floor(c / 1000)))


def us_timestamp(c: Column) -> Column:
    """'M/d/yy H:mm', null where it cannot be read. Two-digit years are 2000 to 2099."""
    return F.try_to_timestamp(c, F.lit("M/d/yy H:mm"))


def is_leap(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366


def adjusted_doy(d: Column) -> Column:
    """Day of the year from 1 to 365: after February 28 a leap year's days count one less, so February 29 shares 59."""
    n = F.dayofyear(d)
    return (n - F.when(is_leap(d) & (n > 59), 1).otherwise(0)).cast("long")


def season(doy: Column, first_is_zero: bool = True) -> tuple[Column, Column]:
    """(sine, cosine) of the year's angle; features start at angle 0 on the first day, the lookup table at one day's angle."""
    angle = (doy - (1 if first_is_zero else 0)) * (2 * math.pi / 365)
    return F.sin(angle), F.cos(angle)


def season_lookup(spark: SparkSession) -> DataFrame:
    """adjusted_doy 1 to 365 with the lookup table's sine and cosine."""
    days = spark.range(1, 366).withColumnRenamed("id", "adjusted_doy")
    s, c = season(F.col("adjusted_doy"), first_is_zero=False)
    return days.select("adjusted_doy", s.alias("doy_sin"), c.alias("doy_cos"))


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("long")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d).cast("long")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def year_ranges(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(year, first, last): the years that [start, end] touches, clipped to it."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    y = spark.range(1).select(F.explode(F.sequence(F.year(s), F.year(e))).alias("year"))
    return y.select("year", F.greatest(F.make_date("year", F.lit(1), F.lit(1)), s).alias("first"), F.least(F.make_date("year", F.lit(12), F.lit(31)), e).alias("last"))


def parse_years(spec: str, available: list[int]) -> list[int]:
    """'all', '2022', '2014-2023' or a list of those, as sorted distinct years."""
    if spec.strip().lower() == "all":
        return sorted(set(available))
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        if not (m := re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", part)):
            raise ValueError(f"no years in {part!r}")
        lo, hi = int(m[1]), int(m[2] or m[1])
        if lo > hi:
            raise ValueError(f"{part!r} runs backwards")
        found.update(range(lo, hi + 1))
    if not found:
        raise ValueError("no years given")
    return sorted(found)
