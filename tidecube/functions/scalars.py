"""Column expressions of the feature, target and display steps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def log1p(c: Column) -> Column:
    """ln(1 + c); null from -1 down."""
    return F.when(c > -1, F.log1p(c))


def sphere(lat: Column, lon: Column) -> dict[str, Column]:
    """Sine and cosine of latitude and longitude in degrees."""
    a, o = F.radians(lat), F.radians(lon)
    return {"lat_sin": F.sin(a), "lat_cos": F.cos(a), "lon_sin": F.sin(o), "lon_cos": F.cos(o)}


def product_index(a: Column, b: Column) -> Column:
    """Presence times individuals, or hours times vessels."""
    return a * b


def inverse_log_target(c: Column) -> Column:
    """Back from ln(1 + y), never below 0."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def guarded_log1p(c: Column) -> Column:
    """ln(1 + c) above 0, else (null too) 0."""
    return F.when(c > 0, F.log1p(c)).otherwise(0.0)


def category(c: Column, default: str = "unknown") -> Column:
    """Trimmed text; null, empty and NA in any case become the default."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when((t == "") | (F.upper(t) == "NA"), F.lit(default)).otherwise(t)


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def above_or_null(c: Column, gate: Column, threshold: float) -> Column:
    """c where gate is strictly above the threshold, else null: the displayed value."""
    return F.when(gate > threshold, c)


def zero_below(c: Column, confidence: Column, least: float) -> Column:
    return F.when(confidence >= least, c).otherwise(0.0)


def is_low(c: Column) -> Column:
    """Null counts as 0."""
    return F.coalesce(c, F.lit(0.0)) <= 0


def mapped(c: Column, values: Mapping[str, object], default: object) -> Column:
    """The value for c, the default for null and unknown keys."""
    if not values:
        return F.lit(default)
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def dominance(share: Column, first: str, second: str, high: float = 0.8, low: float = 0.2) -> Column:
    """Which of two kinds a group belongs to, by the first one's share."""
    return F.when(share.isNull(), "none").when(share >= high, f"{first}-dominated").when(share <= low, f"{second}-dominated").otherwise("mixed")


def share_of(c: Column, top: Column, power: float = 1.0) -> Column:
    """c / top within 0 and 1, to a power; 0 if top isn't positive."""
    return F.when(top > 0, F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / top)), F.lit(power))).otherwise(0.0)


def one_hot(c: Column, kinds: Sequence[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each kind; unknown kinds and null have zeros everywhere."""
    return {f"{prefix}{k}": F.coalesce((c == k).cast("long"), F.lit(0)) for k in kinds}


def buffered_box(lon_min: float, lat_min: float, lon_max: float, lat_max: float, km: float) -> tuple[float, float, float, float]:
    """The box in degrees with km more on each side, 111 km a degree, longitudes widened at the middle latitude."""
    d_lat = km / 111.0
    d_lon = km / (111.0 * math.cos(math.radians((lat_min + lat_max) / 2)))
    return lon_min - d_lon, lat_min - d_lat, lon_max + d_lon, lat_max + d_lat


def box_ring(box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
