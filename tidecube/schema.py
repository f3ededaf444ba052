"""Table contracts: required columns, and values that are missing in one way only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("h3", "date")
# The columns that models are fitted to, in their order.
DYNAMIC = ("sst", "ssh", "wind_speed", "chl_log", "sst_anom", "ssh_anom", "wind_speed_anom", "chl_log_anom", "sst_grad", "ssh_grad", "chl_log_grad", "doy_sin", "doy_cos")
STATIC = ("depth_m", "slope", "dist_coast_m", "lat_sin", "lat_cos", "lon_sin", "lon_cos")
FEATURES = DYNAMIC + STATIC


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def nan_inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every float column (or those named) with null for NaN and infinities: the scan's rule, before any mean or comparison."""
    own = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (columns is None or f.name in columns)}
    return df.select(*(finite(F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing), most missing first; one pass over df."""
    sums = df.agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).cast("long").alias(c) for c in columns))
    return sums.unpivot([], list(columns), "column", "missing").orderBy(F.desc("missing"), "column")


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all there and finite."""
    return nan_inf_to_null(df, columns).na.drop(subset=list(columns))


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df if no column has a gap, else an error that names those that do. One aggregate."""
    got = nan_inf_to_null(df, columns).agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns)).first()
    if gaps := [c for c in columns if got[c]]:
        raise ValueError(f"missing values in {', '.join(gaps)}")
    return df
