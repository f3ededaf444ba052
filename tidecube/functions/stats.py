"""Aggregate expressions. What a mean does with values that are not positive is always said by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(v: Column) -> Column:
    """v where it is above 0, else null."""
    return F.when(v > 0, v)


def map_stat(v: Column, how: str) -> Column:
    """mean, median, max, min over all values; non_zero_<stat> over the positive ones, 0 if there are none; positive_<stat> the same but null."""
    plain = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}
    kind, _, stat = how.rpartition("_")
    if kind == "non_zero":
        return F.coalesce(plain[stat](positive(v)), F.lit(0.0))
    return plain[stat](positive(v)) if kind == "positive" else plain[how](v)


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


def weighted_mean(v: Column, w: Column) -> Column:
    """Over the rows where both are finite; weights renormalise by themselves. Null if there are none."""
    ok = v.isNotNull() & w.isNotNull() & ~F.isnan(v) & ~F.isnan(w) & (F.abs(v) < float("inf"))
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def normalised_entropy(p: Column) -> Column:
    """Of a group's shares: 0 to 1, 0 for a single class."""
    return F.coalesce(F.try_divide(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)), F.nullif(F.ln(F.count("*").cast("double")), F.lit(0.0))), F.lit(0.0))


def regression_metrics(y: str, p: str) -> list[Column]:
    """r2, rmse, mae, bias, pearson and n in one pass; r2 is null if y doesn't vary."""
    a, b = F.col(y), F.col(p)
    n, sse = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)), F.sum((a - b) * (a - b))
    sst = F.var_pop(F.when(b.isNotNull(), a)) * n
    return [(1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), F.avg(F.abs(a - b)).alias("mae"), F.avg(b - a).alias("bias"), F.corr(y, p).alias("pearson"), n.alias("n")]
