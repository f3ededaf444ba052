"""Aggregates of the cube: activity, presence, climatologies, classes, profiles, binning and accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.functions import dates
from tidecube.functions.stats import count_where, map_stat, normalised_entropy, positive, regression_metrics
from tidecube.operators.ordering import average_rank, quantiles, share_of_total, up_to, with_quantiles


def effort_by(df: DataFrame, keys: Sequence[str], hours: str = "hours", vessel: str = "vessel_id") -> DataFrame:
    """Hours and distinct vessels of each key."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(hours), F.lit(0.0)).alias("fishing_hours"), F.count_distinct(vessel).alias("vessel_count"))


def effort_by_period(df: DataFrame, period: Column, hours: str = "hours", vessel: str = "vessel_id") -> DataFrame:
    return df.groupBy(period.alias("period")).agg(F.sum(hours).alias("fishing_hours"), F.count_distinct(vessel).alias("vessel_count"))


def presence(df: DataFrame, keys: Sequence[str] = ("h3", "date", "species"), individual: str = "individual", trip: str = "trip") -> DataFrame:
    """Rows, distinct individuals and distinct trips of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("presence_count"), F.count_distinct(individual).alias("individual_count"), F.count_distinct(trip).alias("trip_count"))


def merge_frames(frames: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Ragged frames, each with some of the values, as one: the mean of each value for each key."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in values))


def anomalies(df: DataFrame, columns: Sequence[str], cell: str = "h3", date: str = "date") -> DataFrame:
    """df with <column>_anom: the value minus its mean over all years for the cell and adjusted day of the year.

    The means are made first, combined before the shuffle, and joined back on the same key.
    """
    own = df.withColumn("__doy", dates.adjusted_doy(F.col(date)))
    means = own.groupBy(cell, "__doy").agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    met = own.join(means, [cell, "__doy"])
    return met.select(*df.columns, *((F.col(c) - F.col(f"__{c}")).alias(f"{c}_anom") for c in columns))


def support(df: DataFrame, target: str, keys: Sequence[str] = ("species", "h3")) -> DataFrame:
    """Rows and sum of the positive targets of each key."""
    return df.where(F.col(target) > 0).groupBy(*keys).agg(F.count("*").alias("support_rows"), F.sum(target).alias("support_sum"))


def map_aggregate(df: DataFrame, value: str, how: str, keys: Sequence[str] = ("h3",), positive_only: bool = False) -> DataFrame:
    """One value for each cell; ``positive_only`` drops the rows first, so that cells without positive values vanish."""
    own = df.where(F.col(value) > 0) if positive_only else df
    kind, _, stat = how.rpartition("_")
    if stat == "median":
        out = with_quantiles(own, keys, [], {"value": (positive(F.col(value)) if kind else F.col(value), 0.5)})
        return out.na.fill(0.0, ["value"]) if kind == "non_zero" else out
    return own.groupBy(*keys).agg(map_stat(F.col(value), how).alias("value"))


def hazard(df: DataFrame, value: str, how: str = "mean", least: float = 0.1, pressure: float = 0.5) -> DataFrame:
    """Cells whose use is above ``least``, with ln(1 + pressure) added."""
    return map_aggregate(df, value, how).where(F.col("value") > least).withColumn("hazard", F.col("value") + F.log1p(F.lit(pressure)))


def column_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], drop_empty: bool = False) -> DataFrame:
    out = df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))
    return out.na.drop(how="all", subset=list(columns)) if drop_empty else out


def class_profile(df: DataFrame, cls: str, columns: Sequence[str], prototype: str | None = None) -> DataFrame:
    """Rows, means and sample deviations of the columns for each class."""
    more = [F.count_distinct(prototype).alias("prototypes")] if prototype else []
    return df.groupBy(cls).agg(F.count("*").alias("rows"), *more, *(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_samp(c).alias(f"{c}_std") for c in columns))


def crosswalk(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows for each pair of classes."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("rows"))


def purity(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of rows that lie in their class's largest cell, by either side."""
    by = lambda c: table.groupBy(c).agg(F.max("rows").alias("m"), F.sum("rows").alias("t"))
    both = by(a).select(F.lit("a").alias("k"), "m", "t").union(by(b).select(F.lit("b").alias("k"), "m", "t"))
    share = lambda k: F.try_divide(F.sum(F.when(F.col("k") == k, F.col("m"))), F.sum(F.when(F.col("k") == k, F.col("t"))))
    return both.agg(share("a").alias("purity_a"), share("b").alias("purity_b"))


def class_balance(df: DataFrame, cls: str, keys: Sequence[str]) -> DataFrame:
    """For each key: classes, largest over smallest class, normalised entropy, share of the largest."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.count("*").alias("n"))
    shares = share_of_total(counts, "n", list(keys), "p")
    return shares.groupBy(*keys).agg(F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("balance_ratio"), normalised_entropy(F.col("p")).alias("entropy"), F.max("p").alias("dominant_share"))


def observed_use(df: DataFrame, value: str, keys: Sequence[str] = ("species", "seascape")) -> DataFrame:
    """Rows, sum, mean, median of the positive values for each kind and class, and the class's percentage of its kind's sum."""
    aggs = [F.count("*").alias("rows"), F.sum(value).alias("use_sum"), F.avg(value).alias("use_mean")]
    use = with_quantiles(df.where(F.col(value) > 0), keys, aggs, {"use_median": (F.col(value), 0.5)})
    return share_of_total(use, "use_sum", [keys[0]], "use_percent", 100.0)


def predicted_use(df: DataFrame, log_value: str, keys: Sequence[str] = ("species", "seascape")) -> DataFrame:
    """Means and medians of log and raw predictions, the median of the positive ones and their share."""
    v = F.col(log_value)
    raw = F.greatest(F.expm1(v), F.lit(0.0))
    aggs = [F.count("*").alias("rows"), F.avg(v).alias("log_mean"), F.avg(raw).alias("raw_mean"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("positive_fraction")]
    return with_quantiles(df, keys, aggs, {"log_median": (v, 0.5), "raw_median": (raw, 0.5), "positive_median": (positive(v), 0.5)})


def dominant_share(df: DataFrame, cls: str, weight: str, probability: str, keys: Sequence[str] = ("h3",), exclude_zero: bool = False) -> DataFrame:
    """For each key the class with the largest weight (ties: the lower class), that weight's share and the weighted mean probability."""
    own = df.where(F.col(cls).isNotNull() & ((F.col(cls) != 0) if exclude_zero else F.lit(True)))
    per = own.groupBy(*keys, cls).agg(F.sum(weight).alias("w"), F.try_divide(F.sum(F.col(weight) * F.col(probability)), F.sum(weight)).alias("p"))
    best = per.groupBy(*keys).agg(F.sum("w").alias("total"), F.max_by(F.struct(cls, "w", "p"), F.struct(F.round("w", 9), -F.col(cls))).alias("b"))
    return best.select(*keys, F.col(f"b.{cls}").alias(cls), F.try_divide("b.w", "total").alias("class_share"), F.col("b.p").alias("probability"))


def split_diagnostics(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Rows, positives, zeros, positive fraction, mean and maximum of the target for each key."""
    pos = F.col(target) > 0
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), count_where(pos).alias("positives"), count_where(~pos).alias("zeros"), F.avg(pos.cast("double")).alias("positive_fraction"), F.avg(target).alias("target_mean"), F.max(target).alias("target_max"))


def positive_pivot(df: DataFrame, group: str, kind: str, target: str, kinds: Sequence[str]) -> DataFrame:
    """Positive rows of each group by kind, with the groups' total and least."""
    wide = df.groupBy(group).pivot(kind, list(kinds)).agg(F.sum((F.col(target) > 0).cast("long"))).na.fill(0, list(kinds))
    return wide.withColumn("total", reduce(lambda a, b: a + b, map(F.col, kinds))).withColumn("least", F.least(*map(F.col, kinds)))


def metric_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Folds, and mean and sample deviation of each metric."""
    return df.groupBy(*keys).agg(F.count("*").alias("folds"), *(F.avg(m).alias(f"{m}_mean") for m in metrics), *(F.stddev_samp(m).alias(f"{m}_std") for m in metrics))


def coverage(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], means: Sequence[str], ranges: Sequence[str], gaps: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct counts, means, least and greatest values, and missing values; over the whole table if there are no keys."""
    aggs = [F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"{c}_distinct") for c in distinct), *(F.avg(c).alias(f"{c}_mean") for c in means)]
    aggs += [x for c in ranges for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))] + [F.coalesce(count_where(F.col(c).isNull()), F.lit(0)).alias(f"{c}_missing") for c in gaps]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def class_support(df: DataFrame, target: str, kind: str = "species", cls: str = "seascape") -> tuple[DataFrame, DataFrame]:
    """(rows, positives and mean by kind and class; for each kind its classes and the least and median of the positives)."""
    per = df.groupBy(kind, cls).agg(F.count("*").alias("rows"), count_where(F.col(target) > 0).alias("positives"), F.avg(target).alias("target_mean"))
    return per, per.groupBy(kind).agg(F.count_distinct(cls).alias("classes"), F.min("positives").alias("positives_min"), F.median("positives").alias("positives_median"))


def profile(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], date: str | None = None) -> DataFrame:
    """One row: rows, distinct keys, duplicate rows by key, days covered, and missing share, least, greatest and mean of each number.

    Rows are counted by key first, so that one distinct count is no single task's work.
    """
    days = [F.min(date).alias("__d0"), F.max(date).alias("__d1")] if date else []
    per = df.groupBy(*keys).agg(F.count("*").alias("__n"), *days, *(F.sum(F.col(c).isNull().cast("long")).alias(f"__g_{c}") for c in numeric), *(x for c in numeric for x in (F.min(c).alias(f"__l_{c}"), F.max(c).alias(f"__h_{c}"), F.sum(c).alias(f"__s_{c}"))))
    aggs = [F.sum("__n").alias("rows"), F.count("*").alias("keys"), (F.sum("__n") - F.count("*")).alias("duplicate_rows")]
    aggs += [F.min("__d0").alias("first_date"), F.max("__d1").alias("last_date")] if date else []
    for c in numeric:
        gaps = F.sum(f"__g_{c}")
        aggs += [(gaps / F.sum("__n")).alias(f"{c}_missing"), F.min(f"__l_{c}").alias(f"{c}_min"), F.max(f"__h_{c}").alias(f"{c}_max"), F.try_divide(F.sum(f"__s_{c}"), F.sum("__n") - gaps).alias(f"{c}_mean")]
    return per.agg(*aggs)


def ready(df: DataFrame, name: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def correlation(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    """(a, b, correlation, n) for each pair, over the rows that have all columns. Spearman: of average ranks."""
    own = df.select(*columns).na.drop()
    if method == "spearman":
        for c in columns:
            own = average_rank(own, c, f"__r_{c}")
    name = lambda c: f"__r_{c}" if method == "spearman" else c
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = own.agg(F.count("*").alias("n"), *(F.corr(name(a), name(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs))))
    return wide.select("n", rows.alias("x")).select("x.a", "x.b", "x.correlation", "n")


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: distinct linear quantiles as __edges."""
    return quantiles(df, F.col(column), [k / bins for k in range(bins + 1)]).select(F.array_distinct("__q").alias("__edges"))


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with bin (from 0) between the column's quantiles, closed on the right, the first on both sides; repeated edges are one."""
    edges = F.broadcast(quantile_edges(df, column, bins))  # one row
    at = F.size(F.filter("__edges", lambda e: e < F.col(column))) - 1
    return df.where(F.col(column).isNotNull()).join(edges, F.lit(True)).withColumn("bin", F.greatest(at, F.lit(0)).cast("long")).drop("__edges")


def binned_relationship(df: DataFrame, x: str, y: str, bins: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """Means and rows of equal-count bins of x, which are the same for all groups."""
    return quantile_bins(df, x, bins).groupBy(*group, "bin").agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.count("*").alias("rows"))


def metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*regression_metrics(y, p)) if keys else df.agg(*regression_metrics(y, p))


def hotspots(df: DataFrame, y: str, p: str, ties: Sequence[str], quantile: float = 0.9) -> DataFrame:
    """One row: the hotspot threshold of y, the number k of rows at or above it, and how many of them are among the k rows predicted highest."""
    edge = F.broadcast(quantiles(df, F.col(y), [quantile]).select(F.col("__q")[0].alias("threshold")))  # one row
    marked = df.join(edge, F.lit(True)).withColumn("hot", F.col(y) >= F.col("threshold"))
    k = F.broadcast(marked.agg(count_where(F.col("hot")).alias("wanted")))  # one row
    top = up_to(marked, [-F.col(p), *map(F.col, ties)], k, F.col("wanted"))
    inside = F.col("__in")
    total = top.agg(F.max("threshold").alias("threshold"), count_where(F.col("hot")).alias("k"), F.sum(y).alias("all"), count_where(F.col("hot") & inside).alias("hits"), F.coalesce(F.sum(F.when(inside, F.col(y))), F.lit(0.0)).alias("captured"))
    return total.select("threshold", "k", "hits", F.try_divide("hits", "k").alias("recall"), F.try_divide("captured", "all").alias("captured_fraction"))


def robust_range(df: DataFrame, column: str, symmetric: bool = False) -> DataFrame:
    """One row (lo, hi): the middle 99 % of the values, or plus and minus the 99.5th percentile of their sizes; never empty: a flat range falls back to the extremes, then to one more."""
    c, q = F.col(column), F.col("__q")
    if symmetric:
        ends = df.agg((-F.max(F.abs(c))).alias("l2"), F.max(F.abs(c)).alias("h2"))
        q = quantiles(df, F.abs(c), [0.995]).select((-q[0]).alias("lo"), q[0].alias("hi"))
    else:
        ends = df.agg(F.min(c).alias("l2"), F.max(c).alias("h2"))
        q = quantiles(df, c, [0.005, 0.995]).select(q[0].alias("lo"), q[1].alias("hi"))
    q = ends.join(F.broadcast(q), F.lit(True))  # one row each
    flat, flatter = F.col("lo") >= F.col("hi"), F.col("l2") >= F.col("h2")
    return q.select(F.when(flat, F.col("l2")).otherwise(F.col("lo")).alias("lo"), F.when(flat & flatter, F.col("h2") + 1).when(flat, F.col("h2")).otherwise(F.col("hi")).alias("hi"))


def histogram(df: DataFrame, column: str, bins: int = 80, symmetric: bool = False) -> DataFrame:
    """(bin from 0, rows) over the robust range; the last bin is closed, values outside are left out."""
    met = df.where(F.col(column).isNotNull()).join(F.broadcast(robust_range(df, column, symmetric)), F.lit(True)).where(F.col(column).between(F.col("lo"), F.col("hi")))
    at = F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("long")
    return met.groupBy(at.alias("bin")).agg(F.count("*").alias("rows"))


def density(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Rows of each square of side ``step``."""
    cell = lambda c: F.floor(F.col(c) / step).cast("long")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count("*").alias("rows"))


def colour_breaks(df: DataFrame, column: str, n: int = 6, least: float = 1e-6) -> list[float]:
    """n + 1 rising breaks: quantiles of the values above ``least``; geometric between the extremes where quantiles repeat, linear where there is no room."""
    got = quantiles(df.where(F.col(column) > least), F.col(column), [k / n for k in range(n + 1)]).first()[0]
    if not got:
        return [least * (1 + k) for k in range(n + 1)]
    if all(a < b for a, b in zip(got, got[1:])):
        return list(got)
    lo, hi = got[0], got[-1]
    if lo > 0 and hi > lo:
        return [lo * (hi / lo) ** (k / n) for k in range(n + 1)]
    return [lo + k * (max(hi - lo, 1.0)) / n for k in range(n + 1)]


def totals(df: DataFrame, value: str, keys: Sequence[str], **wanted: object) -> DataFrame:
    from tidecube.operators.joins import where_any

    return where_any(df, **wanted).groupBy(*keys).agg(F.sum(value).alias("total"))


def week_ranking(df: DataFrame, value: str, keys: Sequence[str], cell: str = "h3", quantile: float = 0.9) -> DataFrame:
    """Cells, mean, quantile, maximum and sum of each key, the highest quantile first."""
    aggs = [F.count_distinct(cell).alias("cells"), F.avg(value).alias("value_mean"), F.max(value).alias("value_max"), F.sum(value).alias("value_sum")]
    out = with_quantiles(df, keys, aggs, {"value_q": (F.col(value), quantile)})
    return out.orderBy(F.desc("value_q"), *keys)


def grid_rollup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], values: Sequence[str], cell: str = "h3") -> DataFrame:
    """Distinct cells and means for each coarse cell of the lookup (cell, grid) and key; means skip nulls."""
    return grid_means(df.join(lookup, cell), keys, values, cell)


def grid_means(df: DataFrame, keys: Sequence[str], values: Sequence[str], cell: str = "h3") -> DataFrame:
    """The same of rows that have their coarse cell, ``grid``, themselves; rows without one are a group."""
    return df.groupBy("grid", *keys).agg(F.count_distinct(cell).alias("cells"), *(F.avg(v).alias(f"{v}_mean") for v in values))
