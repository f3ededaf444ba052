"""Joins of the cube: attaching, zero filling, species expansion, completeness, nearest dates.

Which side is broadcast is left to Catalyst's size estimates and to adaptive execution; only sides of one row are hinted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, to: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a table of cells, classes or codes."""
    return df.join(to, list(on), "left")


def zero_fill(df: DataFrame, values: DataFrame, on: Sequence[str], fills: Mapping[str, object] | None = None) -> DataFrame:
    """Left join on the keys; every other column of ``values`` gets its fill, 0 unless given, where nothing matched."""
    fills = fills or {}
    names = [c for c in values.columns if c not in on]
    joined = df.join(values, list(on), "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(c), F.lit(fills.get(c, 0)).cast(values.schema[c].dataType)).alias(c) for c in names))


def for_each(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Every row once for each of a few known values: no join."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def species_list(df: DataFrame, column: str = "species") -> list[str]:
    """Distinct values in order. They name products and models, so they are few."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def observed_days(presence: DataFrame, cell: str = "h3", date: str = "date", kind: str = "species") -> DataFrame:
    """(cell, date, kind) of every cell seen on a day with every kind seen on that day.

    The kinds of a day are one short array, so the days' cells are not multiplied in a join but by explode.
    """
    kinds = presence.groupBy(date).agg(F.array_sort(F.collect_set(kind)).alias("__kinds"))
    return presence.select(cell, date).distinct().join(kinds, date).select(cell, date, F.explode("__kinds").alias(kind))


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(left rows with a match, a one-row count of those without); a key that ``right`` has twice is an error."""
    if twice := right.groupBy(*on).count().where("count > 1").take(1):
        raise ValueError(f"key is not unique: {twice[0].asDict()}")
    joined = left.join(right.withColumn("__there", F.lit(True)), list(on), "left")
    return joined.where("__there").drop("__there"), joined.agg(F.coalesce(F.sum(F.col("__there").isNull().cast("long")), F.lit(0)).alias("unmatched"))


def fold(tables: Sequence[DataFrame], on: Sequence[str], how: str = "inner", complete: Sequence[str] = ()) -> DataFrame:
    """All tables joined on the same keys, which are shuffled once; then rows with a null in ``complete`` go."""
    out = reduce(lambda a, b: a.join(b, list(on), how), tables)
    return out.na.drop(subset=list(complete)) if complete else out


def completeness(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows of each side, and keys of each side that the other lacks."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(left, "left_rows"), one(right, "right_rows"), one(left.join(right, list(on), "left_anti"), "left_only"), one(right.join(left, list(on), "left_anti"), "right_only")]
    tagged = [p.select(F.lit(p.columns[0]).alias("what"), F.col(p.columns[0]).alias("n")) for p in parts]
    names = [p.columns[0] for p in parts]
    return reduce(DataFrame.union, tagged).agg(*(F.sum(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in names))


def nearest_date(dates: DataFrame, sources: DataFrame, date: str = "date", source: str = "source_date") -> DataFrame:
    """``dates`` with the nearest source date (ties go to the earlier one; outside the range the end) and day_offset, source minus date.

    Only distinct days are matched. The source days are one array, a value for each day at most. No sources: nulls.
    """
    every = F.broadcast(sources.agg(F.array_sort(F.collect_set(source)).alias("__s")))  # one row
    days = dates.select(date).distinct().join(every, F.lit(True), "left")
    before = F.array_max(F.filter("__s", lambda s: s <= F.col(date)))
    after = F.array_min(F.filter("__s", lambda s: s >= F.col(date)))
    take_after = before.isNull() | (F.datediff(after, F.col(date)) < F.datediff(F.col(date), before))
    matched = days.select(date, F.when(after.isNotNull() & take_after, after).otherwise(before).alias(source))
    matched = matched.withColumn("day_offset", F.datediff(F.col(source), F.col(date)).cast("long"))
    return dates.join(matched, date)


def class_of_prototype(rows: DataFrame, prototypes: DataFrame, on: str = "som_prototype") -> DataFrame:
    """Rows with the class of their prototype; a few hundred prototypes."""
    return rows.join(prototypes, on)


def where_any(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that meet every condition given: a value, a list of values, or None for no condition."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def in_order(c: Column, values: Sequence[object]) -> Column:
    """The place of c among the values, for sorting by a given order."""
    return F.array_position(F.array(*map(F.lit, values)), c)
