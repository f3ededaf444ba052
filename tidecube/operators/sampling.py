"""Samples, balances and splits that any partitioning repeats: rows go by a hash of their keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.operators.ordering import up_to, written


def mixed_key(*keys: Column, seed: int = 42) -> Column:
    """The default order of sampling."""
    return F.xxhash64(*keys, F.lit(seed))


def integer_key(k: Column) -> Column:
    """An order by arithmetic alone, which other engines repeat."""
    return (k * 2654435761) % 1000003


def sample_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total hash order; all rows if there are no more, or n is 0 or less."""
    return df if n <= 0 else df.orderBy(*order).limit(n)


def sample_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """n rows of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def balance(df: DataFrame, target: str, *order: Column) -> DataFrame:
    """All positive rows, and as many of the others at most, the first by the hash order."""
    pos, rest = df.where(F.col(target) > 0), df.where(~F.coalesce(F.col(target) > 0, F.lit(False)))
    wanted = F.broadcast(pos.agg(F.count("*").alias("wanted")))  # one row
    return pos.unionByName(up_to(rest, order, wanted, F.least("wanted", "total")).where("__in").drop("__in"))


def sample_weight(y: Column, power: float = 0.75) -> Column:
    return 1 + F.pow(F.greatest(y, F.lit(0.0)), F.lit(power))


def hold_out(df: DataFrame, share: float, *order: Column) -> DataFrame:
    """df with is_test on round(n * share) rows, the first by the hash order."""
    return up_to(df, order, None, F.bround(F.col("total") * share).cast("long")).withColumnRenamed("__in", "is_test")


def hold_out_groups(df: DataFrame, group: str, share: float, order: Column) -> DataFrame:
    """df with is_test on whole groups, taken in hash order until they hold ``share`` of the rows; the group that crosses it is in."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n"))
    keyed = sizes.withColumn("__k", order)
    before = F.coalesce(F.sum("__n").over(W.orderBy("__k", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a group
    chosen = keyed.withColumn("__before", before).withColumn("__all", F.sum("__n").over(W.partitionBy())).where(F.col("__before") < F.col("__all") * share)
    return df.join(chosen.select(group, F.lit(True).alias("__t")), group, "left").withColumn("is_test", F.coalesce("__t", F.lit(False))).drop("__t")


def buffered_split(df: DataFrame, ring: DataFrame, cell: str = "h3") -> DataFrame:
    """df (with is_test) with part: test, train, or excluded for cells within the ring (cell, neighbor) of a test cell."""
    tests = df.where("is_test").select(cell).distinct()
    near = ring.join(tests, cell).select(F.col("neighbor").alias(cell)).distinct().withColumn("__near", F.lit(True))
    part = F.when(F.col("is_test"), "test").when(F.col("__near"), "excluded").otherwise("train")
    return df.join(near, cell, "left").withColumn("part", part).drop("__near")


def group_support(df: DataFrame, group: str, kind: str, positive: Column, kinds: list[str]) -> DataFrame:
    """(group, a column of positive rows for each kind, total, least, rows)."""
    own = df.withColumn("__p", positive.cast("long"))
    wide = own.groupBy(group).pivot(kind, kinds).agg(F.sum("__p")).na.fill(0, kinds)
    return wide.join(own.groupBy(group).agg(F.count("*").alias("rows")), group).withColumn("total", sum((F.col(k) for k in kinds), F.lit(0))).withColumn("least", F.least(*map(F.col, kinds)) if len(kinds) > 1 else F.col(kinds[0]))


def _weights(table: np.ndarray, totals: np.ndarray, folds: int) -> np.ndarray:
    """What each group [group, measure] brings, in shares of a fold's even part."""
    return table * folds / np.maximum(totals, 1)


def _deal(shares: np.ndarray, held: np.ndarray) -> int:
    """The fold where a group's shares meet least of the same, the first of equals; ``held`` takes them."""
    f = int((held @ shares).argmin())
    held[f] += shares
    return f


def fold_assignment(groups: list[dict], kinds: list[str], folds: int) -> dict[object, int]:
    """A fold for each group (``group``, ``rows`` and a count for each kind), even in rows, in groups and in every kind.

    What a fold holds is measured in shares of its even part. Groups come from the one with the largest shares down, and
    each goes to the fold where what it brings meets least of the same; ties go to the first fold.
    """
    measures = ["rows", "groups", *kinds]
    table = np.array([[g["rows"], 1, *(g[k] for k in kinds)] for g in groups], float).reshape(len(groups), len(measures))
    shares = _weights(table, table.sum(0), folds)
    held = np.zeros((folds, len(measures)))
    order = sorted(range(len(groups)), key=lambda i: (-(shares[i] ** 2).sum(), str(groups[i]["group"])))
    return {groups[i]["group"]: _deal(shares[i], held) for i in order}


def with_folds(df: DataFrame, group: str, kind: str, positive: Column, kinds: list[str], folds: int) -> DataFrame:
    """df with fold (0 to folds - 1): rows of a group share one, that of ``fold_assignment``. A group is a block, component or class, of any number.

    A choice depends on all before it, so one task deals the groups, one short row each, as they come in order; it holds only what the folds hold. Counting and ordering them is shared work.
    """
    table = written(group_support(df.where(F.col(group).isNotNull()), group, kind, positive, kinds).select(F.col(group).alias("group"), "rows", F.lit(1).alias("one"), *kinds))
    measures = ["rows", "one", *kinds]
    totals = np.array(table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in measures)).first(), float)
    schema = T.StructType([table.schema["group"], T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType())])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _weights(np.stack([b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in measures], 1), totals, folds)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("group")), pa.array(list(s), pa.list_(pa.float64())), pa.array([(r**2).sum() for r in s], pa.float64())], names=schema.names)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((folds, len(measures)))
        for b in batches:
            s = b.column(1).flatten().to_numpy().reshape(-1, len(measures))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_deal(r, held) for r in s], pa.int64())], names=["group", "fold"])

    ordered = table.mapInArrow(sized, schema).orderBy(F.desc("size"), F.col("group").cast("string")).coalesce(1)  # ordered by many tasks, read by one
    chosen = written(ordered.mapInArrow(dealt, T.StructType([table.schema["group"], T.StructField("fold", T.LongType())])))
    return df.join(chosen.withColumnRenamed("group", group), group)


def fold_split(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


@dataclass(frozen=True)
class Variant:
    """A validation design: how test rows are chosen, by which groups, and where training rows are balanced."""

    name: str
    split: str = "random"
    group: str | None = None
    share: float = 0.25
    folds: int | None = None
    ring: int = 0
    balance: str = "before"


VARIANTS = {v.name: v for v in (
    Variant("random"), Variant("spatial", "group", "block"), Variant("buffered", "buffered", "block", ring=1), Variant("component", "group", "component"),
    Variant("class", "group", "seascape"), Variant("spatial_folds", "folds", "block", folds=5), Variant("class_folds", "folds", "seascape", folds=5), Variant("time", "time"),
)}
ALIASES = {"all": tuple(VARIANTS), "groups": ("spatial", "component", "class"), "folds": ("spatial_folds", "class_folds")}


def variants(names: list[str]) -> list[Variant]:
    """Designs by name or alias, each once, in the order given."""
    return [VARIANTS[k] for k in dict.fromkeys(k for n in names for k in ALIASES.get(n, (n,)))]


def with_parts(df: DataFrame, design: Variant, order: list[Column], ring: DataFrame | None = None, cell: str = "h3", date: str = "date", group_order=mixed_key) -> DataFrame:
    """df with part (test, train or excluded) under a design without folds.

    ``order`` is the hash order of rows, ``group_order`` of a group's column. A buffered design needs ``ring``: (cell,
    neighbor) of all cells within its distance. Designs by groups leave rows without a group in training.
    """
    if design.split == "random":
        own = hold_out(df, design.share, *order)
    elif design.split == "time":
        from tidecube.operators.ordering import first_part

        own = first_part(df, date, [cell, *order], 1 - design.share).withColumn("is_test", ~F.col("is_first")).drop("is_first")
    elif design.split in ("group", "buffered"):
        own = hold_out_groups(df, design.group, design.share, group_order(F.col(design.group)))
    else:
        raise ValueError(f"a design of {design.folds} folds has no single test part; see with_folds")
    if design.split == "buffered":
        return buffered_split(own, ring, cell).drop("is_test")
    return own.withColumn("part", F.when(F.col("is_test"), "test").otherwise("train")).drop("is_test")
