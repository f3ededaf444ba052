"""Ranks, running totals and splits over a whole table without sending it to one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecube.sources.store import shared_folder


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def dominant_class(df: DataFrame, keys: list[str], cls: str, score: str | None = None, ascending: bool = False, exclude: tuple = ()) -> DataFrame:
    """For each key the class with most rows, then the best mean score (highest, or lowest if ``ascending``), then the lowest class.

    Returns keys, class, days, mean_score (if there is a score).
    """
    own = df.where(F.col(cls).isNotNull() & ~F.col(cls).isin(*exclude)) if exclude else df.where(F.col(cls).isNotNull())
    extra = [F.round(F.avg(score), 9).alias("mean_score")] if score else []
    counted = own.groupBy(*keys, cls).agg(F.count("*").alias("days"), *extra)
    by_score = [F.asc_nulls_last("mean_score") if ascending else F.desc_nulls_last("mean_score")] if score else []
    return top_one(counted, keys, F.desc("days"), *by_score, F.asc(cls))


def share_of_total(df: DataFrame, value: str, keys: list[str], name: str, scale: float = 1.0) -> DataFrame:
    """Each row's share of its group's sum; null if that is 0. The sums are made first, so a large group is no single task's work."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    return df.join(sums, keys).withColumn(name, F.try_divide(F.lit(scale) * F.col(value), F.col("__sum"))).drop("__sum")


#: Quantile buckets that a whole table is cut into before anything is ordered.
BUCKETS = 1_000


def bucketed(df: DataFrame, order: Column, buckets: int = BUCKETS) -> DataFrame:
    """df with __b, which rises with ``order`` (numeric, nulls first): about even buckets between approximate quantiles.

    The quantiles are fixed here, by one aggregate, so that every use of the result has the same buckets; rows find theirs by binary search.
    """
    v = order.cast("double")
    found = df.agg(F.percentile_approx(v, [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]  # at most ``buckets`` numbers
    cuts = sorted({c for c in found or [] if -float("inf") < c < float("inf")})
    own = df.withColumn("__bv", v)
    if cuts:
        own = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__bv", outputCol="__bat", handleInvalid="keep").transform(own)
    else:
        own = own.withColumn("__bat", F.lit(0.0))
    return own.withColumn("__b", F.when(F.col("__bv").isNull(), -1).otherwise(F.col("__bat")).cast("int")).drop("__bv", "__bat")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that what it comes from is worked out once."""
    path = shared_folder(df.sparkSession, "keys")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edge(df: DataFrame, order: Sequence[Column], more: DataFrame | None, wanted: Column) -> tuple[Column, DataFrame]:
    """The key of a total order that starts with a number, and a table of one row at most with __edge: the key of the last row of those ``wanted``.

    ``wanted`` is an expression over ``total`` (the number of rows) and the columns of ``more``, a table of one row. The
    keys are written once and counted by bucket, and only the bucket that holds the last one wanted is ordered.
    """
    key = F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)))
    placed = bucketed(written(df.select(key.alias("__k"))), F.col("__k.k0"))
    sums = W.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a bucket
    counts = placed.groupBy("__b").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(sums)).withColumn("total", F.sum("n").over(W.partitionBy()))
    counts = counts.join(more, F.lit(True)) if more is not None else counts
    hit = counts.withColumn("w", wanted).where((F.col("upto") - F.col("n") < F.col("w")) & (F.col("w") <= F.col("upto"))).select("__b", (F.col("w") - F.col("upto") + F.col("n")).alias("__at"))
    last = placed.join(F.broadcast(hit), "__b").withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy("__k"))).where(F.col("__r") == F.col("__at"))
    return key, last.select(F.col("__k").alias("__edge"))


def up_to(df: DataFrame, order: Sequence[Column], more: DataFrame | None, wanted: Column) -> DataFrame:
    """df with __in on as many rows as ``wanted`` says, the first in a total order; see ``edge``."""
    key, last = edge(df, order, more, wanted)
    return df.join(F.broadcast(last), F.lit(True), "left").withColumn("__in", F.coalesce(key <= F.col("__edge"), F.lit(False))).drop("__edge")  # one row


def running_total(df: DataFrame, order: str, value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """df (``order`` unique and numeric) with the sum of ``value`` over all smaller ``order``.

    Quantiles of ``order`` cut the table into buckets; each is summed on its own, and starts from the sums before it.
    """
    own = bucketed(df, F.col(order), buckets)
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    starts = own.groupBy("__b").agg(F.sum(value).alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    within = F.coalesce(F.sum(value).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("__w", within).join(F.broadcast(starts), "__b").withColumn(name, F.col("__start") + F.col("__w")).drop("__b", "__w", "__start")


def quantiles(df: DataFrame, value: Column, qs: Sequence[float]) -> DataFrame:
    """One row with __q, the exact quantiles of a number with linear interpolation (null without values).

    Values are written once and counted by bucket; only the buckets that hold a wanted rank are opened, and their values counted before they are ordered.
    """
    spark = df.sparkSession
    placed = bucketed(written(df.select(value.cast("double").alias("__v")).where("__v is not null")), F.col("__v"))
    sizes = dict(placed.groupBy("__b").agg(F.count("*")).collect())  # one row a bucket
    starts, total = {}, 0
    for b in sorted(sizes):
        starts[b], total = total, total + sizes[b]
    if not total:
        return spark.createDataFrame([(None,)], "__q array<double>")
    places = [(total - 1) * float(q) for q in qs]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    wanted: dict[int, list[int]] = {}
    for r in ranks:
        b = max((x for x in starts if starts[x] <= r), key=starts.get)
        wanted.setdefault(b, []).append(r - starts[b])
    asked = spark.createDataFrame([(b, r, starts[b] + r) for b, own in wanted.items() for r in own], "__b int, __r long, __rank long")
    counts = placed.join(F.broadcast(asked.select("__b").distinct()), "__b").groupBy("__b", "__v").agg(F.count("*").alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(W.partitionBy("__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    hit = upto.join(F.broadcast(asked), "__b").where((F.col("__upto") - F.col("__n") <= F.col("__r")) & (F.col("__r") < F.col("__upto")))
    at = dict(hit.select("__rank", "__v").collect())  # two rows a quantile
    found = [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]
    return spark.createDataFrame([(found,)], "__q array<double>")


#: A group's quantile is looked for among values whose share of smaller ones is within this of it ...
BRACKET = 1e-3
#: ... by a sketch whose ranks are right to one part in so many, a tenth of that.
ACCURACY = 10_000


def with_quantiles(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a key: ``aggs`` and exact quantiles by name, of (number, share), with linear interpolation; null for groups without values.

    The first aggregate has a sketch of bounded size for each quantile beside ``aggs``, which brackets it. Then smaller values
    are counted, and only those in the bracket, counted by value, are ordered: about 2 * BRACKET of a group's (of one of at most
    ACCURACY values, all), sorted on disk if need be, where Spark's exact percentile holds all different values of a group in one task's memory. A bracket that
    misses its quantile is an error. Null keys are a group like any other. ``df`` is read twice and has to give the same rows.
    """
    names, group = list(wanted), F.struct(*(F.col(k) for k in keys))
    numbers, shares = [v.cast("double") for v, _ in wanted.values()], [float(q) for _, q in wanted.values()]
    ends = [(max(0.0, q - BRACKET), min(1.0, q + BRACKET)) for q in shares]
    sketches = [F.percentile_approx(v, list(e), ACCURACY).alias(f"__c{i}") for i, (v, e) in enumerate(zip(numbers, ends))]
    base = df.groupBy(*keys).agg(*aggs, *sketches, *(F.count(v).alias(f"__n{i}") for i, v in enumerate(numbers))).withColumn("__g", group)
    wide = [F.col(f"__n{i}") > ACCURACY for i in range(len(names))]  # of fewer values a bracket may be less than one rank wide: all are ordered
    lows = F.array(*(F.when(o, F.col(f"__c{i}")[0]) if e[0] > 0 else F.lit(None).cast("double") for i, (e, o) in enumerate(zip(ends, wide))))
    highs = F.array(*(F.when(o, F.col(f"__c{i}")[1]) if e[1] < 1 else F.lit(None).cast("double") for i, (e, o) in enumerate(zip(ends, wide))))
    cuts = base.select("__g", lows.alias("lows"), highs.alias("highs"))
    long = df.select(group.alias("__g"), F.posexplode(F.array(*numbers)).alias("m", "v")).where("v is not null")
    met = long.join(cuts, "__g").selectExpr("__g", "m", "v", "coalesce(v < lows[m], false) AS below", "coalesce(v <= highs[m], true) AS within")
    counts = met.where("below or within").groupBy("__g", "m", "below", F.expr("CASE WHEN NOT below THEN v END").alias("v")).agg(F.count("*").alias("n"))
    order = W.partitionBy("__g", "m").orderBy(F.desc("below"), "v").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.withColumn("upto", F.sum("n").over(order)).where("not below").join(base.select("__g", *(f"__n{i}" for i in range(len(names)))), "__g")

    def at(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col("m") == i) & (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    place = [(F.col(f"__n{i}") - 1) * F.lit(q) for i, q in enumerate(shares)]
    found = upto.groupBy("__g").agg(*(x for i, p in enumerate(place) for x in (at(i, F.floor(p)).alias(f"__l{i}"), at(i, F.ceil(p)).alias(f"__h{i}"))))
    out = base.join(found, "__g", "left")
    for i, (name, p) in enumerate(zip(names, place)):
        lo, hi, part = F.col(f"__l{i}"), F.col(f"__h{i}"), p - F.floor(p)
        missed = lo.isNull() | hi.isNull()
        value = F.when(missed, F.raise_error(F.lit(f"no rank of {name} in its bracket")).cast("double")).when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)
        out = out.withColumn(name, F.when(F.col(f"__n{i}") > 0, value))
    return out.select(*(c for c in out.columns if not c.startswith("__")))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a numeric column from 1, ties sharing the mean of their places. Values are counted before they are ordered."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, column, "__n", "__before").select(F.col(column).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v")).drop("__v")


def first_part(df: DataFrame, date: str, ties: Sequence[str | Column], share: float) -> DataFrame:
    """df with ``is_first``: whether a row is among the first int(share * n) by date (nulls first), then ``ties`` (a total order that starts with a number).

    Days are counted; all but the one in which the part ends are decided by their date, and of that day only the bucket of keys at the end is ordered.
    """
    days = df.groupBy(F.col(date).alias("d")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow))  # one row a day
    held = days.withColumn("upto", upto).withColumn("w", (F.sum("n").over(W.partitionBy()) * F.lit(share)).cast("long"))
    end = held.where("upto - n < w AND w <= upto").selectExpr("d", "w - upto + n AS k").first()  # one row, none if the part is empty
    if end is None:
        return df.withColumn("is_first", F.lit(False))
    day = F.lit(end.d).cast(df.schema[date].dataType)
    key, last = edge(df.where(F.col(date).eqNullSafe(day)), [F.col(t) if isinstance(t, str) else t for t in ties], None, F.lit(end.k))
    earlier = F.lit(False) if end.d is None else F.col(date).isNull() | (F.col(date) < day)
    within = F.col(date).eqNullSafe(day) & (key <= F.col("__edge"))
    return df.join(F.broadcast(last), F.lit(True), "left").withColumn("is_first", F.coalesce(earlier, F.lit(False)) | F.coalesce(within, F.lit(False))).drop("__edge")  # one row
