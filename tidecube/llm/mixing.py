"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate r, the number of times it is read. Of all rates that meet the token constraints (for
each source, the sum of rate times size is its target) entropy balancing takes those closest to 1 in entropy, the
minimum of sum(r ln r - r + 1). The minimum has the form r = exp(lambda_source * size), held at the highest rate allowed;
the lambdas solve a convex dual, whose gradient is target minus mixed tokens. Newton steps on the logarithm of the mixed
tokens, kept within a bracket, solve it; each step is one aggregation over (source, size) counts.

Rates become whole copies source by source in chunks of bounded size: from the largest document down, each gets the copies
below or above its rate, whichever brings the tokens so far closer to what the rates give. Sums that decide are exact
(integers and decimals), so that reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import materialize, maybe_broadcast, word_count

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is read more often.
MAX_RATE = 3
#: Documents that are rounded together.
CHUNK = 4_000
_ONE = 1 << 32
_STEPS = 60
_TOLERANCE, _FAILED = 1e-9, 1e-2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """For each source of (source, size): source_size and target.

    Sources in code point order, null last, take the weights in turn and share all tokens by weight; a target stops at
    ``max_rate`` times its source, and what is over goes to the others by weight until none is above. That is a water
    level: target = min(max_rate * size, weight * level). One row a source; the order over sources is the only global one.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = by.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_rate).cast("double"))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    # Were this source the first below its cap: the level that shares what the full ones leave.
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", F.try_divide(left, open_w)).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level")))
    return levels.select("source", "source_size", "w", "cap", level.over(everything)["level"].alias("level")).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target")
    )


def _rate(lam: F.Column, size: F.Column, max_rate: int) -> F.Column:
    """min(max_rate, exp(lambda * size)) in units of 1/_ONE."""
    return F.round(F.exp(F.least(lam * size, F.lit(math.log(max_rate)))) * _ONE).cast("long")


def _solved(cells: DataFrame, targets: DataFrame, max_rate: int) -> DataFrame:
    """(source, lam) that meet the targets; ``cells`` has source, size, n."""
    total = targets.select("source", "target", F.col("source_size").cast("double").alias("s0"))
    wide = cells.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size").cast("decimal(38,0)") * F.col("size")).cast("double"), F.sum(F.col("n") * F.col("size")).cast("double")).alias("mean"))
    start = F.when((F.col("target") > 0) & (F.col("s0") > 0), F.try_divide(F.log(F.try_divide("target", "s0")), F.col("mean"))).otherwise(0.0)
    state = materialize(
        total.join(wide, total["source"].eqNullSafe(wide["source"]))
        .select(total["source"], "target", "mean", F.coalesce(start, F.lit(0.0)).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= F.col("s0") * max_rate).alias("full"), F.lit(1.0).alias("error")),
        "mix-dual",
    )
    for _ in range(_STEPS):
        lams = maybe_broadcast(state.select(F.col("source").alias("of"), "lam"))
        r = _rate(F.col("lam"), F.col("size"), max_rate)
        at = cells.join(lams, F.col("source").eqNullSafe(F.col("of"))).withColumn("r", r).withColumn("t", (F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("r"))
        free = F.when(F.col("r") < max_rate * _ONE, F.col("t").cast("decimal(30,0)") * F.col("size"))
        grads = at.groupBy("source").agg((F.sum("t").cast("double") / _ONE).alias("mixed"), (F.coalesce(F.sum(free), F.lit(0)).cast("double") / _ONE).alias("slope"))
        gap = F.log(F.try_divide("mixed", "target"))
        step = F.try_divide(gap, F.try_divide("slope", "mixed"))
        now = state.join(grads.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("gap", F.when((F.col("mixed") > 0) & (F.col("target") > 0), gap).otherwise(0.0))
        now = now.withColumn("hi2", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo2", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - step
        outside = newton.isNull() | (newton <= F.col("lo2")) | (newton >= F.col("hi2"))
        width = F.lit(2.0) / F.col("mean")
        inner = F.when(F.col("lo2").isNull(), F.col("hi2") - width).when(F.col("hi2").isNull(), F.col("lo2") + width).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        held = F.col("full") | (F.abs("gap") <= _TOLERANCE)
        state = materialize(
            now.select(
                "source", "target", "mean", F.when(held, F.col("lam")).when(F.coalesce(outside, F.lit(False)), inner).otherwise(newton).alias("lam"),
                F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "full", F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs("gap")).alias("error"),
            ),
            "mix-dual",
        )
        if (worst := state.agg(F.max("error")).first()[0] or 0.0) <= _TOLERANCE:
            break
    else:
        if worst > _FAILED:  # tiny rates are rounded too coarsely for the tolerance, and are near enough
            raise ArithmeticError(f"a source is off its target by a factor of {math.exp(worst)} after {_STEPS} steps")
    return state.select("source", "lam", "full")


def round_rates(size: np.ndarray, rate: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Copies for rates in units of 1/_ONE, from the largest size down; equal sizes go by h."""
    copies, off = np.zeros(len(size), np.int32), 0
    order = np.lexsort((h, -size))
    for i, n, r in zip(order.tolist(), size[order].tolist(), rate[order].tolist()):
        low, part = divmod(r, _ONE)
        down = off - part * n
        up = down + _ONE * n
        take_up = part and abs(up) < abs(down)
        copies[i] = low + 1 if take_up else low
        off = up if take_up else down
    return copies


def _with_copies(chunk: pa.Table) -> pa.Table:
    copies = round_rates(*(chunk.column(c).to_numpy() for c in ("size", "rate", "k")))
    return chunk.append_column("copies", pa.array(copies))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, chunk: int = CHUNK) -> DataFrame:
    """Return id, source, size (words), source_size, target, rate, copies, taken (copies * size), h (the text's hash).

    One row for each input row. Null and empty texts have size 0 and rate 1, unless their source is read in full: they
    carry no tokens. Null sources are a source, the last. A source without tokens has target 0. Copies lie between 0 and
    ``max_rate``. Ties go by the hash of id and text, so that equal rows are interchangeable. Other columns are not read.
    """
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"))
        .withColumn("k", F.xxhash64("id", "h")),
        "mix-rows",
    )
    cells = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    targets = materialize(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_rate), "mix-targets")
    lams = _solved(cells, targets, max_rate)
    counts = cells.groupBy("source").agg(F.sum("n").alias("n_docs"))
    per = targets.join(lams.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").join(counts.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    per = maybe_broadcast(materialize(per.withColumnRenamed("source", "of"), "mix-sources"))
    rate = F.when(F.col("full"), F.lit(max_rate * _ONE)).otherwise(_rate(F.col("lam"), F.col("size"), max_rate))
    rated = rows.join(per, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("part", F.pmod(F.col("k"), F.ceil(F.col("n_docs") / chunk))).drop("of", "lam", "full", "n_docs")
    schema = T.StructType([*rated.schema.fields, T.StructField("copies", T.IntegerType())])
    copied = rated.groupBy("source", "part").applyInArrow(_with_copies, schema)
    return copied.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("rate") / _ONE).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "h")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix reads it (0 to max_rate times)."""
    found = mix(docs, id_col, text_col, source_col, **options)
    # Equal rows (id, source, text) are interchangeable: their copies are summed and shared out evenly, the rest to any.
    per = found.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("h").alias("__h")).agg(F.sum("copies").alias("__c"), F.count("*").alias("__m"))
    per = materialize(per, "mix-copies")
    keyed = docs.withColumn("__h2", F.xxhash64(text_col))
    on = (F.col("__h2") == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source"))
    helpers = ["__h2", "__h", "__id", "__source", "__c", "__m"]
    single = keyed.join(per.where("__m = 1 and __c > 0"), on).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).drop(*helpers, "__i")
    if per.where("__m > 1").isEmpty():
        return single
    again = keyed.join(per.where("__m > 1"), on).dropDuplicates(["__id", "__source", "__h"])
    again = again.where("__c > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).drop(*helpers, "__i")
    return single.unionByName(again)
