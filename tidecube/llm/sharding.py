"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on a ring of 2^32 positions, drawn from its number alone. A row's key falls on the ring and
belongs to the next point clockwise. Shards have a capacity; the capacities add up to the number of rows, so that counts
differ by at most one. Rows of an arc that find their shard full continue clockwise to the next points whose shards have
room, so a shard that is not over-full keeps its rows when others come or go.

How many rows of each arc stay and where the others go depends on the arcs' counts only: a table whose size is the number
of points. Rows are then told apart by their rank within their arc, which is counted in cells of the ring that hold a
bounded number of rows on average, so that no arc or shard is one task's work.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecube.llm.common import materialize, maybe_broadcast

RING = 1 << 32
VNODES = 128
#: Rows of a cell, on average, at most.
CELL_ROWS = 20_000


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order, the shard of each)."""
    at = np.array([xxhash.xxh32_intdigest(f"{s}/{v}") for s in range(shards) for v in range(vnodes)], np.int64)
    owner = np.repeat(np.arange(shards), vnodes)
    order = np.lexsort((owner, at))
    return at[order], owner[order]


def flow(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, rows, shard) that fill no shard over its capacity.

    First every arc's own shard takes what it has room for, in ring order; then what is left continues clockwise.
    """
    room = capacity.astype(np.int64).copy()
    segments, left = [], []
    for arc, n in enumerate(counts.tolist()):
        own = min(n, int(room[owner[arc]]))
        room[owner[arc]] -= own
        if own:
            segments.append((arc, 0, own, int(owner[arc])))
        if n > own:
            left.append((arc, own, n - own))
    for arc, first, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owner)
            took = min(n, int(room[owner[at]]))
            if took:
                room[owner[at]] -= took
                segments.append((arc, first, took, int(owner[at])))
                first, n = first + took, n - took
    return segments


def capacities(n: int, shards: int) -> np.ndarray:
    return np.full(shards, n // shards) + (np.arange(shards) < n % shards)


def assign(rows: DataFrame, key: Column, tie: list[Column], shards: int = 40, vnodes: int = VNODES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with shard (int) and slot (long, gapless from 0 within each shard).

    ``key`` decides the place on the ring (a hash of it, so any type), ``tie`` the order of rows with equal keys; rows
    that are equal in both are interchangeable. Shards hold floor or ceil of the mean number of rows, whatever the keys:
    a single key may hold all rows. An empty table gives no rows. ``rows`` is read twice, to count its places on the ring
    and to deal it out, and has to be the same both times: a table, not a plan with chance in it.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("__at", F.xxhash64(key).bitwiseAND(RING - 1)).withColumn("__tie", F.xxhash64(*tie))
    places = materialize(placed.select("__at", "__tie"), "shard-places")
    n = places.count()
    at, owner = ring_points(shards, vnodes)
    split = 1 << max(0, (n // (cell_rows * len(at))).bit_length())  # cells to an arc
    points = at.tolist()
    # The next point clockwise: the number of points below the position, over the end to the first.
    coarse = spark.createDataFrame([(b, lo, points[lo:hi]) for b in range(4096) for lo, hi in [(int(np.searchsorted(at, b << 20)), int(np.searchsorted(at, (b + 1) << 20)))]], "__b int, __lo int, __points array<long>")
    arc = F.pmod(F.col("__lo") + F.size(F.filter("__points", lambda p: p < F.col("__at"))), F.lit(len(points)))
    cell = F.pmod(F.col("__tie"), F.lit(split)).cast("int")

    def with_arc(df: DataFrame) -> DataFrame:
        met = df.withColumn("__b", F.shiftrightunsigned("__at", 20).cast("int")).join(F.broadcast(coarse), "__b")
        return met.withColumn("__arc", arc).withColumn("__cell", cell).drop("__b", "__lo", "__points")

    arcs = with_arc(placed)
    cells = materialize(with_arc(places).groupBy("__arc", "__cell").agg(F.count("*").alias("__n")), "shard-cells")
    counts = np.zeros(len(points), np.int64)
    for a, c in cells.groupBy("__arc").agg(F.sum("__n")).collect():  # at most one row for each point of the ring
        counts[a] = c
    segments = flow(counts, owner, capacities(n, shards))
    base, rows_of = {}, []
    for a, first, count, shard in segments:
        rows_of.append((a, first, count, shard, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + count
    plan = spark.createDataFrame(rows_of, "__arc int, __first long, __count long, shard int, __base long")
    plan = plan.groupBy("__arc").agg(F.sort_array(F.collect_list(F.struct("__first", "__count", "shard", "__base"))).alias("__plan"))
    starts = cells.withColumn("__start", F.sum("__n").over(W.partitionBy("__arc").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)))
    starts = maybe_broadcast(starts.select("__arc", "__cell", F.coalesce("__start", F.lit(0)).alias("__start")))
    ranked = arcs.withColumn("__rank", F.row_number().over(W.partitionBy("__arc", "__cell").orderBy("__at", "__tie")) - 1)
    ranked = ranked.join(starts, ["__arc", "__cell"]).withColumn("__rank", F.col("__rank") + F.col("__start")).join(F.broadcast(plan), "__arc")  # the plan: a row for each point at most
    own = F.element_at(F.filter("__plan", lambda s: (s["__first"] <= F.col("__rank")) & (F.col("__rank") < s["__first"] + s["__count"])), 1)
    return ranked.withColumn("__own", own).withColumn("shard", F.col("__own.shard")).withColumn("slot", F.col("__own.__base") + F.col("__rank") - F.col("__own.__first")).drop("__own", "__plan", "__rank", "__start", "__arc", "__cell", "__at", "__tie")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, **options: int) -> DataFrame:
    """id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, shard, slot of every row.

    Null ids are keyed by their text; other columns are not read.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), (F.octet_length(t).cast("long") + 16).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"))
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("h").cast("string")))
    return assign(own, key, [F.col("h"), F.col("size")], shards, **options).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
