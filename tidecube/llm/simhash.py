"""SimHash near-duplicate detection by covering locality-sensitive hashing.

A fingerprint has 64 bits, one for each position where over half of the text's shingle hashes have a 1. For radius r,
every bit position gets one of the 2^(r+1)-1 nonzero vectors of r+1 bits; the mask of a nonzero vector v keeps the
positions whose vector has an odd product with v. Any r positions span at most r dimensions, so some v is orthogonal to
all of them: its mask drops them all, and two fingerprints that differ in no other position agree under it. Every pair
within the radius thus meets in a table, and no pair is missed.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket with over BUCKET fingerprints is divided
again by masks over the bits that its mask dropped; after three levels at most BUCKET distinct fingerprints can agree on
what was kept, which bounds every bucket without a cap. Within a bucket a spanning forest of the links is kept, not all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import materialize, maybe_broadcast
from tidecube.llm.components import connected_components

BITS = 64
#: Fingerprints that are compared with each other in one place.
BUCKET = 256
LEVELS = 3


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = np.fromiter((digest(p, 42) for p in parts), "<u8", len(parts))
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The key columns and ``fp`` (the fingerprint's 64 bits as a long) of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            columns = [batch.column(batch.schema.names.index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("fp", T.LongType())])
    return docs.select(*keys, text_col).mapInArrow(run, schema)


def covering_masks(free: list[int], radius: int) -> list[int]:
    """One mask for each nonzero vector of radius+1 bits, over the given bit positions."""
    n = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % n for i, p in enumerate(free)}
    return [sum(1 << p for p in free if (vector[p] & v).bit_count() % 2) for v in range(1, n + 1)]


def mask_levels(radius: int) -> list[list[tuple[int, int, int]]]:
    """For each level the rows (parent, path, kept bits): a path's mask keeps its parent's bits and more."""
    levels, parents = [], [(0, 0)]
    for _ in range(LEVELS):
        rows = []
        for parent, kept in parents:
            masks = covering_masks([p for p in range(BITS) if not kept >> p & 1], radius)
            rows += [(parent, parent * (len(masks) + 1) + v, kept | m) for v, m in enumerate(masks, 1)]
        levels.append(rows)
        parents = [(path, kept) for _, path, kept in rows]
    return levels


def _forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the links among the fingerprints x."""
    if len(x) == 2:
        return [(0, 1)] if int(x[0] ^ x[1]).bit_count() <= radius else []
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    left, edges = np.ones(len(x), bool), []
    for start in range(len(x)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
    return edges


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """Spanning edges (a, b) of buckets that hold at most BUCKET fingerprints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            a, b = [], []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                own = values[lo:hi]
                for i, j in _forest(own.view(np.uint64), radius):
                    a.append(own[i])
                    b.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    grouped = buckets.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within the radius.

    ``fps`` has one row for each distinct fingerprint in column fp.
    """
    spark = fps.sparkSession
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows, found = fps.select(F.lit(0).alias("path"), "fp"), None
    for level in mask_levels(radius):
        masks = spark.createDataFrame([(p, q, signed(m)) for p, q, m in level], "parent int, next int, mask long")  # a constant of at most 15^3 rows
        keyed = rows.join(F.broadcast(masks), F.col("path") == F.col("parent")).select(F.col("next").alias("path"), F.expr("fp & mask").alias("key"), "fp")
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(keyed.join(sizes, ["path", "key"]), "simhash-buckets")
        edges = _linked(met.where(F.col("n") <= BUCKET), radius)
        found = edges if found is None else found.union(edges)
        rows = met.where(F.col("n") > BUCKET).select("path", "fp").distinct()
        if rows.isEmpty():
            break
    else:
        raise AssertionError("a bucket of the last level holds more distinct fingerprints than its free bits allow")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Return id, fp (long), component (the smallest id reachable over links of at most ``radius`` differing bits).

    The id may be of any type that can be ordered. One row for each input row, repeated rows too. Null and empty texts
    have fingerprint zero and link like any other. Null ids are not counted for the smallest id; a component that has
    only null ids has a null component. Ties cannot matter: equal ids are the same id. Extra columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(fingerprints(own, ["id"], "text", shingle), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    parts = materialize(connected_components(links(nodes, radius), "simhash-components"), "simhash-parts")
    known = parts.join(nodes, parts.node == nodes.fp)
    least = known.groupBy("component").agg(F.min("least").alias("reached"))
    reached = parts.join(least, "component").select(F.col("node").alias("fp"), "reached")
    labels = materialize(nodes.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component")), "simhash-labels")  # alone in its stage, the join with a hot fingerprint can be split
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keyed(id_col: str, text_col: str) -> Column:
    """What a row is known by: its id and its text's hash, so that null and repeated ids are told apart; null ids go last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with all their columns, without all but one of each component.

    A row is known by its id and its text's hash, so null and repeated ids are told apart; the least id stays, null ids
    last. Of wholly equal rows (id and text) one stays.
    """
    found = near_duplicates(docs.withColumn("__key", keyed(id_col, text_col)), "__key", text_col, shingle, radius)
    return without_copies(docs, found.select(F.col("__key").alias("key"), "component"), id_col, text_col)


def without_copies(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose key in ``found`` (key, component) is not its component's."""
    own = [F.col("key.id").alias("__id"), F.col("key.h").alias("__h")]
    found = materialize(found.select(*own, (F.col("key") == F.col("component")).alias("__stays")), "simhash-stay")
    gone = maybe_broadcast(found.where("NOT __stays").select("__id", "__h").distinct())
    repeated = materialize(found.where("__stays").groupBy("__id", "__h").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "simhash-repeated")
    hashed = docs.withColumn("__h2", F.xxhash64(text_col))
    on = (F.col("__h2") == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = hashed.join(gone, on, "left_anti")
    if repeated.isEmpty():
        return kept.drop("__h2")
    again = kept.join(maybe_broadcast(repeated), on, "left_semi").dropDuplicates([id_col, "__h2"])
    return kept.join(maybe_broadcast(repeated), on, "left_anti").unionByName(again).drop("__h2")
