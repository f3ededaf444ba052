"""SimHash near copies whose links are verified: covering tables find candidates, five-word Jaccard decides.

A text's set has the hashes of its runs of SHINGLE words. Two texts are linked if their sets' Jaccard similarity is at
least 4/5. That is an angle at which 15 % of SimHash bits differ, too many for one short fingerprint, so a fingerprint has
BLOCKS blocks of 32 bits, each with the covering masks of radius RADIUS: two fingerprints that differ in fewer than
BLOCKS * (RADIUS + 1) bits are within the radius in some block, and collide in one of its tables. Beyond that, pairs at
the threshold still collide in all but 1 in 200 cases (tests measure it), more similar ones in nearly all.

Within a bucket, 128 bits of the fingerprints tell copies from chance: those that differ in at most FAR bits are put into
a group. Groups only say where to look: within a group every text is compared with every other by their sets until it
is linked, without a sample. A group of over BLOCK shingles is dealt out by pairs of its blocks, so that no task holds
more than two of them; so is a crowded part of a table, by pairs of its CROWD entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import lean_arrow, materialize, maybe_broadcast
from tidecube.llm.components import connected_components
from tidecube.llm.simhash import covering_masks, keyed, without_copies

SHINGLE = 5
BLOCKS, RADIUS = 10, 3
#: Bits of the first 128 that may differ; a pair at the threshold differs in more of them 3 times in 10,000.
FAR = 33
#: Entries of a part of a table, on average; and so many are held in one place, twice over for a pair.
PART, CROWD = 20_000, 2_000_000
#: Shingles of a group that are held in one place, twice over for a pair of blocks.
BLOCK = 500_000
#: Nodes whose table entries are made together; and a larger bucket is searched by itself.
_NODES, _BUCKET = 20_000, 512
_TIMES = np.random.default_rng(17).integers(0, 1 << 64, BLOCKS // 2, np.uint64) | np.uint64(1)
_MASKS = np.array(covering_masks(list(range(32)), RADIUS), np.uint32)
_ENTRY = np.dtype([("x", "<u4"), ("node", "<i8"), ("a", "<u8"), ("b", "<u8")])


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of one UTF-8 text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b"%b %b %b %b %b" % t for t in zip(words, words[1:], words[2:], words[3:], words[4:])] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts)))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """BLOCKS / 2 words of bits, each 1 if it is in over half of the set's hashes, hashed anew for each word."""
    bits = np.zeros(32 * BLOCKS, np.int64)
    for i in range(0, len(own), 1 << 14):
        h = own[i : i + (1 << 14), None] * _TIMES
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        bits += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * bits > len(own), bitorder="little").view("<u8")


def sketches(docs: DataFrame) -> DataFrame:
    """(key, node, size, fp) of (key, text): node is the hash of the set, 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            nodes = [xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0 for own in sets]
            fps = [fingerprint(own).tobytes() for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), pa.array(fps, pa.binary())], names=["key", "node", "size", "fp"])

    schema = T.StructType([docs.schema["key"], *T._parse_datatype_string("node long, size long, fp binary").fields])
    return docs.select("key", "text").mapInArrow(run, schema)


def _parts(x: np.ndarray, log2: int) -> np.ndarray:
    """The part of its table that a bucket lies in."""
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - log2)).astype(np.int64) if log2 else np.zeros(len(x), np.int64)


def _tables(fps: np.ndarray, nodes: np.ndarray, log2: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, parts, their ends, entries in order of their parts)."""
    words = fps.view("<u4").reshape(len(nodes), BLOCKS)
    entry = np.empty(len(nodes), _ENTRY)
    entry["node"], entry["a"], entry["b"] = nodes, fps.reshape(len(nodes), -1)[:, 0], fps.reshape(len(nodes), -1)[:, 1]
    for block in range(BLOCKS):
        for m, mask in enumerate(_MASKS):
            entry["x"] = words[:, block] & mask
            part = _parts(entry["x"], log2)
            order = np.argsort(part, kind="stable")
            kinds, first = np.unique(part[order], return_index=True)
            yield block * len(_MASKS) + m, kinds, np.append(first, len(part)), entry[order]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, nodes) of _NODES rows of (node, fp) at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        return np.frombuffer(b"".join(t["fp"].to_pylist()), "<u8"), t["node"].to_numpy()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _NODES:
            yield joined()
            held.clear()
    if sum(b.num_rows for b in held):
        yield joined()


def entries(nodes: DataFrame) -> DataFrame:
    """(tab, part, pair, entries) of (node, fp): the tables' entries, packed. pair is 0 but for crowded parts, whose pairs of blocks it numbers."""
    n = nodes.count()
    log2 = min(16, max(0, int(n // PART).bit_length()))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, own in _batched(batches):
            for table, parts, ends, _ in _tables(fps, own, log2):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), table), pa.int32()), pa.array(parts, pa.int32()), pa.array(np.diff(ends), pa.int64())], names=["tab", "part", "n"])

    crowded = {}
    if n > CROWD:  # else no part can be
        counted = nodes.select("node", "fp").mapInArrow(sizes, "tab int, part int, n long").groupBy("tab", "part").agg(F.sum("n").alias("n"))
        crowded = {(r["tab"], r["part"]): -(-r["n"] // CROWD) for r in counted.where(F.col("n") > CROWD).collect()}  # fewer than tables * n / CROWD
    shared = nodes.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for fps, own in _batched(batches):
            for table, parts, ends, found in _tables(fps, own, log2):
                rows = []
                for part, lo, hi in zip(parts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    if not (k := shared.value.get((table, part))):
                        rows.append((part, 0, found[lo:hi].tobytes()))
                        continue
                    block = found[lo:hi]["node"] % k
                    for i in range(k):
                        for j in range(i + 1, k):
                            if len(own2 := found[lo:hi][(block == i) | (block == j)]):
                                rows.append((part, i * k + j, own2.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([table] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["tab", "part", "pair", "entries"])

    return nodes.select("node", "fp").mapInArrow(run, "tab int, part int, pair long, entries binary")


def _apart(e: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(e["a"][i] ^ e["a"][j]).astype(np.int32) + np.bitwise_count(e["b"][i] ^ e["b"][j])


def candidates(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) of entries: groups are connected by pairs in one bucket that differ in FAR bits at most."""
    e = e[np.argsort(e["x"], kind="stable")]
    start = np.flatnonzero(np.append(True, e["x"][1:] != e["x"][:-1]))
    size = np.diff(start, append=len(e))
    left, right = [], []
    small = np.repeat(np.where(size <= _BUCKET, size, 0), size)  # of each entry's bucket
    place = np.arange(len(e)) - np.repeat(start, size)
    for k in range(1, int(small.max(initial=0))):
        i = np.flatnonzero(place + k < small)
        near = i[_apart(e, i, i + k) <= FAR]
        left.append(near)
        right.append(near + k)
    for lo, n in zip(start[size > _BUCKET].tolist(), size[size > _BUCKET].tolist()):
        rest = np.arange(lo, lo + n)
        queue: list[int] = []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            i = queue.pop()
            near = _apart(e, i, rest) <= FAR
            queue += (found := rest[near]).tolist()
            left.append(np.full(len(found), i))
            right.append(found)
            rest = rest[~near]
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    label = e["node"].copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (was == label).all():
            break
    moved = label != e["node"]
    return e["node"][moved], label[moved]


def _met(group: pa.Table) -> pa.Table:
    a, b = candidates(np.frombuffer(b"".join(group["entries"].to_pylist()), _ENTRY))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the links among sets that are not empty."""
    size = np.array([len(s) for s in sets])
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(code, np.cumsum(size)[:-1])
    left, edges, queue = np.arange(len(sets)), [], []
    mark = np.zeros(len(kinds), np.int32)
    while len(left):
        if not queue:
            queue, left, code = [int(left[0])], left[1:], code[size[left[0]] :]
            continue
        i = queue.pop()
        mark[parts[i]] = 1
        both = np.add.reduceat(mark[code], np.cumsum(size[left]) - size[left])
        mark[parts[i]] = 0
        near = 5 * both >= 4 * (size[i] + size[left] - both)
        if near.any():
            found = left[near].tolist()
            edges += [(i, j) for j in found]
            queue += found
            code, left = code[np.repeat(~near, size[left])], left[~near]
    return edges


def _sets(texts: DataFrame) -> DataFrame:
    """(component, pair, node, own) of (component, blocks, node, text): each set once for each pair of blocks that it is compared in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py()) for t in batch.column(3).cast(pa.large_binary())]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lists], names=["component", "blocks", "node", "own"])

    found = texts.select("component", "blocks", "node", "text").mapInArrow(run, "component long, blocks long, node long, own array<long>")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: o != block)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda o: F.least(o, block) * F.col("blocks") + F.greatest(o, block)))
    return found.select("component", F.explode(pairs).alias("pair"), "node", "own")


def _linked(group: pa.Table) -> pa.Table:
    """Spanning edges (a, b) of one group."""
    group = group.select(["node", "own"]).combine_chunks()
    nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
    lists = group["own"]
    edges = forest([lists[int(i)].values.to_numpy().view(np.uint64) for i in first]) if len(nodes) > 1 else []
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: each a keeps its least b, to which its other b are linked instead.

    An a has at most one b for each table (and pair of a crowded part), and the b are few: the least nodes of their buckets.
    """
    stars = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    least = F.col("bs")[0]
    moved = F.transform(F.slice("bs", F.lit(2), F.size("bs")), lambda b: F.struct(b.alias("a"), least.alias("b")))
    return stars.select(F.explode(F.concat(F.array(F.struct("a", least.alias("b"))), moved)).alias("e")).select("e.*").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(key, component) of (key, text): the least key reachable over links; one row for each row.

    Keys are (none, id, h) as ``simhash.keyed`` makes them. Texts without words link with each other.
    """
    rows = materialize(sketches(docs), "near-rows")
    nodes = materialize(rows.groupBy("node").agg(F.min("key").alias("least"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp")), "near-nodes")
    edges = entries(nodes.where("size > 0")).groupBy("tab", "part", "pair").applyInArrow(_met, "a long, b long")
    edges = contracted(materialize(edges.distinct(), "near-edges"))
    groups = materialize(connected_components(edges, "near-groups"), "near-grouped")
    met = materialize(groups.join(nodes.select("node", "least", "size"), "node"), "near-met")
    blocks = met.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    wanted = materialize(met.join(blocks, "component").select("component", "blocks", "node", F.col("least.id").alias("__id"), F.col("least.h").alias("__h")), "near-wanted")
    on = (F.col("key.h") == F.col("__h")) & F.col("key.id").eqNullSafe(F.col("__id"))
    sets = _sets(docs.join(maybe_broadcast(wanted), on))
    links = sets.groupBy("component", "pair").applyInArrow(_linked, "a long, b long").distinct()
    parts = materialize(connected_components(links, "near-components"), "near-parts")
    least = parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("reached"))
    reached = parts.join(least, "component").select("node", "reached")
    labels = materialize(nodes.join(reached, "node", "left").select("node", F.coalesce("reached", "least").alias("component")), "near-labels")
    return rows.join(labels, "node").select("key", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, without all but one of each component; which one stays is as in ``simhash.drop_near_duplicates``."""
    found = near_copies(docs.select(keyed(id_col, text_col).alias("key"), F.col(text_col).alias("text")))
    return without_copies(docs, found, id_col, text_col)
