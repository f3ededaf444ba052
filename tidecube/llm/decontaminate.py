"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the tokens at the positions that a fixed mask reads; the positions that it ignores may differ. One
mask of weight 5 over 8 tokens already meets every stretch of 13 tokens that has at most two substitutions, wherever they
are (tests check all of them). Items of 5 to 12 tokens have masks of their own, over the whole item, which leave out every
place that may differ in turn; they are read only if the benchmark has items of that length. Seeds of the benchmark and of the documents are joined, and every hit is verified: the
token sequences around it are laid over each other and some stretch must agree in enough places.

Only seeds that a bitmap of the benchmark's seeds lets through leave the scan of the documents, with the tokens around
them, so that neither texts nor all seeds are shuffled. The bitmap's size is bounded; where a benchmark fills it, more
seeds pass and the exact join still decides.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import bitmap, lean_arrow, materialize, maybe_broadcast, passing

#: Token positions that each mask reads.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 8))
#: A verified stretch has at least so many tokens (a shorter text: all of it) ...
MIN_TOKENS = 13
#: Items with fewer tokens match nothing, unless a call asks for them: one word would meet every text that has it.
LEAST_TOKENS = 5
#: ... and this share of them agrees.
MIN_MATCH = 0.8
#: Tokens kept on either side of a hit.
CONTEXT = 16
_TOKEN = re.compile(r"\w+")
_CHUNK = 400_000


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over the n places of a short item: whichever places differ, as many as MIN_MATCH allows, one mask reads none of them.

    The places are dealt to two parts more than may differ; each mask leaves out as many parts as places may differ.
    """
    wrong = n - math.ceil(MIN_MATCH * n - 1e-9)
    return [tuple(o for o in range(n) if o % (wrong + 2) not in left_out) for left_out in itertools.combinations(range(wrong + 2), wrong)]


#: (mask, the length of the items that it is for: None for those of MIN_TOKENS and more)
Mask = tuple[tuple[int, ...], int | None]


def masks_for(lengths: Iterable[int]) -> list[Mask]:
    """The masks that items of these lengths need; items of under five tokens have one that reads them all."""
    own = [(m, n) for n in sorted(set(lengths)) if 0 < n < MIN_TOKENS for m in short_masks(n)]
    return [(m, None) for m in MASKS if any(n >= MIN_TOKENS for n in lengths)] + own


class _Hashes(dict):
    """64-bit hashes of tokens; forgets them all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def tokens(text: str | None, hashes: _Hashes | None = None) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and underscores."""
    found = _TOKEN.findall((text or "").lower())
    return np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, found), np.uint64, len(found))


def seeds(t: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each position where the whole mask fits."""
    n = max(0, len(t) - mask[-1])
    h = np.full(n, len(mask) * 1_000_003 + sum(o << (4 * k) for k, o in enumerate(mask)), np.uint64)
    for o in mask:
        h = (h ^ t[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _chunks(texts, hashes: _Hashes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, token arrays) of runs of rows with a bounded number of tokens each."""
    first, rows, n = 0, [], 0
    for i, text in enumerate(texts):
        rows.append(tokens(text.as_py(), hashes))
        n += len(rows[-1])
        if n > _CHUNK:
            yield first, rows
            first, rows, n = i + 1, [], 0
    if rows:
        yield first, rows


def _item_seeds(items: DataFrame, masks: list[Mask]) -> DataFrame:
    """(item, item_pos, h) of (item, item_tokens), item being the text's number: of short items the seeds of their own masks at their start only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].values.to_numpy().view(np.uint64)
                found = [seeds(t, m) if n is None else seeds(t, m)[:1] for m, n in masks if n == (None if len(t) >= MIN_TOKENS else len(t))]
                pos = np.concatenate([np.arange(len(s)) for s in found] or [np.zeros(0, int)])
                h = np.concatenate(found or [np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(pos), i), pa.int64())), pa.array(pos, pa.int32()), pa.array(h.view(np.int64))], names=["item", "item_pos", "h"])

    schema = T.StructType([items.schema["item"], T.StructField("item_pos", T.IntegerType()), T.StructField("h", T.LongType())])
    return items.select("item", "item_tokens").mapInArrow(run, schema)


def _segments(docs: DataFrame, bits: np.ndarray, masks: list[Mask]) -> DataFrame:
    """A row for each stretch of a document around its hits: id, start, tokens, hit_pos (in the document), hit_h."""
    kinds = sorted({m for m, _ in masks})
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        hashes, table = _Hashes(), shared.value
        for batch in batches:
            for first, rows in _chunks(batch.column(1), hashes):
                out: list[tuple] = []
                flat, ends = np.concatenate(rows), np.cumsum([len(t) for t in rows])
                pos, hit = [], []
                for mask in kinds:
                    s = seeds(flat, mask)
                    p = passing(s, table)
                    row = np.searchsorted(ends, p, "right")
                    p = p[p + mask[-1] < ends[row]]  # the mask stays within one document
                    pos.append(p)
                    hit.append(s[p])
                pos, hit = np.concatenate([*pos, np.zeros(0, np.int64)]), np.concatenate([*hit, np.zeros(0, np.uint64)])
                order = np.argsort(pos, kind="stable")
                pos, hit = pos[order], hit[order]
                row = np.searchsorted(ends, pos, "right")
                begin = np.where(row > 0, ends[row - 1], 0) if len(pos) else pos
                lo = np.maximum(begin, pos - CONTEXT)
                hi = np.minimum(ends[row], pos + 13 + CONTEXT)
                k = 0
                while k < len(pos):
                    j = k
                    end = hi[k]
                    while j + 1 < len(pos) and row[j + 1] == row[k] and lo[j + 1] <= end:
                        j += 1
                        end = max(end, hi[j])
                    base = begin[k]
                    out.append((first + int(row[k]), int(lo[k] - base), flat[lo[k] : end].view(np.int64), (pos[k : j + 1] - base).astype(np.int32), hit[k : j + 1].view(np.int64)))
                    k = j + 1
                ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.int32())), pa.array([o[4] for o in out], pa.list_(pa.int64()))],
                    names=["id", "start", "tokens", "hit_pos", "hit_h"],
                )

    schema = T.StructType([docs.schema[0], *T._parse_datatype_string("start int, tokens array<long>, hit_pos array<int>, hit_h array<long>").fields])
    return docs.mapInArrow(run, schema)


def best_stretch(a: np.ndarray, b: np.ndarray, least: int = MIN_TOKENS, share: float = MIN_MATCH) -> tuple[int, int, int] | None:
    """(start, tokens, agreeing tokens) from the first to the last stretch of ``least`` places that agrees well enough."""
    same = np.cumsum(np.concatenate([[0], a == b]))
    if len(a) < least or least < 1:
        return None
    good = np.flatnonzero(same[least:] - same[:-least] >= share * least - 1e-9)
    if not len(good):
        return None
    lo, hi = int(good[0]), int(good[-1]) + least
    return lo, hi - lo, int(same[hi] - same[lo])


def _verified(candidates: DataFrame, id_type: T.StructField, item_type: T.StructField) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            names = batch.schema.names
            start, diag = (batch.column(names.index(x)).to_pylist() for x in ("start", "diag"))
            doc, item = (batch.column(names.index(x)) for x in ("tokens", "item_tokens"))
            for i in range(batch.num_rows):
                d, t = doc[i].values.to_numpy(), item[i].values.to_numpy()
                lo, hi = max(0, start[i] - diag[i]), min(len(t), start[i] + len(d) - diag[i])  # the item's positions that the segment covers
                if hi <= lo:
                    continue
                cut = lo + diag[i] - start[i]
                if found := best_stretch(t[lo:hi], d[cut : cut + hi - lo], min(MIN_TOKENS, len(t))):
                    at.append(i)
                    rows.append((found[0] + lo + diag[i], found[0] + lo, found[1], found[2], len(t)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in cols)], names=["id", "item", "doc_start", "item_start", "n_tokens", "n_matched", "item_tokens"])

    schema = T.StructType([id_type, item_type, *T._parse_datatype_string("doc_start int, item_start int, n_tokens int, n_matched int, item_tokens int").fields])
    return candidates.mapInArrow(run, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """A row for each document and different benchmark text that share a verified stretch.

    Columns: id, item (the least id that has the text), doc_start and item_start (token positions), n_tokens and n_matched
    (of the stretch), item_tokens (of the whole item), n_items (ids that have the text, by its tokens). The stretch reaches
    from the first to the last MIN_TOKENS places that agree to MIN_MATCH (of a shorter item: all its places); of several
    alignments the one with most agreeing tokens counts, then the earliest. Repeated rows give one row an id and item.
    Null and empty texts, and items of under ``least_tokens`` tokens, overlap with nothing; items of one to four tokens, where
    these are asked for, match word for word. Null document ids are kept as an id
    like any other; benchmark items need an id. Empty tables give an empty result; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null").dropDuplicates()

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tokens(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["item", "item_tokens"])

    read = items.mapInArrow(item_tokens, T.StructType([items.schema[0], T.StructField("item_tokens", T.ArrayType(T.LongType()))]))
    texts = read.where(F.size("item_tokens") >= max(1, least_tokens)).groupBy("item_tokens").agg(F.min("item").alias("least"), F.count_distinct("item").alias("n_items"))
    # A text is known by a number of its own: one id may have several texts, and several ids one.
    whole = materialize(texts.select(F.monotonically_increasing_id().alias("item"), "item_tokens", "least", "n_items"), "items")
    lengths = [r[0] for r in whole.select(F.least(F.size("item_tokens"), F.lit(MIN_TOKENS))).distinct().collect()]  # at most one row a length up to MIN_TOKENS
    masks = masks_for(lengths)
    found = materialize(_item_seeds(whole, masks), "seeds")
    segments = materialize(_segments(d, bitmap(found), masks).withColumn("seg", F.monotonically_increasing_id()), "segments")
    hits = segments.select("seg", F.explode(F.arrays_zip("hit_pos", "hit_h")).alias("x")).select("seg", "x.hit_pos", F.col("x.hit_h").alias("h"))
    met = hits.join(maybe_broadcast(found), "h").groupBy("seg", "item", (F.col("hit_pos") - F.col("item_pos")).alias("diag")).agg(F.count("*").alias("n_hits"))
    met = maybe_broadcast(materialize(met, "met"))  # few of the segments: those are not shuffled for it
    pairs = segments.select("seg", "id", "start", "tokens").join(met, "seg").join(maybe_broadcast(whole.select("item", "item_tokens")), "item").select("id", "item", "start", "diag", "tokens", "item_tokens")
    checked = _verified(pairs, d.schema[0], whole.schema["item"])
    best = F.max_by(F.struct("doc_start", "item_start", "n_tokens", "n_matched", "item_tokens"), F.struct("n_matched", -F.col("doc_start"), -F.col("item_start"), "n_tokens"))
    per = checked.groupBy("id", "item").agg(best.alias("b")).join(maybe_broadcast(whole.select("item", "least", "n_items")), "item")
    return per.select(F.col("id").alias(id_col), F.col("least").alias(item_col), "b.*", "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns that overlap with no benchmark item.

    Rows are known by id and text hash, so that null or repeated ids with other texts are judged on their own.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    bad = overlaps(docs.select(key.alias("__key"), text_col), benchmark, "__key", text_col, **options).select(F.col("__key.id").alias("__id"), F.col("__key.h").alias("__h")).distinct()
    bad = maybe_broadcast(materialize(bad, "contaminated"))
    return docs.withColumn("__h2", F.xxhash64(text_col)).join(bad, (F.col("__h2") == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti").drop("__h2")
