"""Phrase collocations from depth-limited count tries.

Every shard of the corpus (a bounded number of words) becomes a trie whose paths are phrases of up to DEPTH words with their
counts. A trie is serialised sorted: preorder, words in byte order, in blocks of bounded size. Blocks are cut by ranges of
prefixes, and each range is a k-way merge of the shards' sorted runs, which adds the counts of equal paths. The walk of a
merged trie keeps the counts of the path it is on: those of a phrase's left parts. Suffix links, from each path to the one without its first
word, give the counts of its right parts.

A phrase that occurs LEAST times has only parts that do. So words are counted first, then pairs of frequent words, by hash,
and tries hold only paths whose words and pairs pass two bitmaps. A bitmap lets some that are too rare pass, never stops one that is not; counts come from the tries alone.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecube.llm.common import bitmap, discard, lean_arrow, materialize, passing

DEPTH, LEAST, TOP = 4, 30, 2_000
#: Words of a shard; different words that are counted before they are sent on.
SHARD_WORDS, COUNTED = 1 << 22, 400_000
#: Nodes of a block, of a range on average, and the most ranges: beyond that ranges grow.
BLOCK, RANGE, RANGES = 4_096, 400_000, 65_536
#: Hashed pairs that one task adds up, on average.
PAIRS = 3_000_000
UNDETERMINED = "und"
_BREAK = b"\xff"  # no byte of UTF-8 text
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, and _BREAK between pieces."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        yield lang, words_of(text.as_py())


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n); the row without a word has all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        held: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(_BREAK, None)
                words, n = [*c, None], [*c.values(), sum(c.values())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, words in _texts(batch):
                held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > COUNTED:
                yield from sent()
        yield from sent()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """A number for each word; _BREAK has 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _shards(batches: Iterable[pa.RecordBatch], shard_words: int) -> Iterator[list[tuple[str, list[bytes], np.ndarray]]]:
    """Shards, each a list of (language, its different words, their numbers in the texts' order); a text ends with a break."""
    known: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    held = 0
    done = lambda: [(lang, list(own), np.concatenate(ids)) for lang, (own, ids) in known.items()]
    for batch in batches:
        for lang, words in _texts(batch):
            own, ids = known.setdefault(lang, (_Numbers({_BREAK: 0}), []))
            words.append(_BREAK)
            ids.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held >= shard_words:
                yield done()
                known, held = {}, 0
    if held:
        yield done()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64(lang, word) gives, unsigned."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (h[a] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[b] >> np.uint64(7))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= h[b]
    return x ^ (x >> np.uint64(29))


def _frequent(lang: str, words: list[bytes], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, whether each may be frequent)."""
    h = _hashes(lang, words)
    ok = np.zeros(len(words), bool)
    ok[passing(h, bits)] = True
    ok[0] = False
    return h, ok


def _pairs(docs: DataFrame, word_bits: np.ndarray, buckets_log2: int, shard_words: int) -> DataFrame:
    """h of the pairs of frequent words that occur often enough."""
    shared = docs.sparkSession.sparkContext.broadcast(word_bits)
    shift = np.uint64(64 - buckets_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for shard in _shards(batches, shard_words):
            parts = []
            for lang, words, ids in shard:
                h, ok = _frequent(lang, words, shared.value)
                at = np.flatnonzero(ok[ids[:-1]] & ok[ids[1:]])
                parts.append(np.unique(_pair_hashes(h, ids[at], ids[at + 1]), return_counts=True))
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h)
            h, n = h[order], n[order].astype(np.uint32)
            bucket = (h >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            edges = [0, *cuts.tolist(), len(h)] if len(h) else [0]
            rows = [(int(bucket[lo]), h[lo:hi].tobytes(), n[lo:hi].tobytes()) for lo, hi in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "h", "n"])

    def added(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["h"]])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["n"]])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.table({"h": pa.array(h[first][np.add.reduceat(n, first) >= LEAST].view(np.int64))})

    return docs.mapInArrow(run, "bucket long, h binary, n binary").groupBy("bucket").applyInArrow(added, "h long")


# Tries.

_TRIE = "shard string, seq int, lang string, first array<string>, last array<string>, nodes int, depths binary, words binary, counts binary"
Path = tuple[bytes, ...]


def trie(words: list[bytes], ids: np.ndarray, h: np.ndarray, ok: np.ndarray, pair_bits: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(sorted words, paths as rows of DEPTH word ranks in preorder, -1 beyond a path's end, counts) of one language of a shard."""
    kept = np.flatnonzero(ok)
    order = sorted(kept.tolist(), key=words.__getitem__)
    rank = np.full(len(words), -1, np.int64)
    rank[order] = np.arange(len(order))
    own, size = rank[ids], max(len(order), 1)
    both = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
    pair = np.zeros(len(own), bool)  # the pair that starts here may be frequent
    pair[both[passing(_pair_hashes(h, ids[both], ids[both + 1]), pair_bits)]] = True
    at = np.flatnonzero(own >= 0)
    node = own[at]  # of the paths that start at these places
    paths, counts = [np.arange(len(order))[:, None]], [np.bincount(node, minlength=len(order))]
    for depth in range(1, DEPTH):
        on = pair[at + depth - 1]
        at, node = at[on], node[on]
        key, node, n = np.unique(node * size + own[at + depth], return_inverse=True, return_counts=True)
        paths.append(np.concatenate([paths[-1][key // size], (key % size)[:, None]], 1))
        counts.append(n)
    every = np.concatenate([np.pad(p, ((0, 0), (0, DEPTH - p.shape[1])), constant_values=-1) for p in paths])
    by = np.lexsort(every.T[::-1])
    return [words[i] for i in order], every[by], np.concatenate(counts)[by]


def _tries(docs: DataFrame, word_bits: np.ndarray, pair_bits: np.ndarray, shard_words: int, block: int) -> DataFrame:
    """The shards' tries as blocks: rows of _TRIE."""
    shared = docs.sparkSession.sparkContext.broadcast((word_bits, pair_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        part = TaskContext.get().partitionId()
        for k, shard in enumerate(_shards(batches, shard_words)):
            for lang, words, ids in shard:
                h, ok = _frequent(lang, words, shared.value[0])
                names, paths, counts = trie(words, ids, h, ok, shared.value[1])
                depths = (paths >= 0).sum(1)
                ends = paths[np.arange(len(paths)), depths - 1]
                for seq, lo in enumerate(range(0, len(paths), block)):
                    hi = min(lo + block, len(paths))
                    path = lambda i: [names[w] for w in paths[i, : depths[i]].tolist()]  # noqa: E731, B023
                    yield _block(f"{part}-{k}", seq, lang, path(lo), path(hi - 1), depths[lo:hi], [names[w] for w in ends[lo:hi].tolist()], counts[lo:hi])

    return docs.mapInArrow(run, _TRIE)


def _block(shard: str, seq: int, lang: str, first: list[bytes], last: list[bytes], depths: np.ndarray, words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    strings = lambda x: pa.array([x], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
    cells = [pa.array([shard]), pa.array([seq], pa.int32()), pa.array([lang]), strings(first), strings(last), pa.array([len(words)], pa.int32())]
    blobs = [np.asarray(depths, np.uint8).tobytes(), b" ".join(words), np.asarray(counts, np.int64).tobytes()]
    return pa.RecordBatch.from_arrays([*cells, *(pa.array([b], pa.binary()) for b in blobs)], names=["shard", "seq", "lang", "first", "last", "nodes", "depths", "words", "counts"])


def _nodes(row: dict) -> Iterator[tuple[Path, int]]:
    """(path, count) of a block; a path starts with its language."""
    path = [row["lang"].encode(), *(w.encode() for w in row["first"])]
    for depth, word, n in zip(row["depths"], row["words"].split(b" "), np.frombuffer(row["counts"], np.int64).tolist()):
        path[depth:] = [word]
        yield tuple(path), n


def _path(lang: str, words: list[str]) -> Path:
    return (lang.encode(), *(w.encode() for w in words))


def _cut(tries: DataFrame, bounds: list[Path]) -> DataFrame:
    """Blocks with the range that they lie in; a block over a bound is cut there.

    A range starts with the paths above its bound: their counts go to it too, so that the walk knows them.
    """
    shared = tries.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        own = shared.value
        above: dict[Path, list[int]] = {}
        for r, b in enumerate(own, 1):
            for d in range(2, len(b)):
                above.setdefault(b[:d], []).append(r)
        ghosts = sorted(above)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.to_pylist()[0]
                first, last = _path(row["lang"], row["first"]), _path(row["lang"], row["last"])
                lo = bisect_right(own, first)
                if lo == bisect_right(own, last) and bisect_left(ghosts, first) == bisect_right(ghosts, last):
                    yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), *one.columns], names=["range", *one.schema.names])
                    continue
                parts: dict[tuple[int, bool], list[tuple[Path, int]]] = {}
                for path, n in _nodes(row):
                    parts.setdefault((bisect_right(own, path), False), []).append((path, n))
                    for r in above.get(path, ()):
                        parts.setdefault((r, True), []).append((path, n))
                for (r, ghost), nodes in parts.items():
                    names = [p[-1] for p, _ in nodes]
                    # Paths above a bound are a run of their own, each a part of the next one.
                    out = _block(row["shard"] + ("/" if ghost else ""), row["seq"], row["lang"], list(nodes[0][0][1:]), list(nodes[-1][0][1:]), np.array([len(p) - 1 for p, _ in nodes]), names, np.array([n for _, n in nodes]))
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *out.columns], names=["range", *out.schema.names])

    return tries.mapInArrow(run, f"range int, {_TRIE}")


def _merged(cut: DataFrame, bounds: list[Path]) -> DataFrame:
    """(lang, words, n, lefts) of the paths of all shards that occur often enough; lefts: the counts of the paths above."""
    shared = cut.sparkSession.sparkContext.broadcast(bounds)

    def run(table: pa.Table) -> pa.Table:
        lean_arrow()
        rows = sorted(table.to_pylist(), key=itemgetter("shard", "lang", "seq"))
        r = rows[0]["range"]
        start = shared.value[r - 1] if r else ()
        runs = [chain.from_iterable(map(_nodes, list(own))) for _, own in groupby(rows, itemgetter("shard", "lang"))]
        langs, words, counts, lefts, on = [], [], [], [], [0] * (DEPTH + 2)
        for path, same in groupby(heapq.merge(*runs), itemgetter(0)):
            depth = len(path) - 1
            n = on[depth] = sum(x[1] for x in same)
            if n >= LEAST and path >= start:
                langs.append(path[0])
                words.append(path[1:])
                counts.append(n)
                lefts.append(on[1:depth])
        text = pa.string()
        return pa.table({"lang": pa.array(langs, pa.binary()).cast(text), "words": pa.array(words, pa.list_(pa.binary())).cast(pa.list_(text)), "n": pa.array(counts, pa.int64()), "lefts": pa.array(lefts, pa.list_(pa.int64()))})

    return cut.groupBy("range").applyInArrow(run, "lang string, words array<string>, n long, lefts array<long>")


def _bounds(tries: DataFrame, per_range: int) -> list[Path]:
    """Where ranges start, from the first paths of about four blocks a range: they decide how even the ranges are, nothing else."""
    blocks, nodes = tries.agg(F.count("*"), F.coalesce(F.sum("nodes"), F.lit(0))).first()
    ranges = min(max(1, nodes // per_range), RANGES)
    every = max(1, blocks // (4 * ranges))
    seen = tries.where(F.pmod(F.xxhash64("shard", "lang", "seq"), F.lit(every)) == 0).select("lang", "first").toArrow() if ranges > 1 else None
    paths = sorted({_path(lang, words) for lang, words in zip(seen["lang"].to_pylist(), seen["first"].to_pylist())}) if seen is not None else []
    return sorted({paths[k * len(paths) // ranges] for k in range(1, ranges)}) if paths else []


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, block: int = BLOCK, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """((lang, words, n, lefts) of all phrases of up to DEPTH words that occur LEAST times, (lang, n) of all words)."""
    own = docs.select(F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = materialize(_word_counts(own).where(F.col("word").isNull() | (F.col("n") >= LEAST)), "phrase-words")
    totals = counted.where("word IS NULL").select("lang", "n")
    word_bits = bitmap(counted.where("word IS NOT NULL").select(F.xxhash64("lang", "word").alias("h")))
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = materialize(_pairs(own, word_bits, max(6, (every // PAIRS).bit_length()), shard_words), "phrase-pairs")
    tries = materialize(_tries(own, word_bits, bitmap(pairs), shard_words, block), "phrase-tries")
    discard(pairs)
    bounds = _bounds(tries, per_range)
    found = materialize(_merged(_cut(tries, bounds), bounds), "phrase-counts")
    discard(tries)
    return found, totals


def with_right_parts(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, lefts and rights of phrases of two words and more: rights[k] is the count without the first k + 1 words.

    A suffix link leads from a phrase to the one without its first word; that one's count is the first right part, and its right parts are the others.
    """
    own = found.withColumn("phrase", F.array_join("words", " ")).withColumn("link", F.array_join(F.slice("words", 2, DEPTH), " "))
    level = own.where(F.size("words") == 1).withColumn("rights", F.array().cast("array<long>"))
    out = None
    for depth in range(2, DEPTH + 1):
        to = level.select(F.col("lang"), F.col("phrase").alias("link"), F.concat(F.array("n"), "rights").alias("rights"))
        level = materialize(own.where(F.size("words") == depth).join(to, ["lang", "link"]), "phrase-links")
        out = level if out is None else out.unionByName(level)
    return out.select("lang", "phrase", "words", F.col("n").alias("a"), "lefts", "rights")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, **sizes: int) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    The score is floor(2000000 a / (l + r)) at the cut where that is lowest, then the first; decimals keep it exact. A phrase
    inside a longer one that occurs at least 0.8 times as often is dropped. Null languages are ``und``, null texts
    empty. Repeated rows count as often as they come; ids and other columns are not read. No words: no rows.
    """
    found, totals = count_phrases(docs, text_col, lang_col, **sizes)
    phrases = with_right_parts(found)
    cut = F.expr("array_min(transform(sequence(1, size(lefts)), k -> struct((cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) div (cast(lefts[k - 1] AS decimal(20,0)) + rights[k - 1]) AS score, k AS k, lefts[k - 1] AS l, rights[k - 1] AS r)))")
    subs = [(d, k) for d in range(2, DEPTH) for k in range(1, DEPTH - d + 2)]
    inside = F.array(*(F.when(F.size("words") > F.greatest(F.lit(d), F.lit(k + d - 2)), F.array_join(F.slice("words", k, d), " ")) for d, k in subs))
    larger = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array_compact(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("larger"))
    kept = phrases.join(larger, ["lang", "phrase"], "left").where(F.col("larger").isNull() | (5 * F.col("larger") < 4 * F.col("a")))
    scored = kept.withColumn("c", cut).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").cast("long").alias("score"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    first = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
