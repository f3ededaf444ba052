"""Periodic runs of words: stretches that repeat themselves often enough, found by comparing a text with itself at every lag.

A text of n words is an array of word numbers. For a lag p the array is compared with itself shifted by p, in one
vectorised comparison; a stretch of m places in a row that agree is a run of m + p words with period p, and no neighbouring word extends it.
Lags go up to n / MIN_EXPONENT, as a run has its period so many times. A run whose smallest period is a divisor of p is
found at that divisor with the same ends, so of equal stretches the least period counts.

Texts of up to LONG_BYTES are scanned where they are read: many of them lie side by side in one array, the longest first,
so that those which a lag concerns are the array's start and each lag is one comparison for all. The comparisons of a longer text
are cut into ranges of lags of bounded work, which Spark deals out to all machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import lean_arrow, materialize

#: A run has its period at least so often, and at least so many words.
MIN_EXPONENT, MIN_WORDS = 4, 6
#: Texts of more bytes are scanned by several tasks, each of which makes at most so many comparisons.
LONG_BYTES, UNIT = 1 << 17, 1 << 29
#: Words that lie side by side at most, but for one text's.
_SIDE = 400_000

#: (id, number of words) -> (first word, period) of a tail to be overwritten by repeats of its first words, or None.
Overlay = Callable[[object, int], tuple[int, int] | None]


def _numbers(words: list[bytes], base: int = 0) -> np.ndarray:
    """A number for each different word, from ``base``."""
    known = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def scan(flat: np.ndarray, reach: Callable[[int], int], lags: range) -> list[np.ndarray]:
    """For each lag rows (first place, words, period) of the stretches long enough among the first ``reach(lag)`` words of flat."""
    found = []
    for p in lags:
        own = flat[: reach(p)]
        least = max(MIN_WORDS, MIN_EXPONENT * p) - p  # places in a row that must agree
        at = np.flatnonzero(own[p:] == own[:-p])
        if len(at) < least:
            continue
        whole = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] == least - 1)
        if not len(whole):
            continue
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        starts, ends = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts, [len(at)]]) - 1] + 1
        long = ends - starts >= least
        found.append(np.stack([starts[long], (ends - starts)[long] + p, np.full(int(long.sum()), p)], 1))
    return found


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Runs (start, words, period) by start, then period; of those with the same start and words the least period."""
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each of some texts, whose word numbers are different from each other's."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([texts[i] for i in order]) if texts else np.zeros(0, np.int32)
    reach = lambda p: int(ends[k - 1]) if (k := int(np.searchsorted(-sizes, -max(MIN_EXPONENT * p, MIN_WORDS), "right"))) else 0
    top = int(sizes[0]) // MIN_EXPONENT if len(sizes) and sizes[0] >= MIN_WORDS else 0
    found = scan(flat, reach, range(1, top + 1))
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if found:
        every = np.concatenate(found)
        text = np.searchsorted(ends, every[:, 0], "right")
        every[:, 0] -= (ends - sizes)[text]
        by = np.argsort(text, kind="stable")
        cuts = np.flatnonzero(np.diff(text[by])) + 1
        for own in np.split(by, cuts):
            out[order[int(text[own[0]])]] = least_periods(every[own])
    return out


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a run after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _overlaid(words: list[bytes], name: object, overlay: Overlay | None) -> list[bytes]:
    if overlay is None or not words or (got := overlay(name, len(words))) is None:
        return words
    a, p = got
    tail = words[a : a + p]
    return words[:a] + (tail * ((len(words) - a) // max(len(tail), 1) + 1))[: len(words) - a]


_RESULT = "n_words long, starts array<long>, lengths array<long>, periods array<long>, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _row(words: list[bytes], runs: np.ndarray, keep_text: bool) -> tuple:
    gone = dropped(runs, len(words)) if len(runs) else None
    text = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
    said = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return len(words), runs[:, 0], runs[:, 1], runs[:, 2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text if keep_text else None


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.string(), pa.string(), pa.binary()]
    own = [pa.array(c, k) for c, k in zip(cols, kinds)]
    own[-1] = own[-1].cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, *own], names=["id", "n_words", "starts", "lengths", "periods", "runs_sha256", "collapsed_sha256", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlay: Overlay | None = None, keep_text: bool = True, long_bytes: int = LONG_BYTES, unit: int = UNIT) -> DataFrame:
    """A row for each row of ``docs``: the id, n_words, its runs (starts, lengths, periods, by start, then period), SHA-256 of their list, and the collapsed text and its SHA-256.

    Words are what lies between ASCII white space. A run has at least MIN_WORDS words and MIN_EXPONENT times its smallest
    period. The collapsed text has every word that no run holds after its first period, joined by one space.
    Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or repeated: rows are never
    put together by them. Other columns are not read; an empty table gives no rows. ``overlay`` rewrites tails first.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text")
    result = T.StructType([own.schema[0], *T._parse_datatype_string(_RESULT).fields])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for batch in batches:
            texts, names = batch.column(1).cast(pa.binary()), batch.column(0).to_pylist() if overlay else [None] * batch.num_rows
            first, words, numbers, base = 0, [], [], 0
            for i in range(batch.num_rows):
                words.append(_overlaid(texts[i].as_py().split(), names[i], overlay))
                numbers.append(_numbers(words[-1], base))
                base += len(words[-1])
                if base >= _SIDE or i + 1 == batch.num_rows:
                    yield _batch(batch.column(0).slice(first, len(words)), [_row(w, r, keep_text) for w, r in zip(words, _runs_of(numbers))])
                    first, words, numbers, base = i + 1, [], [], 0

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, text, key = (batch.column(c)[i].as_py() for c in range(3))
                words = _overlaid(text.encode().split(), name, overlay)
                n, top = len(words), len(words) // MIN_EXPONENT
                step = max(1, unit // max(n, 1))
                los = list(range(1, top + 1, step))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(los), pa.int64()), pa.array(los, pa.int64()), pa.array([min(lo + step, top + 1) for lo in los], pa.int64()), pa.array([_numbers(words).tobytes()] * len(los), pa.binary())], names=["key", "lo", "hi", "numbers"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for batch in batches:
            for i in range(batch.num_rows):
                key, lo, hi, data = (batch.column(c)[i].as_py() for c in range(4))
                flat = np.frombuffer(data, np.int32)
                found = scan(flat, lambda p: len(flat), range(lo, hi))
                every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(every), pa.int64()), *(pa.array(every[:, c], pa.int64()) for c in range(3))], names=["key", "start", "length", "period"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        for batch in batches:
            for i in range(batch.num_rows):
                name, text, runs = (batch.column(c)[i].as_py() for c in range(3))
                words = _overlaid(text.encode().split(), name, overlay)
                own = np.array([(r["start"], r["length"], r["period"]) for r in runs or []], np.int64).reshape(-1, 3)
                yield _batch(batch.column(0).slice(i, 1), [_row(words, own[np.lexsort((own[:, 2], own[:, 0]))], keep_text)])

    short = own.where(size <= long_bytes).mapInArrow(here, result)
    long = own.where(size > long_bytes).withColumn("key", F.monotonically_increasing_id())
    long = materialize(long, "runs-long")
    if long.isEmpty():
        return short.withColumnRenamed("id", id_col)
    dealt = long.mapInArrow(numbered, "key long, lo long, hi long, numbers binary").repartition(F.col("key"), F.col("lo"))
    per = dealt.mapInArrow(ranges, "key long, start long, length long, period long").groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    per = per.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    rest = long.join(per, "key", "left").select("id", "text", "runs").mapInArrow(whole, result)
    return short.unionByName(rest).withColumnRenamed("id", id_col)
