"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

Documents are ordered by id, tokenized in their order, and cut into segments: a segment holds whole documents until it has
SEGMENT ids, and a document that is longer has segments of its own. The ids of all segments are counted, and the counts
make one frequency table that every block of every file is coded with.

Up to BLOCK_SEGMENTS segments that follow each other form a block: one independent stream of LANES interleaved states, which
starts from the same value in every block and ends in it. At each segment's start the block has a checkpoint, the states
that a decoder needs to begin there; so any segment is decoded by itself, by any task. A segment's bytes (its
documents, states and words) have a checksum, and a decoder that does not use up exactly its words says so.

A file: MAGIC, the segments' bytes, the index (a row for each segment), the index's length and checksum, MAGIC. Tasks
write files under names of their own, and the table of files that Spark commits says which of them count: what a lost
executor or a second attempt leaves is not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import discard, lean_arrow, materialize, shared_dir

MAGIC = b"TIDERANS"
#: States of a stream: the width of every vectorised step.
LANES = 1_024
#: A segment is closed when it has so many ids; a longer document is cut at every so many.
SEGMENT = 1 << 18
BLOCK_SEGMENTS = 4
#: Segments that a reading task decodes, on average.
SEGMENTS_A_TASK = 8
#: States stay in [LOW, 2^32 * LOW) and move by 32 bits.
LOW = 1 << 31
#: Runs of characters whose ids a worker keeps; it forgets them all when it would have more.
CACHE = 1_200_000
_BYTES = np.arange(256, dtype=np.uint8)
#: Of each byte, whether it is of a run of letters (or beyond ASCII), and its lower case.
_LETTERS = (_BYTES >= 0x80) | (_BYTES | 32 >= ord("a")) & (_BYTES | 32 <= ord("z"))
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES | 32, _BYTES)
#: Runs of letters that go through the tokenizer as one line.
_LINE = 500
#: Bytes of texts that are encoded at once, but for one text's.
_TEXTS = 12 << 20
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4"), ("words", "<u4"), ("pieces", "<u4"), ("names", "<u4"), ("crc", "<u4"), ("first_token", "<u8"), ("first_doc", "<u8"), ("first_at", "<u8"), ("open", "u1")])

#: Texts (strings without nulls) -> (the ids of all, how many each has).
Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def word_encoder(path: str, cache: int = CACHE) -> Encode:
    """ids of texts by a tokenizer of the tokenizers library that looks neither across white space nor from letters to what is none, but for apostrophes.

    Such a tokenizer gives a text the ids of its runs of letters and of other characters, one after the other; each different
    run goes through the library once, many at a time, and is remembered. Parts between white space that hold an apostrophe, a
    special token or signs beyond ASCII that are no letters go through it whole.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    own = Tokenizer.from_file(path)
    width = np.uint16 if own.get_vocab_size() <= 1 << 16 else np.uint32
    lowers = own.encode("ABC xyz", add_special_tokens=False).ids == own.encode("abc xyz", add_special_tokens=False).ids
    special = [t.content.lower().encode() for t in own.get_added_tokens_decoder().values()]
    runs: dict[bytes, bytes] = {}

    suffix = getattr(own.model, "end_of_word_suffix", None)
    last = np.zeros(own.get_vocab_size(), bool)  # of each id, whether a word ends with it
    if suffix:
        last[[i for t, i in own.get_vocab().items() if t.endswith(suffix)]] = True

    def whole(some: list[bytes]) -> dict[bytes, bytes]:
        plain = [x for x in some if x.isalpha()] if suffix else []
        out = in_lines(plain)
        rest = [x for x in some if x not in out]
        found = own.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)
        out.update((x, np.array(e.ids, width).tobytes()) for x, e in zip(rest, found))
        return out

    def in_lines(plain: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs of ASCII letters from lines of them, cut where words end; of no run of a line that has another number of ends."""
        out: dict[bytes, bytes] = {}
        lines = [plain[i : i + _LINE] for i in range(0, len(plain), _LINE)]
        for line, e in zip(lines, own.encode_batch_fast([b" ".join(line).decode() for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, width)
            ends = ((np.flatnonzero(last[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) == len(line) and ends[-1] == ids.nbytes:
                flat = ids.tobytes()
                out.update(zip(line, [flat[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def runs_of(parts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the runs of all parts one after the other, the part of each): runs whose ends are ends for the tokenizer too; else the part is one run."""
        n = len(parts)
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + n + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
        part, raw, beyond = np.repeat(np.arange(n, dtype=np.int32), sizes), data.tobytes(), data >= 0x80
        one, plain = np.zeros(n, bool), np.ones(n, bool)
        one[part[data == ord("'")]] = True
        plain[part[beyond]] = False
        every = raw.lower()
        for t in special:
            at = every.find(t)
            while at >= 0:
                if part[at] == part[at + len(t) - 1]:
                    one[part[at]] = True
                at = every.find(t, at + 1)
        letters = _LETTERS[data]
        begins = np.append(True, letters[1:] != letters[:-1])
        begins[starts[sizes > 0]] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(data)) - 1
        for k in np.flatnonzero(beyond[first] | beyond[last]).tolist():
            text = raw[first[k] : last[k] + 1].decode("utf-8", "replace")
            if not (text[0].isalpha() and text[-1].isalpha()):
                one[part[first[k]]] = True
        begins &= ~one[part]
        begins[starts[sizes > 0]] = True
        if lowers:
            data = np.where((plain & ~one)[part], _LOWER[data], data)
        first = np.flatnonzero(begins)
        ends = np.append(first, len(data)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return runs.dictionary_encode(), part[first]

    def ids_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has)."""
        if not pc.sum(pc.binary_length(parts)).as_py():
            return np.zeros(0, width), np.zeros(len(parts), np.int32)
        own, part = runs_of(parts)
        ends, data = np.frombuffer(own.dictionary.buffers()[1], np.int32)[: len(own.dictionary) + 1].tolist(), own.dictionary.buffers()[2].to_pybytes()
        different = [data[a:b] for a, b in zip(ends, ends[1:])]
        if len(runs) + len(different) > cache:
            runs.clear()
        found = list(map(runs.get, different))
        if new := [x for x, ids in zip(different, found) if ids is None]:
            runs.update(whole(new))
            found = [runs[x] if ids is None else ids for x, ids in zip(different, found)]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // np.dtype(width).itemsize
        at = own.indices.to_numpy()
        return gathered(np.frombuffer(b"".join(found), width), sizes, at), np.bincount(part, sizes[at], len(parts)).astype(np.int32)

    def gathered(each: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The pieces of ``each``, of these sizes, in the order of their numbers ``at``; a batch's places fit 32 bits."""
        n = sizes[at]
        shift = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n)
        return each[np.repeat(shift.astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        words = split.flatten().dictionary_encode()
        each, sizes = ids_of(words.dictionary.cast(pa.binary()))
        at = words.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        return gathered(each, sizes, at), np.diff(np.concatenate([[0], ends])[edges])

    return encode


def text_encoder(path: str) -> Encode:
    """ids of texts by any tokenizer of the tokenizers library: every whole text goes through the library."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path)
    width = np.uint16 if own.get_vocab_size() <= 1 << 16 else np.uint32

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array(e.ids, width) for e in own.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*rows, np.zeros(0, width)]), np.array([len(r) for r in rows], np.int64)

    return encode


_ENCODERS: dict[tuple, Encode] = {}


def _encoder(make: Callable[[str], Encode], path: str) -> Encode:
    """One encoder a worker, so that what it remembers serves its next task too."""
    key = (make.__module__, make.__qualname__, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = make(path)
    return _ENCODERS[key]


# The coder.


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(a frequency for each id, log2 of their sum): at least 1 for every id that occurs, the rest in proportion, what rounding leaves to the most frequent."""
    used = int((counts > 0).sum())
    log2 = max(16, used.bit_length() + 3)
    own = (counts > 0).astype(np.int64)
    if used:
        own += np.floor(counts.astype(np.float64) / float(counts.sum()) * ((1 << log2) - used)).astype(np.int64)
        own[int(np.argmax(counts))] += (1 << log2) - int(own.sum())
    return own.astype(np.uint64), log2


class Coder:
    """Codes arrays of ids by a table of frequencies."""

    def __init__(self, freq: np.ndarray, log2: int):
        self.freq, self.log2 = freq.astype(np.uint64), log2
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slots: np.ndarray | None = None

    def encode(self, segments: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(states at its start, words) of each segment of one stream. The coder runs from the last id to the first."""
        x = np.full(LANES, LOW, np.uint64)
        m, top, low = np.uint64(self.log2), np.uint64(LOW >> self.log2 << 32), np.uint64(0xFFFFFFFF)
        out = []
        for ids in reversed(segments):
            f, c, words = self.freq[ids], self.start[ids], []
            if len(f) and not f.all():
                raise ValueError("an id that the table of frequencies has not")
            for lo in range((len(ids) - 1) // LANES * LANES if len(ids) else -1, -1, -LANES):
                g, s = f[lo : lo + LANES], c[lo : lo + LANES]
                own = x[: len(g)]
                full = own >= top * g
                words.append((own[full] & low).astype(np.uint32))
                own = np.where(full, own >> np.uint64(32), own)
                q = own // g
                x[: len(g)] = (q << m) + (own - q * g) + s
            out.append((x.copy(), np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)))
        return out[::-1]

    def decode(self, states: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n ids, states after them)."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        x, m, mask = states.copy(), np.uint64(self.log2), np.uint64((1 << self.log2) - 1)
        ids, at, words = np.empty(n, np.uint32), 0, words.astype(np.uint64)
        for lo in range(0, n, LANES):
            own = x[: min(LANES, n - lo)]
            slot = own & mask
            s = self.slots[slot]
            ids[lo : lo + LANES] = s
            own = self.freq[s] * (own >> m) + slot - self.start[s]
            short = np.flatnonzero(own < np.uint64(LOW))
            own[short] = own[short] << np.uint64(32) | words[at : at + len(short)]
            at += len(short)
            x[: len(own)] = own
        if at != len(words):
            raise ValueError("a segment's words don't end with its ids")
        return ids, x


# Segments.

_SEGMENT = "part int, seq int, ids binary, names array<string>, lengths array<int>, first_doc long, first_at long, open boolean"


def _segments(docs: DataFrame, make: Callable[[str], Encode], path: str, end: int | None, size: int) -> DataFrame:
    """Rows of _SEGMENT of documents (name, text) that come in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        encode, part = _encoder(make, path), TaskContext.get().partitionId()
        ids, names, lengths, held, seq, doc, first = [], [], [], 0, 0, 0, 0

        def closed(first_at: int = 0, is_open: bool = False) -> pa.RecordBatch:
            nonlocal ids, names, lengths, held, seq, first
            row = {"part": part, "seq": seq, "ids": b"".join(x.tobytes() for x in ids), "names": names, "lengths": lengths, "first_doc": first, "first_at": first_at, "open": is_open}
            ids, names, lengths, held, seq, first = [], [], [], 0, seq + 1, doc
            return pa.RecordBatch.from_pylist([row], schema)

        def encoded(texts: pa.Array) -> Iterator[np.ndarray]:
            bytes_of = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(bytes_of, (bytes_of[first - 1] if first else 0) + _TEXTS, "right")))
                flat, n = encode(texts.slice(first, last - first))
                if end is not None:
                    flat, n = np.insert(flat, np.cumsum(n), end), n + 1
                yield from np.split(flat, np.cumsum(n)[:-1])
                first = last

        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                if len(own) > size:  # a document that has segments of its own
                    if names:
                        yield closed()
                    for at in range(0, len(own), size):
                        ids, names, lengths, first = [own[at : at + size]], [name], [min(size, len(own) - at)], doc
                        if at + size >= len(own):
                            doc += 1
                        yield closed(at, at + size < len(own))
                    continue
                ids.append(own)
                names.append(name)
                lengths.append(len(own))
                held, doc = held + len(own), doc + 1
                if held >= size or len(names) >= size:
                    yield closed()
        if names:
            yield closed()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.binary()), ("names", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("first_doc", pa.int64()), ("first_at", pa.int64()), ("open", pa.bool_())])
    return docs.mapInArrow(run, _SEGMENT)


def _counts(segments: DataFrame, vocabulary: int, width: str) -> np.ndarray:
    """How often each id occurs in all segments; what comes back is at most a row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), width), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])

    got = segments.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


# Files.


def _opened(path: str):
    """(file system, path in it) of a URL or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _File:
    """Writes one file, block by block."""

    def __init__(self, path: str):
        system, inner = _opened(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.out, self.at, self.index, self.tokens, self.docs = path, system.open_output_stream(inner), len(MAGIC), [], 0, 0
        self.out.write(MAGIC)

    def block(self, coder: Coder, rows: list[dict], width: str) -> None:
        coded = coder.encode([np.frombuffer(r["ids"], width) for r in rows])
        for r, (states, words) in zip(rows, coded):
            names = [b"\0" if n is None else b"\1" + n.encode("utf-8", "surrogatepass") for n in r["names"]]
            text = b"".join(names)
            data = b"".join([np.array(r["lengths"], "<u4").tobytes(), np.array([len(n) for n in names], "<u4").tobytes(), text, states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
            n = sum(r["lengths"])
            self.index.append((self.at, len(data), n, len(words), len(names), len(text), zlib.crc32(data), self.tokens, r["first_doc"], r["first_at"], r["open"]))
            self.out.write(data)
            self.at, self.tokens, self.docs = self.at + len(data), self.tokens + n, self.docs + len(names)

    def close(self) -> None:
        index = np.array(self.index, _INDEX).tobytes()
        self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
        self.out.close()


def _written(segments: DataFrame, folder: str, coder: Coder, width: str) -> DataFrame:
    """Writes the segments; a row for each file: part, seq (of its first segment), path, tokens."""
    shared = segments.sparkSession.sparkContext.broadcast((coder.freq, coder.log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        own, file, first, block = Coder(*shared.value), None, None, []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if file is not None:
                if block:
                    file.block(own, block, width)
                file.close()
                yield pa.RecordBatch.from_pylist([{"part": first[0], "seq": first[1], "path": file.path, "tokens": file.tokens}], schema)
            block = []

        last = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if last != (r["part"], r["seq"] - 1):
                    yield from closed()
                    first = (r["part"], r["seq"])
                    file = _File(f"{folder}/part-{r['part']:06d}-{r['seq']:06d}-{uuid.uuid4().hex}.rans")
                block.append(r)
                if len(block) == BLOCK_SEGMENTS:
                    file.block(own, block, width)
                    block = []
                last = (r["part"], r["seq"])
        yield from closed()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("tokens", pa.int64())])
    return segments.mapInArrow(run, "part int, seq int, path string, tokens long")


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, words_apart: bool = False, folder: str | None = None, segment: int = SEGMENT) -> str:
    """Write the ids of every text of ``docs`` to files in ``folder`` (a new one in the shared folder); returns the folder.

    Documents come in ascending order of id, null ids first, and equal ids in the order of their rows; files' names are in
    that order too. ``end`` is appended to each document. A null text is an empty one. Ids may be of any type that can be
    ordered and cast to text and back; other columns are not read. ``words_apart`` says that the tokenizer never looks
    across white space and more (see word_encoder). ``tokenizer`` is a file that every executor has. An empty table writes no file.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end or 0) + 1)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    # Only the id and the place are sampled for the ranges; the place deals out rows of equal ids.
    placed = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("text"))
    ordered = placed.repartitionByRange(F.col("id").asc_nulls_first(), F.col("at")).sortWithinPartitions(F.col("id").asc_nulls_first(), "at")
    segments = materialize(_segments(ordered.select(F.col("id").cast("string"), F.coalesce("text", F.lit(""))), word_encoder if words_apart else text_encoder, tokenizer, end, segment), "token-segments")
    freq, log2 = frequencies(_counts(segments, vocabulary, width))
    _written(segments, folder, Coder(freq, log2), width).write.parquet(f"{folder}/files")
    discard(segments)
    used = np.flatnonzero(freq)
    rows = spark.createDataFrame([(log2, len(freq), used.astype("<u4").tobytes(), freq[used].astype("<u4").tobytes())], "log2 int, size int, ids binary, freqs binary")
    rows.coalesce(1).write.parquet(f"{folder}/frequencies")
    return folder


def read_tokens(spark: SparkSession, folder: str, id_type: T.DataType | str = "long") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files: ids are unsigned 32-bit little-endian numbers, start counts the ids of all documents before it.

    Files, then segments, are dealt to tasks; each segment is decoded from its own checkpoint. Only documents that have several segments are put together by a shuffle.
    """
    log2, size, ids, freqs = spark.read.parquet(f"{folder}/frequencies").first()
    freq = np.zeros(size, np.uint64)
    freq[np.frombuffer(ids, "<u4")] = np.frombuffer(freqs, "<u4")
    shared = spark.sparkContext.broadcast((freq, log2))
    before = F.coalesce(F.sum("tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    files = spark.read.parquet(f"{folder}/files").withColumn("base", before)

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, inner = _opened(r["path"])
                with system.open_input_file(inner) as f:
                    end = f.size() - 12 - len(MAGIC)
                    length, crc = struct.unpack("<QI", f.read_at(12, end))
                    data = f.read_at(length, end - length)
                    if f.read_at(len(MAGIC), 0) != MAGIC or f.read_at(len(MAGIC), end + 12) != MAGIC or zlib.crc32(data) != crc:
                        raise ValueError(f"{r['path']} is not a whole file of tokens")
                index = np.frombuffer(data, _INDEX)
                after = index["first_at"] > 0
                columns = [pa.array([r["part"]] * len(index), pa.int32()), pa.array([r["path"]] * len(index)), pa.array([r["base"]] * len(index), pa.int64())]
                entries = [index[i : i + 1].tobytes() for i in range(len(index))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(entries, pa.binary()), pa.array(after | (index["open"] > 0))], names=["part", "path", "base", "entry", "cut"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        coder = Coder(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                e = np.frombuffer(r["entry"], _INDEX)[0]
                system, inner = _opened(r["path"])
                with system.open_input_file(inner) as f:
                    data = f.read_at(int(e["length"]), int(e["offset"]))
                if zlib.crc32(data) != e["crc"]:
                    raise ValueError(f"{r['path']}: the segment at {e['offset']} is damaged")
                n, w = int(e["pieces"]), int(e["words"])
                lengths, sizes = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u4", n, 4 * n)
                text = data[8 * n : 8 * n + int(e["names"])]
                at = 8 * n + int(e["names"])
                own, _ = coder.decode(np.frombuffer(data, "<u8", LANES, at), np.frombuffer(data, "<u4", w, at + 8 * LANES), int(e["tokens"]))
                ends, stops = np.cumsum(lengths.astype(np.int64)), np.cumsum(sizes.astype(np.int64))
                names = [None if text[b - s : b - s + 1] == b"\0" else text[b - s + 1 : b].decode("utf-8", "surrogatepass") for b, s in zip(stops.tolist(), sizes.tolist())]
                flat = own.astype("<u4").tobytes()
                rows = [flat[4 * (b - s) : 4 * b] for b, s in zip(ends.tolist(), lengths.tolist())]
                start = int(r["base"]) + int(e["first_token"]) + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * n, pa.int32()), pa.array(int(e["first_doc"]) + np.arange(n), pa.int64()), pa.array(names, pa.string()), pa.array(start, pa.int64()), pa.array(rows, pa.binary())],
                    names=["part", "doc", "name", "start", "ids"],
                )

    entries = files.select("part", "path", "base").mapInArrow(indexes, "part int, path string, base long, entry binary, cut boolean")
    dealt = materialize(entries, "token-index")
    segments = max(1, dealt.count() // SEGMENTS_A_TASK)
    read = lambda own: own.repartition(segments, F.xxhash64("entry", "path")).drop("cut").mapInArrow(decode, "part int, doc long, name string, start long, ids binary")
    whole = read(dealt.where("NOT cut")).select("name", "start", "ids")
    parts = read(dealt.where("cut")).groupBy("part", "doc").agg(F.first("name").alias("name"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("x"))
    joined = parts.select("name", "start", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    n_tokens: Column = F.expr("octet_length(ids) div 4").cast("long")
    return whole.unionByName(joined).select(F.col("name").cast(id_type).alias("id"), "start", n_tokens.alias("n_tokens"), "ids")
