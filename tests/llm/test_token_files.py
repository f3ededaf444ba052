"""Token files: exact round trips, damage, segments and ids of every kind."""

import itertools
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecube.llm import token_files
from tidecube.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n\t", "Hello, World!  it's", " x y", "H̱ ẖ İ ẞ Σς", "é ́x", "<|endoftext|> a<|startoftext|>b", "a\x00b \x1c \x85", "日本語 텍스트 😀😀", "don't WE'LL 123 4.5", "'s 's's", "ﬁ ﬀ", "x" * 5_000]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(VOCABULARY)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def back(spark, folder, kind="long"):
    return [(r["id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read_tokens(spark, folder, kind).orderBy("start", "n_tokens").collect()]


def test_ids_of_words_are_those_of_the_text(spark, small, library):
    encode = token_files.word_encoder(VOCABULARY, cache=500)
    for text in [*ODD, *(r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect())]:
        assert encode(pa.array([text]))[0].tolist() == library(text)
    ids, n = encode(pa.array(["skip", *ODD, *ODD]).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in [*ODD, *ODD]]


@pytest.mark.parametrize("segment", [token_files.SEGMENT, 40])
def test_texts_come_back(spark, library, segment):
    rows = [(k * 7 % 101, t, "x") for k, t in enumerate([*ODD, *ODD])] + [(None, "a b", "x"), (None, None, None), (3, None, None), (3, "the " * 3_000, "y"), (50, "of the " * 90, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    got = back(spark, token_files.write_tokens(df, VOCABULARY, segment=segment))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((g[0], g[3]) for g in got), key=key) == sorted(((d, [*library(t), 1]) for d, t, _ in rows), key=key)
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: (d is not None, d or 0))
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()


def test_ids_that_are_text_and_no_end(spark, library):
    df = spark.createDataFrame([("b", "one two"), ("a", ""), ("", "three")], "k string, t string")
    got = back(spark, token_files.write_tokens(df, VOCABULARY, "k", "t", end=None), "string")
    assert sorted((g[0], g[3]) for g in got) == [("", library("three")), ("a", []), ("b", library("one two"))]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert back(spark, token_files.write_tokens(df, VOCABULARY)) == []


def test_damage_is_seen(spark):
    df = spark.createDataFrame([(k, "some words of text " * 50) for k in range(20)], "doc_id long, text string").coalesce(1)
    folder = token_files.write_tokens(df, VOCABULARY)
    (file,) = Path(folder.removeprefix("file:")).glob("*.rans")
    whole = file.read_bytes()
    for at in (200, len(whole) // 2, len(whole) - 30):
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match="damaged|not a whole file"):
            token_files.read_tokens(spark, folder).collect()


@pytest.mark.parametrize("n", [0, 1, 1_023, 1_024, 1_025, 9_000])
def test_segments_of_a_block_are_decoded_alone(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(0, 5, 700) ** 6
    counts[3] = 10**12
    freq, log2 = token_files.frequencies(counts)
    assert freq.sum() == 1 << log2 and ((freq > 0) == (counts > 0)).all()
    coder = token_files.Coder(freq, log2)
    used = np.flatnonzero(counts)
    segments = [rng.choice(used, k) for k in (n, 17, 0, 2_500)]
    coded = coder.encode(segments)
    for k in (2, 0, 3, 1):
        ids, after = coder.decode(*coded[k], len(segments[k]))
        assert ids.tolist() == segments[k].tolist()
        assert (after == (coded[k + 1][0] if k < 3 else np.full(token_files.LANES, token_files.LOW, np.uint64))).all()
    with pytest.raises(ValueError, match="frequencies"):
        coder.encode([np.flatnonzero(counts == 0)[:1]])


def test_files_are_near_their_entropy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    folder = token_files.write_tokens(docs, VOCABULARY, words_apart=True)
    ids = np.concatenate([np.frombuffer(r[0], "<u4") for r in token_files.read_tokens(spark, folder).select("ids").collect()])
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    size = sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).glob("*.rans"))
    least = -(p * np.log2(p)).sum() * len(ids) / 8
    assert size < 1.05 * least + 12_000 * len(list(Path(folder.removeprefix("file:")).glob("*.rans")))


def test_query_is_that_of_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_token_files"](spark, small).collect()}
    start = 0
    for d, text in docs:
        ids = np.array([*library(text), 1], "<u4")
        assert got.pop(d) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_stored_under_names_that_are_committed(spark):
    """A file that no committed row names is not read."""
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    folder = token_files.write_tokens(df, VOCABULARY)
    (Path(folder.removeprefix("file:")) / "part-000000-000000-lost.rans").write_bytes(b"half of")
    assert [g[0] for g in back(spark, folder)] == [1]
    assert spark.read.parquet(f"{folder}/files").select(F.count("*")).first()[0] == 1


def test_runs_of_letters_go_through_the_library_by_lines(library, monkeypatch):
    """Few calls for many words, and the library's ids whatever a line's words are."""
    texts, calls = [" ".join(f"Wo{chr(97 + k % 26)}rd{'x' * (k % 40)}" for k in range(3_000)), *ODD], []

    class Counted:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, batch, **options):
            calls.append(len(batch))
            return self.own.encode_batch_fast(batch, **options)

    own = Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr("tokenizers.Tokenizer.from_file", lambda path: Counted(own), raising=False)
    ids, n = token_files.word_encoder(VOCABULARY)(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in texts]
    assert sum(calls) < 300  # inputs to the library; the words are 1,040 and more


def test_parts_are_cut_into_runs_all_at_once(library):
    """No Python call for each different part, and the library's ids whatever the parts hold."""
    tails = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product(".,;!", repeat=n)]
    texts = [" ".join(f"Word{chr(97 + k % 26)}{t}{'End' * (k % 2)}" for k in range(40) for t in tails), *ODD]
    texts += [" ".join(x) for x in itertools.product(["don't", "Straße,", "Ärger-Über", "“Quoted”", "ábc", "</s>x", "日本.", "12abé"], repeat=3)]
    encode, calls = token_files.word_encoder(VOCABULARY), []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        ids, n = encode(pa.array(texts))
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in texts]
    assert len(calls) < 2_000  # the different parts are over 8,000
