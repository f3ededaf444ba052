"""Periodic runs against a search of all stretches."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidecube.llm import periodic_runs as pr
from tidecube.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of every run, period by period, place by place."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e > s and e - s + p >= max(6, 4 * p):
                found.setdefault((s, e - s + p), p)  # the least period comes first
            s = e + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n=250):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 7)):
            kind = rng.random()
            unit = [rng.choice("abé") for _ in range(rng.randrange(1, 9))]
            words += unit * rng.randrange(1, 9) if kind < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    return out


SCHEMA = "doc_id long, text string, id string, key long"


@pytest.mark.parametrize("sizes", [{}, {"long_bytes": 40, "unit": 200}, {"long_bytes": 0, "unit": 1}])
def test_runs_are_those_of_brute_force(spark, sizes):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(len(sizes)))] + [(None, "a " * 50, None, None), (None, None, None, None), (3, None, "x", 1), (4, "", "x", 1), (5, " \n", "x", 1), (5, "a a a a a a", "x", 1), (5, "a a a a a", "x", 1)]
    got = pr.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes).collect()
    seen = 0
    assert len(got) == len(rows)
    key = lambda d, t: (d is None, d or 0, t)
    want = []
    for d, t, _, _ in rows:
        words = WORD.findall(t or "")
        runs = brute(words)
        seen += len(runs)
        said = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((d, len(words), runs, hashlib.sha256(said.encode()).hexdigest(), collapsed(words, runs)))
    found = [(r["doc_id"], r["n_words"], list(zip(r["starts"], r["lengths"], r["periods"])), r["runs_sha256"], r["collapsed"]) for r in got]
    assert sorted(found, key=lambda r: key(r[0], str(r[1:]))) == sorted(want, key=lambda r: key(r[0], str(r[1:])))
    assert seen > 100
    assert all(hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"] for r in got)


def test_long_text_of_one_word_and_of_none_alike(spark):
    rows = [(1, "la " * 90_000), (2, " ".join(f"w{i}" for i in range(30_000))), (3, ("x y z " * 20_000).strip())]
    got = {r["doc_id"]: r for r in pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["starts"], got[1]["lengths"], got[1]["periods"], got[1]["collapsed"]) == ([0], [90_000], [1], "la")
    assert got[2]["starts"] == [] and got[3]["periods"] == [3] and got[3]["collapsed"] == "x y z"


def test_no_rows(spark):
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_is_that_of_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 9_000).select("doc_id", "text").collect()
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    some = 0
    for d, text in docs:
        words, h = WORD.findall(text), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        some += bool(runs)
        best = min(((-m, s, p) for s, m, p in runs), default=None)
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 5
