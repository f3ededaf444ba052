"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from tidecube.llm import phrases
from tidecube.llm.common import bitmap, passing

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, top=2_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    own = {p: a for p, a in f.items() if a >= 30 and len(p) > 2}
    out = []
    for p, a in own.items():
        lang, w = p[0], p[1:]
        longer = [b for q, b in own.items() if q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(w)] == w for i in range(len(q) - len(w)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen = Counter()
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= top:
            yield (x[0], seen[x[0]], *x[1:])


def texts(seed, n=1_500):
    """Few words, so that many phrases are frequent; words with control characters, quotes and letters of several bytes."""
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "É", "a\x01", "\x01", "ab", "日本", "\x00", "a\x00b", "z'", "\U0001f600", " ", "\x1c"]
    weights = [9, 7, 5, 4, 3, 2, 2, 3, 3, 2, 2, 1, 1, 1, 1]
    gap = lambda: rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "!", ";"])
    rows = [(rng.choice(["en", "en", "en", None, "und", "f"]), "".join(w + gap() for w in rng.choices(words, weights, k=rng.randrange(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), (None, None), ("xx", ""), ("yy", " . ,\n"), *[("en", "over the hill and far " * 20)] * 3]


SCHEMA = "lang string, text string"


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 700, "block": 16, "per_range": 60}, {"shard_words": 90, "block": 3, "per_range": 25}])
def test_collocations_are_those_of_brute_force(spark, sizes):
    rows = texts(len(sizes))
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), **sizes).collect()))
    want = sorted(brute(rows))
    assert len(want) > 100 and got == want


def test_first_of_many(spark):
    rows = texts(7)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5))


def test_no_words(spark):
    df = spark.createDataFrame([], SCHEMA + ", shard string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a b")], SCHEMA)).collect() == []


def test_clashing_columns_and_long_texts(spark):
    long = "one two three " * 40_000
    df = spark.createDataFrame([("en", long, "x", 1, "p")] * 2, "lang string, text string, word string, n long, phrase string")
    got = {r["phrase"]: r["a"] for r in phrases.collocations(df).collect()}
    assert got == {"one two three one": 2 * 39_999, "two three one two": 2 * 39_999, "three one two three": 2 * 39_999}


def test_bitmap_stops_no_hash_that_it_holds(spark):
    found = spark.range(5_000).selectExpr("xxhash64(id) AS h")
    h = found.toPandas()["h"].to_numpy().view("uint64")
    assert len(passing(h, bitmap(found))) == 5_000
    assert len(passing(h * 3 + 1, bitmap(found))) < 500
