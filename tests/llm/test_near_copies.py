"""The pipeline's near duplicates against brute-force Jaccard of five-word shingles, on other code than the stage's."""

import itertools
import random
import re

import numpy as np
import pytest

from tidecube.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_kept(rows):
    """Of each component over links of Jaccard >= 0.8 the least id; of (id, text) with ids that differ."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i, j in itertools.combinations(order, 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            keep, go = (a, b) if rows[a][0] < rows[b][0] else (b, a)
            at[go] = keep
    return sorted({rows[root(i)][0] for i in range(len(rows))})


def edited(g, words, n):
    out = list(words)
    for i in g.sample(range(len(out)), n):
        out[i] = f"new{g.random()}"
    return out


def copies():
    """Families of near copies on either side of the threshold, short texts, exact copies, texts without words."""
    g = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{g.randrange(5000)}" for _ in range(g.choice([40, 120, 600]))]
        texts += [" ".join(edited(g, base, k * len(base) // 120)) for k in (0, 1, 1, 2, 2, 3, 4, 6)]
    texts += ["a b c", "A b  c", "a b d", "a b c d e", "", None, " \n", texts[0]]
    g.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 400}, {"CROWD": 20, "PART": 100}, {"_BUCKET": 2}])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(near_copies, k, v)
    rows = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = near_copies.drop_near_copies(docs)
    want = brute_kept(rows)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows) - 60


def test_pairs_at_the_threshold_meet_in_a_table():
    g = np.random.default_rng(4)
    met = within = 0
    for n in [20] * 500 + [200] * 500:  # sets that share 8 of 10 parts
        both = g.integers(0, 1 << 64, n, np.uint64)
        a, b = (near_copies.fingerprint(np.unique(np.concatenate([both[: n * 8 // 10], own]))) for own in (both[n * 8 // 10 : n * 9 // 10], both[n * 9 // 10 :]))
        nodes = np.array([1, 2])
        tables = near_copies._tables(np.concatenate([a, b]), nodes, 0)
        met += any(e["x"][0] == e["x"][1] for _, _, _, e in tables)
        within += int(np.bitwise_count(a[:2] ^ b[:2]).sum()) <= near_copies.FAR
    assert met >= 985 and within >= 990


def test_pairs_within_the_radius_always_meet():
    g = np.random.default_rng(5)
    for _ in range(200):
        bits = np.zeros(32 * near_copies.BLOCKS, np.uint8)
        bits[g.choice(len(bits), near_copies.BLOCKS * (near_copies.RADIUS + 1) - 1, replace=False)] = 1
        a = g.integers(0, 1 << 64, near_copies.BLOCKS // 2, np.uint64)
        b = a ^ np.packbits(bits, bitorder="little").view("<u8")
        assert any(e["x"][0] == e["x"][1] for _, _, _, e in near_copies._tables(np.concatenate([a, b]), np.array([1, 2]), 0))


def test_stage_drops_what_brute_force_links(spark, small):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select(*corpus.COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = dict(corpus.STAGES)["near duplicates"](spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, "en", "s", 1), (None, text + " end", "en", "s", 1), (7, text, "en", "s", 1), (7, text, "en", "s", 1), (7, "else", "en", "s", 1), (None, "alone", "en", "s", 1)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "alone"), (7, "else"), (7, text)]
    assert near_copies.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0
