"""The text operators against brute force, exact round trips and held-out accuracy; nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near_copies import brute_kept
from tidecube.llm import attention_lm, chat, decontaminate, exact_dedup, language, mixing, quality, sharding, simhash, url_rules
from tidecube.llm.components import connected_components
from tidecube.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeats; and a column named as the operators' own."""
    long = " ".join(f"word{i % 700} tail{i}" for i in range(60_000))
    rows = [(1, "a b c d", "en", "s", 1, "x"), (1, "a b c d", "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, " \n\t ", "fr", None, 3, None), (None, "a b c d", "en", "s", 1, "x"), (None, None, None, None, None, None), (5, long, "en", "t", 9, "x"), (6, "!!! 123", "fr", "t", 7, "x")]
    return spark.createDataFrame(rows, DOCS)


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    """The smallest id reachable of each id; equal ids share one node for each fingerprint."""
    at = list(range(len(ids)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            at[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = x if least.get(r) is None else least[r] if x is None else min(least[r], x)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = dict(zip((r.doc_id for r in rows), zip((f"{f:016x}" for f in fps), brute_components([r.doc_id for r in rows], fps))))
    got = QUERIES["op2_simhash"](spark, docs_dir(docs)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


def docs_dir(docs):
    return docs.inputFiles()[0].removeprefix("file://").rpartition("/documents.parquet")[0]


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(list(range(64)), 3)
    for flipped in itertools.combinations(range(64), 3):
        bits = sum(1 << b for b in flipped)
        assert any(not m & bits for m in masks)


def test_links_in_full_buckets(spark):
    g = random.Random(5)
    base = g.getrandbits(64)
    near = {base ^ sum(1 << b for b in g.sample(range(64), 2)) for _ in range(700)} | {g.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    parts = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(signed, [x & (2**64 - 1) for x in signed])
    assert [parts.get(x, x) for x in signed] == want


def test_near_duplicates_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r.doc_id, r.component) for r in got if r.fp == 0} == {(2, 2), (3, 2), (4, 2), (None, 2)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_seeds_meet_every_stretch_with_two_substitutions():
    for wrong in itertools.combinations(range(13), 2):
        assert any(all(p + o not in wrong for o in m) for m in decontaminate.MASKS for p in range(13 - m[-1]))


def test_short_masks_meet_every_allowed_substitution():
    for n in range(decontaminate.LEAST_TOKENS, decontaminate.MIN_TOKENS):
        allowed = int(n - n * 0.8 + 1e-9)
        for wrong in itertools.combinations(range(n), allowed):
            assert any(not set(m) & set(wrong) for m in decontaminate.short_masks(n)), (n, wrong)


def brute_overlaps(docs, items, least=5):
    """(doc, item) whose tokens agree in 80 % of some 13 places in a row, or of all places of a shorter item of ``least`` or more."""
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    out = set()
    for d, text in docs:
        a = np.array(tok(text), object)
        for i, item in items:
            b = np.array(tok(item), object)
            n = min(13, len(b))
            if n < least:
                continue
            for shift in range(-len(b), len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                if hi - lo < n:
                    continue
                same = np.cumsum([0, *(a[lo:hi] == b[lo - shift : hi - shift])])
                if (same[n:] - same[:-n]).max() >= 0.8 * n - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_overlaps_are_those_of_brute_force(spark):
    g = random.Random(8)
    word = lambda: f"v{g.randrange(60)}"  # noqa: E731  few words: chance overlaps too
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 20, 40])]
    docs = []
    for k in range(150):
        body = [word() for _ in range(g.randrange(60))]
        own = items[g.randrange(len(items))][1].split()
        for p in g.sample(range(len(own)), g.choice([0, 1, 1, 2, 2, 3]) if len(own) > 3 else 0):
            own[p] = f"x{k}"
        at = g.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + own + body[at:])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_overlaps(docs, items)


def test_items_of_one_to_four_tokens_match_word_for_word(spark):
    g = random.Random(12)
    word = lambda: f"v{g.randrange(25)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 13])]
    docs = [(k, " ".join(word() for _ in range(g.choice([0, 1, 2, 5, 40, 200])))) for k in range(120)]
    docs += [(200 + i, t) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b, least_tokens=1).collect()}
    want, number = brute_overlaps(docs, items, 1), {}
    for i, t in items:
        number.setdefault(t, i)  # equal items are one, known by the least id
    assert got == {(x, number[dict(items)[i]]) for x, i in want}
    left = {r.doc_id for r in decontaminate.drop_contaminated(d, b, least_tokens=1).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in want}


def test_overlaps_on_the_tables_are_those_of_brute_force(spark, docs, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3_000]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, small).collect()}
    assert {x for x in got if x[0] in dict(rows)} == brute_overlaps(rows, items)


def test_equal_items_are_one(spark):
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(k, item) for k in (9, 7, 8)], "item_id long, text string")
    (r,) = decontaminate.overlaps(spark.createDataFrame([(1, item)], "doc_id long, text string"), bench).collect()
    assert (r.item_id, r.n_items) == (7, 3)


def test_one_id_with_two_texts(spark):
    """Each text is judged on its own, and gives one row a document."""
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(20))
    items = spark.createDataFrame([(7, a), (7, b), (9, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x {b}")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["item_tokens"], r["n_items"]) for r in decontaminate.overlaps(docs, items).collect())
    assert got == [(1, 7, 30, 1), (2, 7, 20, 2), (3, 7, 20, 2), (3, 7, 30, 1)]


def test_overlaps(spark):
    item = " ".join(f"i{k}" for k in range(20))
    changed = item.replace("i5 ", "XX ").replace("i12 ", "YY ")
    far = " ".join(f"i{k}" if k % 2 else f"z{k}" for k in range(20))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (7, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x y {item} z"), (2, f"a {changed.upper()} b"), (3, far), (4, None), (5, ""), (None, item), (1, f"x y {item} z")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_tokens) for r in decontaminate.overlaps(d, bench).collect()}
    assert got == {(1, 7, 20), (2, 7, 20), (None, 7, 20)}
    left = decontaminate.drop_contaminated(d.withColumn("item", F.lit(1)), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == ["doc_id", "text", "item"]
    assert decontaminate.overlaps(d, bench.limit(0)).count() == 0 and decontaminate.overlaps(d.limit(0), bench).count() == 0


def test_overlaps_find_every_exact_passage(spark, docs, small):
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    grams = {}
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = tok(r.text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(r.item_id)
    want = {(r.doc_id, i) for r in docs.collect() for w in [tok(r.text)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, small).collect()}
    assert want <= got


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: (size, target)} by filling and resharing until none is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix(spark, docs):
    sf = docs_dir(docs).replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op3_mixing"](spark, sf).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert all(len(WORD.findall(t or "")) == n for t, n in zip(got.text, got["size"]))
    sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
    want = brute_targets({(None if pd.isna(k) else k): v for k, v in sizes.items()})
    for s, rows in got.groupby("source", dropna=False):
        t = want[None if pd.isna(s) else s]
        assert np.allclose(rows.target, t) and abs(rows.taken.sum() - t) <= max(30, 0.01 * t)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(5)))


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and got.copies.between(0, 3).all()
    again = mixing.mixed_documents(odd)
    assert again.columns == odd.columns and again.count() == got.copies.sum()
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark, docs):
    sf = docs_dir(docs).replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = QUERIES["op4_quality"](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    h = got[got.held_out].merge(labels, on="doc_id")
    assert (h.predicted == h.quality).mean() > 0.95


def brute_statistics(text):
    t = text or ""
    words, lines, n = WORD.findall(t), t.split("\n"), max(1, len(t))
    share = lambda chars: sum(c in chars for c in t) / n
    return {
        "chars": len(t), "words": len(words), "word_length": len(t) / len(words) if words else 0, "distinct_words": len(set(words)) / len(words) if words else 0,
        "distinct_lines": len(set(lines)) / len(lines) if t else 0, "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ"), "digits": share("0123456789"), "symbols": share("#$%&*+=<>@\\^_~{}[]/"),
        "bars": share("|"), "stops": share(".,;:"), "marks": share("!?"), "lines": len(lines) / n if t else 0,
    }


def test_quality_scores_are_those_of_the_rules(spark, docs, odd, small):
    labels = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet"), labels)
    assert model.rules
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        for r in quality.score(df, model).collect():
            stats = brute_statistics(r.text)
            assert all(abs(r["__stats"][k] - v) < 1e-9 for k, v in stats.items())
            z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(stats[k] <= t if op == "<=" else stats[k] > t for k, op, t in rule))
            assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_rules_are_paths_of_the_tree():
    text = "Tree\n  If (feature 0 <= 2.0)\n   If (feature 1 <= 5.0)\n    Predict: 1.0\n   Else (feature 1 > 5.0)\n    Predict: 0.0\n  Else (feature 0 > 2.0)\n   Predict: 0.0\n"
    got = set(quality.tree_rules(text, ("a", "b")))
    assert got == {(("a", "<=", 2.0),), (("a", ">", 2.0),), (("a", "<=", 2.0), ("b", "<=", 5.0)), (("a", "<=", 2.0), ("b", ">", 5.0))}


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (5, 7)], "doc_id long, quality int")
    assert all(0.5 < r.score < 1 for r in quality.score(odd, quality.fit(odd, one)).collect())


def test_url_parts_and_fixed_rules(spark):
    urls = ["http://Sub.Example.ORG/es/x?q=/1", "https://example.org/en/12#f", "ftp://a.com/fr/", "http://com/de/9", "http://a.com", "no scheme/de/", None, "x://h?y", "http://notorg/", "http://b.com/x\n/de/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    from tidecube.llm.queries import URL_RULES

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(rows, spark.createDataFrame([], "url string, block boolean"), URL_RULES).collect()}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(h) :])[0]
        h = h.translate(LOWER)
        fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in URL_RULES if (h == rh or h.endswith("." + rh)) and path.startswith(rp)]
        return (h, path, *((max(fits)[1:]) if fits else (None, "allow")))

    assert got == {i: brute(u) for i, u in enumerate(urls)}


def brute_verdict(u, rules):
    """(host, path, rule, verdict) by the fixed rules alone."""
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(h) :])[0]
    h = h.translate(LOWER)
    fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and path.startswith(rp)]
    return (h, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_query_is_that_of_brute_force(spark, small):
    from tidecube.llm.queries import URL_RULES

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op5_url_rules"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        want = brute_verdict(pages[r.page_id], URL_RULES)
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict == ("block" if r.rule is None and r.mined else want[3])


def test_tokens_that_come_together_are_one_item(spark):
    long = "/".join(f"p{chr(97 + i)}" for i in range(24))  # 2^24 combinations, were each token an item
    rows = [(f"http://a.net/{long}/{'bad' if i % 2 else 'ok'}/x", bool(i % 2)) for i in range(60)]
    (r,) = url_rules.mine(spark.createDataFrame(rows, "url string, block boolean")).collect()
    assert r.tokens == ["path bad"] and r.confidence == 1


def test_mined_rules_block_combinations(spark):
    urls = [(f"http://h{i % 7}.net/{'win' if i % 2 else 'a'}/{'bet' if i % 3 else 'b'}/{i}", bool(i % 2 and i % 3)) for i in range(300)]
    labelled = spark.createDataFrame([*urls, ("http://x.net/", None)], "url string, block boolean")
    rules = url_rules.mine(labelled)
    assert [sorted(r.tokens) for r in rules.collect() if r.confidence == 1] == [["path bet", "path win"]]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(999, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled, []).collect()}
    assert all(got[i] == "block" for i, (_, bad) in enumerate(urls) if bad) and got[999] == "allow"


def brute_phrases(sample, text):
    n = at = 0
    while at < len(text):
        length = 0
        while at + length < len(text) and text[at : at + length + 1] in sample:
            length += 1
        at += max(length, 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    g = random.Random(3)
    sample = "".join(g.choice("abc ") for _ in range(300))
    code = {c: i for i, c in enumerate(" abc", 1)}
    table = language.comb(language.suffix_automaton([code[c] for c in sample]), 6)
    for _ in range(60):
        text = "".join(g.choice("abc ??") for _ in range(g.randint(1, 60)))
        c = np.array([code.get(x, 0) for x in text], np.int32)
        assert int(language.phrases(table, c, np.array([0]), np.array([len(c)]))[0]) == brute_phrases(sample, text)


def test_language_on_held_out_texts(spark, small, docs):
    got = QUERIES["op6_language"](spark, docs_dir(docs).replace("sf0.001", "sf0.01")).toPandas()
    truth = spark.read.parquet(docs_dir(docs).replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    h = got[got.held_out].merge(truth.dropna(), on="doc_id")
    assert (h.lang_pred == h.lang).mean() > 0.98


def test_language_query_is_that_of_brute_force(spark):
    g = random.Random(6)
    scripts = {"aa": "abcde ", "bb": "abxyz ", "gr": "αβγδε ", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 300)))}
    text = lambda k, n: "".join(g.choice(scripts[k]) for _ in range(n))
    rows = [(i, text(k, g.randrange(20, 200)) + g.choice(["", "!", "?? 12"]), k) for i, k in enumerate([*scripts] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = {k: [language.clean(t) for _, t, x in rows if x == k] for k in scripts}
    model = language.fit(df)
    assert model.languages == sorted(scripts) and model.sizes == [sum(len(t) + 1 for t in sample[k]) for k in sorted(scripts)]
    for r in language.identify(df, model).collect():
        own = re.sub(r"[^\W\d_]", lambda m: m[0].lower(), re.sub(r"[\W\d_]+", " ", rows[r.doc_id][1])).lstrip(" ")
        bits = {k: brute_phrases("|".join(sample[k]), own) * np.log2(n + 1) / len(own) for k, n in zip(model.languages, model.sizes)}
        best = min(bits, key=lambda k: (bits[k], k))
        assert r.lang_pred == best and np.isclose(r.entropy, bits[best])
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language.identify(df, model).collect() if rows[r.doc_id][2] in ("gr", "zh"))


def test_samples_are_bounded_and_whole(spark):
    long = "".join(chr(97 + i % 26) for i in range(50_000)) + " the end"
    rows = [(None, f"text {i % 3}", "en") for i in range(500)] + [(7, long, "fr")]
    got = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    assert sorted(r.text for r in got if r.lang == "en") == ["text 0", "text 1", "text 2"]
    (fr,) = [r.text for r in got if r.lang == "fr"]
    assert len(fr) < 1_100 and fr.endswith("the end") and fr.startswith(long[:100])


@pytest.mark.parametrize("parts", [1, 9])
def test_sample_is_the_rows_of_least_hashes(spark, parts):
    rows = [(i % 4_000, f"row {i % 4_000} of many", "en") for i in range(6_000)] + [(1, "the same text", "en")] * 3_000 + [(i, f"rang {i}", "fr") for i in range(130)] + [(i, f"zeile {i}", "de") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    got = language.training_sample(df, "doc_id", "text", "lang").toPandas()
    every = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).distinct().toPandas().sort_values("h")
    want = every.groupby("lang").head(language.SAMPLE_DOCS)
    assert sorted(zip(got["lang"], got["h"], got["text"])) == sorted(zip(want["lang"], want["h"], want["text"]))
    assert got.groupby("lang").size().to_dict() == {"en": 60, "fr": 60, "de": 7}


def test_language_of_odd_rows(spark, odd, docs):
    model = language.fit(docs)
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 6)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(odd, language.fit(docs.limit(0))).collect()} == {"und"}


def test_shards(spark, docs, odd):
    got = sharding.shard_documents(docs).toPandas()
    n = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert n.max() - n.min() <= 1 and len(got) == docs.count()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(texts[r.doc_id].__len__() + 16 == r.size and zlib.crc32(texts[r.doc_id]) == r.text_crc32 for r in got.itertuples())
    same = spark.createDataFrame([(7, "x")] * 1000, "doc_id long, text string")  # one key
    assert sharding.shard_documents(same).groupBy("shard").count().where("count <> 25").count() == 0
    assert sharding.shard_documents(odd).count() == odd.count() and sharding.shard_documents(odd.limit(0)).count() == 0


def test_shard_query_is_that_of_a_plain_ring(spark, docs, small):
    rows = [(r.doc_id, r.h) for r in docs.select("doc_id", F.expr("xxhash64(cast(doc_id AS string)) & 4294967295").alias("h")).collect()]
    points = sorted((xxhash.xxh32_intdigest(f"{s}/{v}"), s) for s in range(40) for v in range(sharding.VNODES))
    room = {s: len(rows) // 40 + (s < len(rows) % 40) for s in range(40)}
    arcs = {}
    for i, h in rows:
        arcs.setdefault(next((k for k, (p, _) in enumerate(points) if p >= h), 0), []).append(i)
    want, left = {s: 0 for s in room}, []
    at_home = {}
    for arc in sorted(arcs):
        s = points[arc][1]
        stay = min(len(arcs[arc]), room[s] - want[s])
        want[s] += stay
        at_home[arc] = stay
        left.append((arc, len(arcs[arc]) - stay))
    goes = {}
    for arc, n in left:
        at = arc
        while n:
            at = (at + 1) % len(points)
            s = points[at][1]
            took = min(n, room[s] - want[s])
            want[s] += took
            n -= took
            if took:
                goes.setdefault(arc, []).append((s, took))
    assert want == room
    shard = {r.doc_id: r.shard for r in QUERIES["op7_sharding"](spark, small).collect()}
    for arc, ids in arcs.items():  # of each arc as many rows in each shard as the plain ring puts there
        expected = {points[arc][1]: at_home[arc]} if at_home[arc] else {}
        for s, n in goes.get(arc, ()):
            expected[s] = expected.get(s, 0) + n
        assert pd.Series([shard[i] for i in ids]).value_counts().to_dict() == expected


def test_few_rows_move_to_one_more_shard(spark, docs):
    a, b = (sharding.shard_documents(docs, shards=k).select("doc_id", F.col("shard").alias(f"s{k}")) for k in (8, 9))
    moved = a.join(b, "doc_id").where("s8 <> s9").count()
    assert moved < 0.45 * docs.count()


def test_segments_fill_every_shard_to_its_capacity():
    g = np.random.default_rng(2)
    owner, counts = g.integers(0, 5, 40), g.integers(0, 30, 40)
    capacity = sharding.capacities(int(counts.sum()), 5)
    segments = sharding.flow(counts, owner, capacity)
    assert [sum(n for _, _, n, s in segments if s == k) for k in range(5)] == capacity.tolist()
    assert [sum(n for a, _, n, _ in segments if a == k) for k in range(40)] == counts.tolist()


def test_windows_score_each_token_once():
    lengths = np.array([1, 30, 24, 100])
    ranks = np.arange(lengths.sum()).astype(np.uint16)
    x, target, text, first = attention_lm.windows(ranks, lengths)
    assert sorted(target[target >= 0].tolist()) == list(range(lengths.sum()))
    assert first.sum() == 4


def test_slots_hold_the_subwords_of_each_word():
    found = [b"", b"plain", "h\u00f6her".encode(), b"don't", b"a-b_c", "non\u00a0breaking".encode(), b"x" * 2_500, "\u65e5\u672c\u8a9e".encode(), b"\x01", b"plain", b"12345", b"</s>"]
    rank = np.arange(attention_lm.END + 1).astype(np.uint16)
    for part in (found, found[:3], found[:5] + found[6:8] + found[9:]):
        slots = attention_lm._Slots(rank, attention_lm.VOCABULARY, {b"plain": 2.0})
        slots.learn({b"other", b"plain"})
        ranks, sizes, logs = slots.look_up(part)
        want = [attention_lm.subwords(w) if w else [attention_lm.END] for w in part]
        assert [x.tolist() for x in np.split(ranks, np.cumsum(sizes)[:-1])] == want
        assert logs.tolist() == [2.0 if w == b"plain" else 0.0 for w in part]


def test_gradient_of_the_network():
    g = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in attention_lm.initial(np.ones(1024)).items()}
    for v in m.values():
        v += 0.1 * g.standard_normal(v.shape)
    x, y = g.integers(0, 1024, (2, 32)), g.integers(0, 1023, (2, 24))
    known, first = np.ones((2, 24), bool), np.array([True, False])
    _, grad = attention_lm.gradient(m, x, y, known, first)
    for k in m:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        up, down = ({n: v.copy() for n, v in m.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = (attention_lm.gradient(up, x, y, known, first)[0] - attention_lm.gradient(down, x, y, known, first)[0]) / 2e-3
        assert np.isclose(slope, grad[k][at], rtol=0.02, atol=1e-5), k


def test_scores_are_those_of_dense_attention():
    g = np.random.default_rng(3)
    m = {k: v + 0.2 * g.standard_normal(v.shape).astype(np.float32) for k, v in attention_lm.initial(np.arange(1024.0)).items()}
    lm = attention_lm.LanguageModel(m, np.zeros(1), np.zeros(attention_lm.END + 1), "").packed()
    own = g.integers(0, 1000, 90).astype(np.uint16)
    got = attention_lm._by_word(lm, own, np.ones(90, np.int64), np.array([50, 40]))  # two texts of one-subword words
    for lo, hi in ((0, 50), (50, 90)):
        text = own[lo:hi].tolist()
        for t in range(len(text)):
            begin = t // attention_lm.STRIDE * attention_lm.STRIDE - attention_lm.CONTEXT  # the window's first place
            seen = [p for p in range(begin, t + 1) if begin >= 0 or p >= 0]
            token = lambda p: attention_lm.BOS if p == 0 else text[p - 1]  # noqa: E731  the input at a place is the token before it
            h = {p: m["e"][token(p)].astype(float) + m["p"][p - begin] for p in seen}
            q = h[t] @ m["q"] * attention_lm.WIDTH**-0.5
            s = np.exp([min(q @ (h[p] @ m["k"]), 30.0) for p in seen])
            out = h[t] + sum(w * (h[p] @ m["v"]) for w, p in zip(s / s.sum(), seen)) @ m["o"]
            z = out @ m["w"] + m["g"][token(t)] + m["b"]
            high, low = divmod(text[t], attention_lm.DIGITS)
            a, b = z[: attention_lm.DIGITS], z[attention_lm.DIGITS :] + m["t"][high]
            want = a[high] - np.log(np.exp(a).sum()) + b[low] - np.log(np.exp(b).sum())
            assert abs(got[lo + t] - want) < 1e-3, (lo, t)


def test_probabilities_add_up():
    m = attention_lm.LanguageModel({k: v for k, v in attention_lm.initial(np.arange(1024.0)).items()}, np.zeros(1), np.zeros(1), "").packed()
    x = np.full((1, 32), attention_lm.BOS)
    total = sum(np.exp(attention_lm.log_probabilities(m.weights, x, np.full((1, 24), r), np.array([True]))[0]) for r in range(1024))
    assert abs(total - 1) < 1e-3


def test_language_model_counts(spark, small, docs):
    got = QUERIES["op8_attention_lm"](spark, small).toPandas().set_index("doc_id")
    rows = {r.doc_id: [w.translate(LOWER) for w in WORD.findall(r.text or "")] + [""] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    c = {}
    for i, ws in rows.items():
        if not held[i]:
            for w in ws:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, ws in rows.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert np.isclose(r.base_score, sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rtol=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    again = attention_lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, heavy=500).toPandas().set_index("doc_id")
    assert np.allclose(again.base_score, got.loc[again.index].base_score) and np.allclose(again.score, got.loc[again.index].score, rtol=1e-5)


def test_language_model_of_odd_rows(spark, odd):
    got = attention_lm.score(odd, F.col("doc_id") == 3).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert len({r.score for r in got if r.n_tokens == 1}) == 1
    assert attention_lm.score(odd.limit(0), F.lit(False)).count() == 0


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark, odd, tmp_path):
    path = str(tmp_path / "d.parquet")
    odd.repartition(3).write.parquet(path)
    rows = odd.collect()
    for digest in (exact_dedup.sha256_digest, lambda t: F.length(t).cast("string")):  # the second makes texts clash
        got = exact_dedup.deduplicate(spark, path, digest=digest).collect()
        groups = {}
        for r in rows:
            groups.setdefault(norm(r.text), []).append(r.doc_id)
        want = sorted(((r.doc_id is None, r.doc_id or 0), min((x for x in groups[norm(r.text)] if x is not None), default=None), len(groups[norm(r.text)])) for r in rows)
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    empty = str(tmp_path / "e.parquet")
    odd.limit(0).write.parquet(empty)
    assert exact_dedup.deduplicate(spark, empty).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, at = str(tmp_path / "d"), str(tmp_path / "state")
    part = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    part((5, "x  y"), (6, "z"))
    schema = spark.read.parquet(path).schema
    exact_dedup.key_store(spark, path, schema, "doc_id", "text", checkpoint=at)
    part((3, "x y"))
    got = {r.digest: (r["first"].id, r.n) for r in exact_dedup.key_store(spark, path, schema, "doc_id", "text", checkpoint=at).collect()}
    assert got == {hashlib.sha256(b"x y").hexdigest(): (3, 2), hashlib.sha256(b"z").hexdigest(): (6, 1)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()
    order = sorted(want.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, want[order].astype(str).values))


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", None, 5.0), ("u", 1, 99, "user", "alone", None), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = {(r.tree, r.rank): [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_trees(m, best=2)).collect()}
    assert got == {("t", 1): [("user", "q"), ("assistant", "good"), ("user", "")], ("t", 2): [("user", "q"), ("assistant", "bad")], ("u", 1): [("user", "alone")]}
    assert chat.format_trees(m.limit(0)).count() == 0


def test_control_strings_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "[\\\\INST]", "", None, "a\nb", "<<SYS>>\\", "x" * 100_000]
    rows = [(i, k, r, t) for i, t in enumerate(hard) for k, r in enumerate(("user", "assistant\n<|im_end|>"))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_trees(chat.chains(d))).collect():
        assert [(t.role, t.text) for t in r.turns] == [("user", hard[r.tree] or ""), ("assistant\n<|im_end|>", hard[r.tree] or "")]


def test_pipeline_of_odd_rows_and_none(spark, odd, small):
    corpus = pytest.importorskip("corpus_pipeline")
    from tidecube.llm.common import materialize

    now, left = odd, {}
    for name, stage in corpus.STAGES:
        now = materialize(stage(spark, now, small), "test-odd")
        left[name] = sorted((r.doc_id or 0 for r in now.collect()))
    assert left["language"] == [0, 1, 1, 5] and left["near duplicates"] == [1, 5] == left["decontamination"]
    assert set(left["mixing"]) <= {1, 5} and left["sharding"] == left["mixing"]
    for _, stage in corpus.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0


def test_pipeline_stage_by_stage(spark, small, docs):
    corpus = pytest.importorskip("corpus_pipeline")
    from tidecube.llm.common import materialize

    now, seen = docs, {}
    for name, stage in corpus.STAGES:
        was, now = now, materialize(stage(spark, now, small), "test-stage")
        seen[name] = (was.collect(), now.collect(), now.columns)
    assert all(v[2] == docs.columns for k, v in seen.items() if k != "sharding")
    was, kept, _ = seen["language"]
    assert {r.doc_id for r in kept} == {r.doc_id for r in was if any(c.isalpha() for c in r.text or "")}
    was, kept, _ = seen["near duplicates"]
    assert sorted(r.doc_id for r in kept) == brute_kept([(r.doc_id, r.text) for r in was])
    was, kept, _ = seen["decontamination"]
    bad = {r.doc_id for r in decontaminate.overlaps(spark.createDataFrame(was), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept} == {r.doc_id for r in was} - bad
    was, kept, _ = seen["mixing"]
    copies = pd.Series([r.doc_id for r in kept]).value_counts()
    size = {}
    for r in was:
        size.setdefault(r.source, {})[r.doc_id] = len(WORD.findall(r.text or ""))
    want = brute_targets({s: sum(d.values()) for s, d in size.items()})
    for s, d in size.items():
        assert abs(sum(n * int(copies.get(i, 0)) for i, n in d.items()) - want[s]) <= max(d.values()) / 2 + 1  # rounding is off by half a document at most
    was, kept, _ = seen["sharding"]
    n = pd.Series([r.shard for r in kept]).value_counts().reindex(range(40), fill_value=0)
    assert len(kept) == len(was) and n.max() - n.min() <= 1 and len({(r.shard, r.slot) for r in kept}) == len(kept)


def test_language_model_learns_from_every_training_text(spark, monkeypatch):
    """One more text, whichever it is, changes the weights; all windows are learned from, and every word of every text decides the share."""
    rows = [(k, f"alpha beta {'gamma ' * (k % 3)}w{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "id long, text string")
    seen = []
    monkeypatch.setattr(attention_lm, "_share", lambda ratios: seen.append(int(ratios.sum())) or 0.5)

    def weights(part, known=None):
        counts = attention_lm.word_counts(part.select("text")).cache()
        own = counts.toPandas()
        n = int(own.c.sum())
        held = {w: float(np.log10(c + 0.1)) for w, c in zip(own.word, own.c)} if known is None else known
        found = attention_lm.fit(part, counts, {bytes(w): v for w, v in held.items()}, float(np.log10(n + 0.1 * (len(own) + 1))))
        assert seen[-1] == n  # every word and end
        return found.weights

    whole = weights(df)
    again = weights(df.repartition(5), known={})
    assert all((whole[k] == again[k]).all() for k in whole)
    # Under the same counts, so that only the gradients can tell: a text in another order of its words.
    for k in range(4):
        turned = df.withColumn("text", F.when(F.col("id") == k, F.concat(F.lit(f"w{k} "), F.regexp_replace("text", " *w[0-9]+$", ""))).otherwise(F.col("text")))
        assert any((whole[n] != v).any() for n, v in weights(turned).items()), k


def test_share_of_the_frequencies():
    g = np.random.default_rng(5)
    f, p = g.normal(-9, 2, 500), g.normal(-9, 2, 500)
    ratios = attention_lm._ratios(f, p)
    assert ratios.sum() == 500
    best = max(attention_lm.MIXTURES, key=lambda w: np.logaddexp(np.log(w) + f, np.log(1 - w) + p).sum())
    assert abs(attention_lm._share(ratios) - best) < 0.021
    assert attention_lm._share(np.zeros_like(ratios)) == 0.5


def test_language_model_gives_words_their_classes_share(spark):
    """A word is one place of the layer; the words after any context, with one unknown a class, have probabilities that add up to 1, and scores are sums of them, whoever holds the counts."""
    rows = [(k, f"alpha beta{k % 3} {'gamma don’t ' * (k % 4)}höher w{k}, alpha x") for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    texts = [[w.encode() for w in t.split(" ")] + [b""] for _, t in rows]
    c = pd.Series([w for t in texts for w in t]).value_counts()
    floor = np.log10(c.sum() + 0.1 * (len(c) + 1))
    lm = attention_lm.fit(df, attention_lm.word_counts(df.select("text")), {}, float(floor)).packed()
    slots = attention_lm._Slots(lm.rank, lm.vocabulary, {})
    f = lambda w: (c.get(w, 0) + 0.1) / 10**floor
    ratios = lambda ranks: attention_lm._by_word(lm, ranks, np.ones(len(ranks), np.int64), np.array([len(ranks)]))
    context = slots.first([b"alpha", b"beta1"])
    after = lambda r: np.exp(ratios(np.append(context, np.uint16(r)))[-1])
    total = sum(f(w) * after(r) for w, r in zip(c.index, slots.first(list(c.index)).tolist()))
    assert abs(total + sum(0.1 / 10**floor * after(r) for r in range(attention_lm.RARE + 1)) - 1) < 1e-3
    for heavy in (2, 1000):
        got = {r.doc_id: r.score for r in attention_lm.score(df.withColumnRenamed("id", "doc_id"), F.lit(False), heavy=heavy).collect()}
        for (k, _), t in zip(rows, texts):
            want = sum(np.log10(f(w)) + np.log10(lm.mixed + (1 - lm.mixed) * np.exp(x)) for w, x in zip(t, ratios(slots.first(t))))
            assert np.isclose(got[k], want, rtol=1e-5), k
