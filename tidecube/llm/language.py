"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of labelled text. A text is parsed from left to
right into phrases, each the longest match that the automaton has from there; a text in the automaton's language needs
few. The phrases of the languages are compared after normalising by the sample's size: phrases * log2(sample + 1) per
character, an estimate of the cross entropy; the least wins.

Automata are built one a language in Spark tasks over all letters that the sample has, and travel as combs: the rows of
their transition table laid into each other, so that they take as much room as they have transitions, in any script. Many
pieces of texts are parsed side by side. Texts are parsed whole, in pieces of PIECE characters that start a new phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import lean_arrow, materialize, maybe_broadcast

#: Labelled texts that a language is learned from, at most: drawn by the hash of id and text.
SAMPLE_DOCS = 60
#: Of a longer one of them SPREAD pieces that together have so many characters are read, evenly spread from its start to its end.
SAMPLE_CHARS_A_DOC, SPREAD = 1_000, 10
PIECE = 1_024
#: Places that a state's transitions are tried at.
TRIES = 4
_LANES = 1 << 20
UNDETERMINED = "und"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``codes``; states from 1, the root; a code of 0 is no letter."""
    nxt: list[dict[int, int] | None] = [None, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        if not c:  # an unknown letter ends a run: substrings don't span it
            last = 1
            continue
        if (q := nxt[last].get(c)) and length[q] == length[last] + 1:
            last = q
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = copy
                link[cur] = copy
        last = cur
    return [to or {} for to in nxt]


@dataclass
class Comb:
    """An automaton's transitions: from state s by letter c to target[base[s] + c], if owner[base[s] + c] is s. root: those of state 1."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    root: np.ndarray

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        at = self.base[state] + c
        return self.target[at] * (self.owner[at] == state)


def comb(automaton: list[dict[int, int]], letters: int) -> Comb:
    """Lays the states' transitions into each other, those with most letters first, at the first of TRIES places where all letters find room, else behind the last."""
    size = 2 * letters + sum(map(len, automaton)) + 1
    base, used, target, owner = np.zeros(len(automaton), np.int32), bytearray(size), [0] * size, [0] * size
    low = end = letters  # no place before low is free, all from end on are; bases are not negative
    for s in sorted(range(len(automaton)), key=lambda s: -len(automaton[s])):
        if not (to := automaton[s]):
            break
        rest = [c - min(to) for c in to if c != min(to)]
        low = at = used.find(0, low)
        for _ in range(TRIES):
            if not any(used[at + c] for c in rest):
                break
            at = used.find(0, at + 1)
        else:
            at = end
        last = at + max(to) - min(to)
        end = max(end, last + 1)
        if (more := end + letters + 1 - size) > 0:
            used.extend(bytes(more))
            target += [0] * more
            owner += [0] * more
            size += more
        base[s] = at - min(to)
        for c, q in to.items():
            i = base[s] + c
            used[i], target[i], owner[i] = 1, q, s
    root = np.array([automaton[1].get(c, 0) for c in range(letters)], np.int32)
    return Comb(base, np.array(owner[: end + letters], np.int32), np.array(target[: end + letters], np.int32), root)


def phrases(automaton: Comb, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of phrases of each piece codes[start : start + length]; all pieces advance together."""
    order = np.argsort(-lengths, kind="stable")
    starts, ends = starts[order], np.sort(lengths)[::-1]
    state = np.ones(len(starts), np.int32)
    count = np.zeros(len(starts), np.int32)
    active = len(starts)
    for t in range(int(ends[0]) if len(ends) else 0):
        active = int(np.searchsorted(-ends[:active], -t, "left"))  # pieces longer than t
        c = codes[starts[:active] + t]
        to = automaton.step(state[:active], c)
        broken = to == 0
        count[:active] += broken & (state[:active] != 1)
        np.copyto(to, automaton.root[c], where=broken)
        count[:active] += to == 0  # a letter that the language lacks is a phrase of its own
        np.maximum(to, 1, out=to)
        state[:active] = to
    out = np.empty(len(starts), np.int64)
    out[order] = count + (state != 1)  # the phrase that the piece ends in, if one is open
    return out


@cache
def _letters() -> np.ndarray:
    """Code points that are letters."""
    return np.fromiter((p for p in range(0x110000) if chr(p).isalpha()), np.int64)


class Codes:
    """Maps texts to numbers of lower-cased letters (0: a letter that no sample has); runs of anything else are one space, and none at the start."""

    def __init__(self, alphabet: dict[str, int]):
        self.space = alphabet[" "]
        self.table = np.full(0x110000, self.space, np.int32)
        self.table[_letters()] = 0
        for ch, i in alphabet.items():
            for form in {ch, ch.upper()}:
                if len(form) == 1:
                    self.table[ord(form)] = i

    def __call__(self, text: str) -> np.ndarray:
        c = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = c == self.space
        blank[1:] &= blank[:-1].copy()
        return c[~blank] if len(c) else c


def clean(text: str) -> str:
    """Training form: lower-cased letters, anything else one space."""
    return " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())


def _spread(text: Column) -> Column:
    """The text, or if it is long pieces of it from its start to its end."""
    apart = (F.length(text) - SAMPLE_CHARS_A_DOC // SPREAD) / (SPREAD - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.substring(text, (i * apart).cast("int") + 1, F.lit(SAMPLE_CHARS_A_DOC // SPREAD)))
    return F.when(F.length(text) > SAMPLE_CHARS_A_DOC, F.array_join(pieces, "\n")).otherwise(text)


def _level(h: Column) -> Column:
    """Grows with the hash: a level has as many possible hashes as all below it together."""
    return F.floor(F.log2(F.greatest(h.cast("double") + F.lit(2.0**63), F.lit(1.0)))).cast("int")


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, h, text) of at most ``docs`` rows for each language, those with the least hashes of id and text; equal rows are one.

    A language's different rows are counted by levels of their hashes first. Only those on the levels up to the one that
    makes them twice ``docs`` are ordered, a few times ``docs`` however many rows or tasks there are.
    """
    own = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    counts = own.groupBy("lang", _level(F.col("h")).alias("level")).agg(F.approx_count_distinct("h").alias("n"))
    up_to = counts.withColumn("n", F.sum("n").over(W.partitionBy("lang").orderBy("level")))  # 64 levels a language
    cuts = materialize(up_to.where(F.col("n") >= 2 * docs).groupBy("lang").agg(F.min("level").alias("cut")), "language-cuts")
    low = own.join(maybe_broadcast(cuts), "lang", "left").where(F.col("cut").isNull() | (_level(F.col("h")) <= F.col("cut")))
    own = low.select("lang", "h", _spread(F.col("text")).alias("text")).dropDuplicates(["lang", "h"])
    return own.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= docs).drop("k")


class LanguageModel:
    """Languages, their combs and sample sizes, and the alphabet they share: a number from 1 for every letter of the samples."""

    def __init__(self, alphabet: dict[str, int], languages: list[str], combs: list[Comb], sizes: list[int]):
        self.alphabet, self.languages, self.combs, self.sizes = alphabet, languages, combs, sizes

    def cross_entropy(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Normalised phrases [text, language] of texts whose codes lie one after the other."""
        ends = np.cumsum(lengths)
        n = np.maximum(1, -(-lengths // PIECE))
        text = np.repeat(np.arange(len(lengths)), n)
        within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        starts = (ends - lengths)[text] + within * PIECE
        size = np.minimum(PIECE, lengths[text] - within * PIECE)
        out = np.empty((len(lengths), len(self.languages)))
        for k, (automaton, sample) in enumerate(zip(self.combs, self.sizes)):
            count = np.bincount(text, weights=phrases(automaton, codes, starts, size), minlength=len(lengths))
            out[:, k] = count * np.log2(sample + 1) / np.maximum(1, lengths)
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from rows with a language, at most SAMPLE_DOCS of each. Collects the letters and the automata only, which that bounds.

    Null and repeated ids are rows like any other. Languages without a letter in their texts are learned too, and fit nothing.
    """
    sample = materialize(training_sample(labelled, id_col, text_col, lang_col), "language-sample")
    letters = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("ch")).where(F.col("ch").rlike(r"^\p{L}$")).distinct()
    alphabet = {ch: i for i, ch in enumerate([" ", *sorted(r["ch"] for r in letters.collect())], 1)}

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        codes: list[int] = []
        for text in rows.sort_values("h")["text"]:
            codes += [alphabet.get(ch, 0) for ch in clean(text)] + [0]
        c = comb(suffix_automaton(codes), len(alphabet) + 1)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "n": [len(codes)], **{k: [v.tobytes()] for k, v in vars(c).items()}})

    built = sample.groupBy("lang").applyInPandas(build, "lang string, n long, base binary, owner binary, target binary, root binary").orderBy("lang").collect()
    combs = [Comb(*(np.frombuffer(r[k], np.int32) for k in ("base", "owner", "target", "root"))) for r in built]
    return LanguageModel(alphabet, [r["lang"] for r in built], combs, [r["n"] for r in built])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, entropy (bits a character under the winner) for every row.

    ``und`` with score 0 for null texts, texts without a letter, or if no language was learned. Score: the second
    best language's cross entropy over the sum of it and the best's, 0.5 if they tie, then the first in code point
    order wins; 1 if only one language was learned. Texts of any length are parsed whole. The id may be of any type, a
    struct of other columns too; repeated rows are judged alike. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("lang_pred string, score double, entropy double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_arrow()
        known = shared.value
        coder = Codes(known.alphabet)
        for batch in batches:
            texts = batch.column(1)
            lang, score, entropy = [None] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            rows, codes, size = [], [], 0

            def parse() -> None:
                if not rows:
                    return
                e = known.cross_entropy(np.concatenate(codes), np.array([len(c) for c in codes]))
                best = e.argmin(1)
                least = e[np.arange(len(e)), best]
                e[np.arange(len(e)), best] = np.inf
                second = e.min(1)
                for i, b, x, y in zip(rows, best.tolist(), least.tolist(), second.tolist()):
                    lang[i], entropy[i] = known.languages[b], x
                    score[i] = 1.0 if y == np.inf else y / (x + y)

            for i, value in enumerate(texts):
                text = value.as_py() or ""
                c = coder(text)
                if not known.languages or not (c != coder.space).any():
                    lang[i] = UNDETERMINED
                    continue
                rows.append(i)
                codes.append(c)
                size += len(c)
                if size > _LANES:
                    parse()
                    rows, codes, size = [], [], 0
            parse()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
