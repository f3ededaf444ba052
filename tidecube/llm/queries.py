"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.llm import attention_lm, chat, decontaminate, exact_dedup, language, mixing, periodic_runs, phrases, quality, sharding, simhash, token_files, url_rules
from tidecube.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items, with the stretch."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: (verdict, host, path)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's document is the number in its URL's path; its labels say whether it is one to block."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    doc = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint)")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.withColumn("doc_id", doc).join(labels, "doc_id").select("url", bad.alias("block"))
    return url_rules.judge(pages, labelled, URL_RULES)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one that says control strings, formatted and read back from the output."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat.read_back(chat.format_trees(chat.chains(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("turns")), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer lowers and drops white space, and its parts are words, so words apart have the ids of the whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), words_apart=True)
    return token_files.read_tokens(spark, folder, docs.schema["doc_id"].dataType).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _tail_of_repeats(doc_id: object, n: int) -> tuple[int, int] | None:
    """Every tenth document, by the CRC-32 of its id, ends in repeats: (first word, period)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), overlay=_tail_of_repeats, keep_text=False)
    # The greatest length, then the smallest start, then the smallest period.
    order = F.transform(F.arrays_zip("lengths", "starts", "periods"), lambda r: F.struct((-r["lengths"]).alias("least"), r["starts"].alias("start"), r["periods"].alias("period")))
    best = found.withColumn("b", F.array_min(order)).withColumn("length", -F.col("b.least"))
    milli = F.expr("1000 * length div b.period")
    return best.select("doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("b.start").alias("start"), "length", F.col("b.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_simhash, op3_mixing, op4_quality, op5_url_rules, op6_language, op7_sharding, op8_attention_lm, op9_exact_dedup, op10_chat, op11_phrases, op12_token_files, op13_periodic_runs, pipeline)
}

_ESCAPE = chat.ESCAPE.replace("'", "''")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op11_phrases": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
        s AS (SELECT lang, w[i:i + m - 1] AS x FROM g, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, x, count(*) AS a FROM s GROUP BY lang, x HAVING count(*) >= 30),
        k AS (SELECT lang, x, a, unnest(range(1, len(x))) AS k FROM f WHERE len(x) > 1),
        c AS (
            SELECT k.lang, k.x, k.a, k.k, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * k.a) // (l.a + r.a) AS BIGINT) AS score
            FROM k JOIN f l ON l.lang = k.lang AND l.x = k.x[1:k.k] JOIN f r ON r.lang = k.lang AND r.x = k.x[k.k + 1:]),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
        o AS (SELECT lang, x, a, unnest(range(1, len(x) + 1)) AS i FROM f WHERE len(x) > 2),
        i AS (SELECT lang, x[i:i + m - 1] AS x, max(a) AS larger FROM o, (SELECT unnest([2, 3]) AS m) WHERE m < len(x) AND i + m - 1 <= len(x) GROUP BY 1, 2),
        z AS (
            SELECT b.lang, array_to_string(b.x, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.x = b.x
            WHERE i.larger IS NULL OR 100::HUGEINT * i.larger < 80::HUGEINT * b.a)
        SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM z JOIN t ON t.lang = z.lang QUALIFY rank <= 2000""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_chat": rf"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum({len(chat.BEGIN)} + length(role) + 1 + length(regexp_replace(text, '{_ESCAPE}', '\1\\\2\3', 'g')) + {len(chat.END)}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
}
