"""From raw documents to shards: the stages, each of which applies one operator of ``tidecube.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.llm import decontaminate, language, mixing, near_copies, sharding
from tidecube.llm.common import materialize, maybe_broadcast, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that have a language, and drops those it cannot give one: null texts and texts without a letter.

    A null language is filled with the one found; others stay as they are. Rows are known by id and text, so null and
    repeated ids are judged by their own texts; repeated rows stay as often as they come. Texts go to the model and don't
    come back: the rows that change are joined by their keys. An empty table gives an empty one; more columns are left out.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.col("lang").isNull().alias("open"))
    found = language.identify(docs.select(key.alias("key"), "text"), language.fit(docs), "key")
    changed = found.where((F.col("lang_pred") == language.UNDETERMINED) | F.col("key.open")).select(F.col("key.doc_id").alias("__id"), F.col("key.h").alias("__h"), F.col("lang_pred").alias("__lang")).distinct()
    changed = maybe_broadcast(materialize(changed, "language-changed"))
    met = docs.withColumn("__h2", F.xxhash64("text")).join(changed, (F.col("__h2") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = met.where(F.coalesce("__lang", F.lit("")) != language.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash finds candidates, five-word shingles decide: of each component of texts that share 0.8 or more the document with the least id stays.

    Null ids go last; of wholly equal rows (id and text) one stays. Null, empty and blank texts are copies of each other.
    """
    return near_copies.drop_near_copies(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; rows with null or repeated ids are judged by their own texts. Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix reads it: not at all, once, or repeated. A null source is one source; null texts have no words and come once unless their source is read more often."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with their shard and their slot in it. Null ids are told apart by their texts; equal rows are interchangeable."""
    own = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    return sharding.assign(own, F.struct("doc_id", "h"), [F.col("h"), F.col("source"), F.col("lang")]).drop("h")


#: (name, function of (spark, docs, sf_dir))
STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, rounding and the ring use hashes and iterations that SQL does not have; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
