"""Exact deduplication with a streaming, disk-backed key store.

A structured stream reads the documents' files and keeps, for every digest of a normalised text, one row of state: the
least stable identifier, a locator of the content (file and row) and how many rows had it. The state lies in RocksDB,
never expires, and is combined before the shuffle, so that a text that is a third of all rows costs one state row a task.
Where a digest was met more than once, the whole normalised texts are compared by their bytes; digests that stand for
several texts are resolved text by text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import materialize, maybe_broadcast, shared_dir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB would reserve 4 MB of disk for every state partition's manifest, however small the partition.
_RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _first(id_col: str = "id") -> Column:
    """Orders rows by id, null last, then by place."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "file", "row")


def _rows(source: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    own = source.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return own.select("id", "norm", "file", "row", digest(F.col("norm")).alias("digest"))


def key_store(spark: SparkSession, path: str, schema: T.StructType, id_col: str, text_col: str, digest=sha256_digest, checkpoint: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over all files at ``path`` and return its state: digest, first (id and locator), n.

    With a ``checkpoint`` of an earlier run only new files are read, against the state kept there. A micro-batch that is
    repeated after a failure rewrites its own output, so nothing counts twice.
    """
    at = checkpoint or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(re.sub(r"(.)/*$", r"[\1]", path, count=1))  # as a pattern, so that it may be a file or a folder, with or without a slash
    state = _rows(stream, id_col, text_col, digest).groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/store/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set(_RESERVE, "false")
    try:
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
        spark.conf.unset(_RESERVE)
    fields = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{at}/store/batch=-1")
    found = spark.read.schema(fields).parquet(f"{at}/store")
    if found.select("batch").distinct().count() <= 2:
        return found.drop("batch")
    return found.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s")).select("digest", "s.*")


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, **options) -> DataFrame:
    """Return id, keep_id, group_size, kept, digest, file, row for every row of the Parquet files at ``path``.

    Texts are equal if they are the same after runs of ASCII white space become one space; null counts as empty. The row
    with the least id stays, null ids last; of rows with the same id the first by file and row. Exactly one row of a
    group is kept. Repeated rows are rows of their group. Columns other than the two are not read.
    """
    source = spark.read.parquet(path)
    store = materialize(key_store(spark, path, source.schema, id_col, text_col, digest, **options), "dedup-store")
    rows = _rows(source, id_col, text_col, digest)
    met = maybe_broadcast(store.where("n > 1").select("digest"))
    # The bytes decide: one row for each different text among the rows whose digest was met more than once.
    texts = rows.join(met, "digest").groupBy("digest", "norm").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
    clash = materialize(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    groups = store.join(maybe_broadcast(clash), "digest", "left_anti")
    slim = rows.select("id", "digest", "file", "row")
    out = slim.join(groups, "digest").select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"), "digest", "file", "row")
    if not clash.isEmpty():
        split = rows.join(clash, "digest").groupBy("digest", "norm").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
        other = rows.join(clash, "digest").join(split, ["digest", "norm"])
        out = out.unionByName(other.select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"), "digest", "file", "row"))
    return out.withColumnRenamed("id", id_col)
