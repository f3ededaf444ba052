"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in Java's and Python's regular expressions; ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast side may have this many bytes of values; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 24 << 20
#: Bits of a bitmap: 16 a hash, between these powers of two.
BITMAP_LOG2 = (16, 27)
#: What a row costs in a broadcast besides its values.
_ROW_BYTES = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one on one machine, an error on a cluster."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidecube-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidecube"


def materialize(df: DataFrame, label: str, sort: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a written table that no frame in use reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of df, from one aggregate; nested values other than arrays of numbers or text count by their JSON."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return F.size(c) * 8
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(of(c[f.name], f.dataType), F.lit(0)) for f in kind), F.lit(0))
        return F.length(F.to_json(F.struct(c.alias("x")))) if isinstance(kind, (T.ArrayType, T.MapType)) else F.lit(8)

    total = sum((F.coalesce(of(F.col(f.name), f.dataType), F.lit(0)).cast("long") for f in df.schema), F.lit(_ROW_BYTES).cast("long"))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its values were measured to fit; else as it is, so that Spark shuffles both sides."""
    return F.broadcast(df) if value_bytes(df) <= most else df


def crc_mod(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lean_arrow() -> None:
    """In a Python worker: give the memory of Arrow batches back when they are done, instead of keeping it for the next task."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


def kept_heap() -> None:
    """In a Python worker: arrays of a few megabytes take the memory of those before them; else the C library gives it back after each step, and every page of the next arrays is a fault."""
    import ctypes

    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


def bitmap(found: DataFrame) -> np.ndarray:
    """The hashes of column h (long) as a bitmap with two bits a hash; what is collected is bounded by the bitmap's own size."""
    n = found.count()
    log2 = min(max(int(16 * n).bit_length(), BITMAP_LOG2[0]), BITMAP_LOG2[1])
    low = F.col("h").bitwiseAND((1 << log2) - 1)
    high = F.shiftrightunsigned("h", 64 - log2)
    at = found.select(F.explode(F.array(low, high)).alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    bits = np.zeros(1 << (log2 - 5), np.uint32)
    got = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return bits


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of the hashes (unsigned) that the bitmap lets through."""
    log2 = np.uint64(len(bits).bit_length() + 4)
    test = lambda p: bits[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32) & np.uint32(1)
    at = np.flatnonzero(test(h & ((np.uint64(1) << log2) - np.uint64(1))))
    return at[test(h[at] >> (np.uint64(64) - log2)) > 0]
