"""Scans: yearly tables, single days, text files with junk in front, dense arrays as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.schema import nan_inf_to_null, require_columns


def yearly(spark: SparkSession, root: str, years: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A table that lies in year=YYYY folders; years prune folders, columns prune the read. NaN and infinities become null."""
    df = spark.read.parquet(root)
    if years is not None:
        df = df.where(F.col("year").isin(*years)) if years else df.limit(0)
    if columns is not None:
        df = require_columns(df, columns, root).select(*columns)
    return nan_inf_to_null(df)


def day(df: DataFrame, on: str, column: str = "date") -> DataFrame:
    """The rows of one day; the comparison is with a literal, so that it reaches the scan."""
    return df.where(F.col(column) == F.lit(on).cast(df.schema[column].dataType))


def files(spark: SparkSession, paths: Sequence[str], base: str | None = None) -> DataFrame:
    """Several files as one table; with a base the folders below it give their partition columns."""
    reader = spark.read.option("basePath", base) if base else spark.read
    return reader.parquet(*paths)


def latest(df: DataFrame, by: str = "year") -> DataFrame:
    """The rows of the last partition; the maximum is read from the partition column alone."""
    top = df.agg(F.max(by)).first()[0]
    return df.where(F.col(by) == F.lit(top)) if top is not None else df.limit(0)


def csv_after_junk(spark: SparkSession, path: str, schema: T.StructType | str, junk: int = 1) -> DataFrame:
    """A CSV whose files start with ``junk`` lines before the header. Lines go by their place in the file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    n = F.monotonically_increasing_id()
    numbered = lines.withColumn("__n", n)
    heads = numbered.where("file_block_start = 0").groupBy("file_path").agg(F.min("__n").alias("__first"))
    body = numbered.join(F.broadcast(heads), "file_path").where(F.col("__n") - F.col("__first") > junk)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return body.select(F.from_csv("value", kind.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header and a given schema: nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def raster_rows(df: DataFrame, array: str, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Dense arrays as rows (keys, pixel, value): pixel is the row-major place; NaN values go."""
    out = df.select(*keys, F.posexplode(array).alias("pixel", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = out.withColumn("pixel", F.col("pixel").cast("long")).withColumn("value", F.col("value").cast("double"))
    return out if width is None else out.withColumn("lat_idx", F.floor(F.col("pixel") / width)).withColumn("lon_idx", F.col("pixel") % width)


def box(df: DataFrame, lon: str, lat: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows within (lon0, lat0, lon1, lat1), in whichever order its ends are given."""
    x0, y0, x1, y1 = bounds
    return df.where(F.col(lon).between(min(x0, x1), max(x0, x1)) & F.col(lat).between(min(y0, y1), max(y0, y1)))


def grid(spark: SparkSession, path: str) -> DataFrame:
    """The grid table with signed 64-bit ids; ids in hexadecimal text are read as numbers."""
    df = require_columns(spark.read.parquet(path), ("h3", "lat", "lon"), "grid")
    return df.withColumn("h3", cell_id(df, "h3"))


def cell_id(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return F.conv(column, 16, 10).cast("long") if isinstance(kind, T.StringType) else F.col(column).cast("long")


def clean_effort(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Downloaded rows: the columns kept, cast to the given types, whole rows once."""
    return require_columns(df, list(columns), "effort").select(*(F.col(c).cast(t).alias(c) for c, t in columns.items())).dropDuplicates()
