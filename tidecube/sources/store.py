"""Sinks: yearly tables, versions instead of changes in place, small reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors share. Where that is unset: a temporary one on one machine, an error on a cluster."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidecube-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidecube-{label}-{uuid.uuid4().hex}"


def write_yearly(df: DataFrame, path: str, date: str = "date", sort: list[str] | None = None, rows_a_file: int = 0, overwrite: bool = False) -> None:
    """year=YYYY folders with zstd; only years that df has are replaced. Rows of a year go to several tasks by their day."""
    d = df.withColumn(date, F.to_date(date)).withColumn("year", F.year(date))
    d = d.repartition("year", F.month(date))
    writer = d.sortWithinPartitions("year", *(sort or [date])).write.partitionBy("year").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    writer.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Without ``overwrite`` a table that is there already is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv", overwrite: bool = False) -> None:
    """csv (with a header) or json."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.csv(path, header=True) if form == "csv" else writer.json(path)


class Versions:
    """A table whose new states are new folders: readers of the old one are not disturbed, and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def current(self) -> int:
        """The last version that was wholly written, -1 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(s.getPath().getParent().getName()[1:]) for s in found or []), default=-1)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.current()}")

    def write(self, df: DataFrame) -> None:
        df.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.root}/v{self.current() + 1}")
