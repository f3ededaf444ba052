"""Means by cell and day of the year that are kept up year by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.functions import dates


class Climatology:
    """Sums and counts by (year, cell, adjusted day of the year), a folder for each year, from which means of any years are made.

    A year is added or corrected by reading its rows only; means read the sums, which are as many as cells have days,
    however many rows there were. Years are replaced when a write commits, one folder after the other; a job that is killed
    within that moment has to be run again with ``correct``.
    """

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str], cell: str = "h3", date: str = "date"):
        self.spark, self.root, self.columns, self.cell, self.date = spark, root, list(columns), cell, date

    def years(self) -> list[int]:
        """The years that are held, those without rows too."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/year=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in found or [])

    def add(self, df: DataFrame, years: Sequence[int], correct: bool = False) -> list[int]:
        """Hold the rows of these years; returns those that were read. Years that are held are skipped, or with ``correct`` replaced.

        Rows without a date belong to no year. Null values count for nothing; a null cell is a cell like any other.
        """
        held = set() if correct else set(self.years())
        due = sorted(set(years) - held)
        if not due:
            return []
        day = F.to_date(self.date)
        spans = F.lit(False)
        for y in due:  # ranges of days, which reach the scan
            spans |= F.col(self.date).between(F.lit(f"{y}-01-01").cast("date"), F.lit(f"{y}-12-31").cast("date")) if dict(df.dtypes)[self.date] == "date" else F.year(day) == y
        own = df.where(spans).groupBy(F.year(day).alias("year"), F.col(self.cell), dates.adjusted_doy(day).alias("doy"))
        sums = own.agg(*(x for i, c in enumerate(self.columns) for x in (F.sum(F.col(c).cast("double")).alias(f"s{i}"), F.count(c).alias(f"n{i}"))))
        # A row without a day for each year, so that one without rows is held, and replaces what was there before.
        marks = self.spark.createDataFrame([(y,) for y in due], "year int")
        whole = sums.unionByName(marks, allowMissingColumns=True)
        whole.write.partitionBy("year").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(self.root)
        return due

    def means(self, years: Sequence[int] | None = None) -> DataFrame:
        """(cell, doy, mean of each column) over the years that are held, or those asked for; null where a cell and day has no values."""
        if not self.years():
            raise ValueError(f"no years in {self.root}")
        d = self.spark.read.parquet(self.root).where("doy is not null")
        d = d if years is None else d.where(F.col("year").isin(list(years)))
        return d.groupBy(self.cell, "doy").agg(*(F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(c) for i, c in enumerate(self.columns)))

    def anomalies(self, df: DataFrame) -> DataFrame:
        """df with <column>_anom: the value minus the mean of its cell and day of the year; null if that has none."""
        own = df.withColumn("__doy", dates.adjusted_doy(F.to_date(self.date)))
        means = self.means().select(F.col(self.cell).alias("__cell"), F.col("doy").alias("__day"), *(F.col(c).alias(f"__{c}") for c in self.columns))
        met = own.join(means, F.col(self.cell).eqNullSafe(F.col("__cell")) & (F.col("__doy") == F.col("__day")), "left")
        return met.select(*df.columns, *((F.col(c) - F.col(f"__{c}")).alias(f"{c}_anom") for c in self.columns))
