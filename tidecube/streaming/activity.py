"""Daily activity from a stream of events, an addition to the batch tables: late rows are taken for two days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def daily_activity(events: DataFrame, cell: str = "h3", kind: str = "species", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """(window start as date, cell, kind, n, value_sum) of a batch or stream with an event time."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    days = own.groupBy(F.window(ts, "1 day").alias("w"), cell, kind).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return days.select(F.to_date("w.start").alias("date"), cell, kind, "n", "value_sum")


def run_daily_activity(spark: SparkSession, path: str, schema: T.StructType, out: str, prepare=lambda df: df) -> DataFrame:
    """Run the stream over the files at ``path`` until they are read; the last state of every day, cell and kind.

    Each micro-batch replaces its own folder, so that a repeated one changes nothing. New files are added to the state by
    a later run with the same ``out``.
    """
    stream = prepare(spark.readStream.schema(schema).option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0]))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/days/batch={number}")

    query = daily_activity(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    days = spark.read.parquet(f"{out}/days")
    return days.groupBy("date", "h3", "species").agg(F.max_by(F.struct("n", "value_sum"), "batch").alias("s")).select("date", "h3", "species", "s.*")
