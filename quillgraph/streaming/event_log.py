"""The append-only event log as a stream: idempotent intake, windows with late data. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A stream over a folder of Parquet files, a bounded number of files a batch; times get a time zone."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema))


def idempotent(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, remembered as long as late rows may come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums by hour and type."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, to Parquet files, exactly once."""
    query = out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
