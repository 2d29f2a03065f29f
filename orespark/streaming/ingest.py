"""Incremental ingest of assay files: windowed counts and means with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_means(spark: SparkSession, folder: str, schema: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """A stream of (start, event_type, n, mean) over event time; rows later than ``late`` are left out."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off all that is there, then end."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
