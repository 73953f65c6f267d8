"""Structured Streaming over the event table: windowed counts with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count and sum of value per tumbling window and key; works on streams and on tables."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    return e.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
