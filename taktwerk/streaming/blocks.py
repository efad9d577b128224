"""Streaming twins of batch operators, on event time with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The events of a folder as a stream, ts cast to a timestamp, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def shift_means(events: DataFrame, late: str = "1 hour", shift: str = "8 hours") -> DataFrame:
    """(series, shift_start, m, n) of each 8-hour shift; the same text serves a stream and a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by_shift = events.groupBy(F.window("ts", shift).alias("w"), F.col("event_type").alias("series"))
    out = by_shift.agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return out.select("series", F.col("w.start").alias("shift_start"), "m", "n")
