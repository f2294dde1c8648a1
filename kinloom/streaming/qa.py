"""Streaming fronts: line quality of arriving files, and yearly counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.curate import line_qa


def stream_lines(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def stream_line_qa(lines: DataFrame) -> DataFrame:
    """Stateless: errors and verdict of each line."""
    return line_qa(lines)


def stream_counts(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Counts per type and window of (ts, event_type), closed by a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
