"""Log parsing on streams: the batch plan of ``parse_log`` unchanged, with an optional windowed count by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.operators.transforms import parse_log


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, level, source, message) of text files as they arrive in a folder."""
    return parse_log(spark.readStream.text(path))


def level_counts(logs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, level, n) with lines up to ``late`` behind the newest; lines without a timestamp are left out."""
    timed = logs.withColumn("ts", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).filter("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "level", "n")
