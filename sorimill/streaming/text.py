"""Structured Streaming: the same projections over a stream, and windowed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import convert, normalize


def normalize_stream(stream: DataFrame, text: str = "text", output: str = "spoken") -> DataFrame:
    """Add the spoken form; stateless, so it works on batches and streams alike."""
    return stream.withColumn(output, normalize(F.col(text)))


def diagnostics_by_window(stream: DataFrame, time: str, text: str = "text", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Diagnostics by window and code; rows later than ``late`` are left out of a stream's windows."""
    d = stream.withWatermark(time, late).select(time, F.explode(convert(F.col(text))["diagnostics"]).alias("d"))
    return d.groupBy(F.window(time, width).alias("window"), F.col("d.code").alias("code")).agg(F.count("*").alias("n"))
