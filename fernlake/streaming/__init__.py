"""Fitted operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def transform_stream(stream: DataFrame, *fitted) -> DataFrame:
    """Apply fitted operators to a streaming frame. Each is a projection (or a join to a fixed table of codes), so no state is kept."""
    for f in fitted:
        stream = f.transform(stream)
    return stream


def windowed_counts(stream: DataFrame, time: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of values in event-time windows; events later than the watermark are dropped."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, width), value).agg(F.count("*").alias("n"))
