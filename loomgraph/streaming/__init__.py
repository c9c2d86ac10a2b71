"""Edge streams: windowed degree counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """vertex, window, out_degree of a stream (or table) of edges; edges later than ``late`` are left to the watermark."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window), F.col("src").alias("vertex")).agg(F.count("*").alias("out_degree"))
