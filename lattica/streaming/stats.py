"""Ranges and histograms of a stream, by event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import truncate


def windowed_ranges(stream: DataFrame, t: str, value: str, window: str = "1 hour", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """window_start, keys, n, min, max and mean of each window."""
    groups = [F.window(t, window).alias("w"), *(keys or [])]
    out = stream.withWatermark(t, late).groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), *(keys or []), "n", "min", "max", "mean")


def windowed_histogram(stream: DataFrame, t: str, value: str, bins: int, low: float, high: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, bin and n; values outside [low, high) are left out."""
    at = (F.col(value) - low) * (bins / (high - low))
    binned = stream.withWatermark(t, late).where((at >= 0) & (at < bins)).withColumn("bin", truncate(at).cast("int"))
    return binned.groupBy(F.window(t, window).alias("w"), "bin").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "bin", "n")
