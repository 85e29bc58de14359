"""Ranges, histograms and summaries of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import component, magnitude, truncate


def field_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def vector_ranges(df: DataFrame, vector: Column, size: int) -> DataFrame:
    """Component -1 is the magnitude; all in one pass, then one row each."""
    parts = {-1: magnitude(vector)} | {i: component(vector, i).cast("double") for i in range(size)}
    one = df.agg(F.array(*[F.struct(F.lit(k).alias("component"), F.min(c).alias("min"), F.max(c).alias("max")) for k, c in parts.items()]).alias("r"))
    return one.select(F.inline("r"))


def joint_range(df: DataFrame, *columns: str) -> DataFrame:
    """Of one field its range; of several, the range of their magnitude."""
    v = F.col(columns[0]) if len(columns) == 1 else F.sqrt(sum(F.col(c) * F.col(c) for c in columns))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"))


def _binned(df: DataFrame, column: str, bins: int, low: Column, high: Column) -> Column:
    """Bin of a value, null outside the half-open range; the maximum is outside."""
    width = F.when(high > low, (high - low) / bins).otherwise(1.0)
    at = (F.col(column) - low) * (1.0 / width)
    return F.when((at > -1) & (at < bins), truncate(at).cast("int"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, low_edge, high_edge and n for each bin, empty ones too; the field's own
    range if none is given."""
    given = df.agg(F.min(column).alias("lo") if low is None else F.lit(low).alias("lo"), F.max(column).alias("hi") if high is None else F.lit(high).alias("hi"))
    binned = df.select(column).crossJoin(F.broadcast(given)).select(_binned(df, column, bins, F.col("lo"), F.col("hi")).alias("bin"))
    counts = binned.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(given))
    step = (F.col("hi") - F.col("lo")) / bins
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("low_edge"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """field, bin and n of several fields, each over its own range; empty bins too."""
    ranges = df.agg(*[f(c).cast("double").alias(f"{e}_{i}") for i, c in enumerate(columns) for e, f in (("lo", F.min), ("hi", F.max))])
    wide = df.select(*[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(ranges))
    parts = F.array(*[F.struct(F.lit(c).alias("field"), _binned(df, f"v_{i}", bins, F.col(f"lo_{i}"), F.col(f"hi_{i}")).alias("bin")) for i, c in enumerate(columns)])
    counts = wide.select(F.inline(parts)).where("bin is not null").groupBy("field", "bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins * len(columns)).select(F.element_at(F.lit(columns), (F.floor(F.col("id") / bins) + 1).cast("int")).alias("field"), (F.col("id") % bins).cast("int").alias("bin"))
    return every.join(F.broadcast(counts), ["field", "bin"], "left").select("field", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def scalar_stats(df: DataFrame, column: str, bins: int = 32) -> DataFrame:
    """One row: n, mean, min, max and the quartile bounds p25, p50, p75 as the
    cumulative histogram gives them."""
    whole = df.agg(F.count(column).alias("total"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    h = histogram(df, column, bins)
    cumulative = h.withColumn("sum_n", F.sum("n").over(W.orderBy("bin")))  # as many rows as bins
    both = cumulative.crossJoin(F.broadcast(whole))
    width = F.when(F.col("max") > F.col("min"), (F.col("max") - F.col("min")) / bins).otherwise(1.0)

    def percentile(p: float) -> Column:
        target = F.col("total") * p
        inside = F.col("low_edge") + (target - (F.col("sum_n") - F.col("n"))) / F.greatest(F.col("n"), F.lit(1)) * width
        # The first bin that reaches the target, else the last.
        reached = F.min(F.when(F.col("sum_n") >= target, F.struct("bin", inside.alias("v"))))
        return F.coalesce(reached["v"], F.max(F.struct("bin", inside.alias("v")))["v"])

    out = both.agg(F.first("total").alias("n"), F.first("mean").alias("mean"), F.first("min").alias("min"), F.first("max").alias("max"), *[percentile(p / 100).alias(f"p{p}") for p in (25, 50, 75)])
    return out


def unique_values(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    values = df.select(F.col(column).alias("value")).where("value is not null")
    return (values.where(F.col("value") <= most) if most is not None else values).distinct()


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, dtype, n, min, max and mean of several fields: one pass over the data."""
    kinds = dict(df.dtypes)
    stats = [F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("dtype"), F.count(c).alias("n"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def summary_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """The summary as one JSON document for each field."""
    s = summary(df, columns)
    return s.select("field", F.to_json(F.struct(*s.columns)).alias("json"))


def weighted_mean(df: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """Sums of weights and weighted values; where all weights are zero the value is zero."""
    sums = df.groupBy(*keys).agg(F.sum(weight * value).alias("_v"), F.sum(weight).alias("weight"))
    return sums.select(*keys, "weight", F.when(F.col("weight") != 0, F.col("_v") / F.col("weight")).otherwise(0.0).alias("value"))


def rescaled(mode: str, current: tuple[float, float] | None, found: tuple[float, float]) -> tuple[float, float] | None:
    """A displayed range after a field's range is known: disable, clamp or grow."""
    if mode == "disable":
        return current
    if mode == "clamp" or current is None or current[0] > current[1]:
        return found
    if mode == "grow":
        return min(current[0], found[0]), max(current[1], found[1])
    raise ValueError(f"unknown mode {mode}")
