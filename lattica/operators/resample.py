"""Spatial joins by uniform bins, and what rests on them: splats.

A position meets only what shares one of its bins. Bins are as wide as the search
radius, so a point is looked for in 27 bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SPH, sph_weight
from ..scratch import Scratch
from .stats import weighted_mean

AXES = ("x", "y", "z")


#: Points of a bin from which its pairs are dealt to several tasks.
DENSE = 20_000


def _bins(width: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(width)).alias(f"_b{a}") for a in AXES]


def within_radius(samples: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of samples and points (all columns of points prefixed p_) no farther than radius, with d.

    The side with fewer rows is spread over the 27 bins around each of its positions. A bin
    that holds many rows of the other side is cut into parts of about DENSE rows, to each of
    which the spread side is sent."""
    renamed = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    many, few = (renamed, samples) if samples.count() <= points.count() else (samples, renamed)
    at = {id(renamed): [f"p_{a}" for a in AXES], id(samples): list(AXES)}
    cell = lambda df: [F.floor(F.col(a) / F.lit(radius)) for a in at[id(df)]]
    bins = ["_bx", "_by", "_bz"]
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    spread = few.select("*", F.explode(near).alias("_s")).select(*few.columns, *[(c + F.col(f"_s.{s}")).alias(b) for b, c, s in zip(bins, cell(few), "abc", strict=True)])
    binned = many.select("*", *[c.alias(b) for b, c in zip(bins, cell(many), strict=True)])
    loads = Scratch(samples.sparkSession, "loads").write(binned.groupBy(*bins).agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE), "bins")
    dense = [tuple(r) for r in loads.select(*bins, F.ceil(F.col("_n") / F.lit(DENSE)).cast("int")).limit(1).collect()]
    if dense:  # the loads are of few rows, each of which stands for DENSE
        parts = loads.select(*[F.col(b).alias(f"_l{b}") for b in bins], F.ceil(F.col("_n") / F.lit(DENSE)).cast("int").alias("_parts"))
        same = lambda df: [df[b] == parts[f"_l{b}"] for b in bins]
        spread = spread.join(parts, same(spread), "left").select(*spread.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        part = F.pmod(F.xxhash64(*at[id(many)]), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
        binned = binned.join(parts, same(binned), "left").select(*binned.columns, part.alias("_part"))
        bins = [*bins, "_part"]
    pairs = spread.join(binned, bins)
    d = F.sqrt(sum((F.col(a) - F.col(f"p_{a}")) ** 2 for a in AXES))
    return pairs.select(*samples.columns, *renamed.columns, d.alias("d")).where(F.col("d") <= radius)


def gaussian(samples: DataFrame, points: DataFrame, radius: float, sharpness: float, keys: list[str]) -> DataFrame:
    """Mean of ``value`` weighted by exp(-(sharpness d / radius)^2); 0 where no point is near."""
    w = F.exp(F.lit(-((sharpness / radius) ** 2)) * F.col("d") * F.col("d"))
    found = weighted_mean(within_radius(samples, points.select(*AXES, "value"), radius), keys, F.col("p_value"), w)
    return samples.join(found, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def sph(samples: DataFrame, points: DataFrame, h: float, kind: str, keys: list[str]) -> DataFrame:
    """Sum of value x kernel x volume, with the smoothing length's cube as volume."""
    support, sigma = SPH[kind]
    pairs = within_radius(samples, points.select(*AXES, "value"), support * h)
    weight = F.lit(sigma / h**3 * h**3) * sph_weight(kind, F.col("d") / h)
    found = pairs.groupBy(*keys).agg(F.sum(weight * F.col("p_value")).alias("value"))
    return samples.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


def splats(points: DataFrame, radius: float = 0.0) -> DataFrame:
    """Points with a radius: 0 stands for a plain cloud."""
    return points.withColumn("radius", F.lit(float(radius)))
