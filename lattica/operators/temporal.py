"""Time samples: as-of lookups, brackets and interpolation.

Series are keyed. An as-of lookup works within (key, time bucket) and carries the
nearest sample over from other buckets through one row for each bucket, so one key
that holds a third of all rows is split over its buckets. Buckets are as wide as the
caller says, or else begin at quantiles of all times, which are counted when the plan is
made; then none is hot, however the times are spread. Only distinct moments are sorted:
rows that repeat one, and all other columns, meet its bracket by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import MeshDataset
from .scan import ROWS, key_bounds, range_of


def samples(df: DataFrame, key: str, t: str) -> DataFrame:
    """Distinct sample times of each key."""
    return df.select(key, t).distinct()


def _bucket(times: DataFrame, t: str, width: float | None, rows: int) -> Column:
    """The time bucket of t: of a given width, or of about ``rows`` of the times."""
    return range_of(F.col(t), key_bounds(times, t, rows)) if width is None else F.floor(F.col(t) / F.lit(width))


def bracket(queries: DataFrame, known: DataFrame, key: str, t: str, width: float | None = None, rows: int = ROWS) -> DataFrame:
    """Queries (key, t, ...) with ``lower`` and ``upper`` sample times of known (key, t).

    Before the first sample both are the first, after the last both are the last, at
    a sample both are that sample; without samples both are null. Queries without key
    or time are left out. ``width`` is the length of a time bucket; without it, buckets
    hold about ``rows`` rows.
    """
    told = F.col(key).isNotNull() & F.col(t).isNotNull()
    asked = queries.where(told).select(key, t, F.lit(True).alias("_ask"), F.lit(False).alias("_given"))
    given = known.where(told).select(key, t, F.lit(False).alias("_ask"), F.lit(True).alias("_given"))
    both = asked.unionByName(given)
    moments = both.groupBy(key, t).agg(F.max("_ask").alias("_ask"), F.max("_given").alias("_given"))
    moments = moments.select(key, t, "_ask", F.when(F.col("_given"), F.col(t).cast("double")).alias("_s"), _bucket(both, t, width, rows).alias("_b"))
    back = W.partitionBy(key, "_b").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key, "_b").orderBy(F.desc(t)).rowsBetween(W.unboundedPreceding, 0)
    near = moments.withColumn("_low", F.last("_s", True).over(back)).withColumn("_high", F.last("_s", True).over(ahead)).where("_ask")
    # For each bucket: the last sample before it and the first after it.
    ends = moments.groupBy(key, "_b").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    past = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(key).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    ends = ends.select(key, "_b", F.last("_last", True).over(past).alias("_before"), F.first("_first", True).over(later).alias("_after"))
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    found = near.join(ends, [key, "_b"]).select(key, t, F.coalesce(low, high).alias("lower"), F.coalesce(high, low).alias("upper"))
    return queries.join(found, [key, t])


def snap_down(queries: DataFrame, known: DataFrame, key: str, t: str, width: float | None = None) -> DataFrame:
    """The last sample at or before each query, or the first of all."""
    return bracket(queries, known, key, t, width).withColumnRenamed("lower", "snapped").drop("upper")


def snap_across(queries: DataFrame, series: list[DataFrame], key: str, t: str, width: float | None = None) -> DataFrame:
    """Snapped in each of several series, then the greatest that is not after the
    query, or the smallest of all."""
    out, names = queries, []
    for i, known in enumerate(series):
        names.append(f"_snap{i}")
        out = bracket(out, known, key, t, width).withColumnRenamed("lower", names[-1]).drop("upper")
    past = [F.when(F.col(n) <= F.col(t), F.col(n)) for n in names]
    best = F.coalesce(F.greatest(*past), F.least(*[F.col(n) for n in names])) if len(names) > 1 else F.col(names[0])
    return out.withColumn("snapped", best).drop(*names)


def next_sample(known: DataFrame, key: str, t: str, width: float | None = None, rows: int = ROWS) -> DataFrame:
    """Each sample with the next one of its key; the last of a time bucket has its next in a later one."""
    moments = known.select(key, t).distinct().withColumn("_b", _bucket(known, t, width, rows))
    inside = moments.withColumn("next", F.lead(t).over(W.partitionBy(key, "_b").orderBy(t)))
    firsts = moments.groupBy(key, "_b").agg(F.min(t).alias("_first"))
    after = firsts.select(key, "_b", F.lead("_first").over(W.partitionBy(key).orderBy("_b")).alias("_after"))
    return inside.join(after, [key, "_b"]).select(key, t, F.coalesce("next", "_after").alias("next"))


def factor(raw: Column, lower: Column, upper: Column) -> Column:
    """Where a time lies between two samples, 0 to 1; 0 if they are one."""
    return F.when(upper > lower, (raw - lower) / (upper - lower)).otherwise(0.0)


def lerp(first: DataFrame, second: DataFrame, key: str, names: list[str], f: float, check: bool = False) -> DataFrame:
    """Fields between two snapshots with the same keys; at the ends a snapshot as it is.

    Integers are no fields to interpolate. With ``check``, the snapshots must hold the same keys."""
    kinds = dict(first.dtypes) | dict(second.dtypes)
    if wrong := [n for n in names if kinds[n] not in ("double", "float")]:
        raise TypeError(f"only floating-point fields are interpolated, not {wrong}")
    if check:
        alone = first.select(key).join(second.select(key), key, "left_anti").unionByName(second.select(key).join(first.select(key), key, "left_anti"))
        if n := alone.count():
            raise ValueError(f"{n} keys are in one snapshot only")
    if f <= 0:
        return first.select(key, *names)
    if f >= 1:
        return second.select(key, *names)
    later = second.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    return first.join(later, key).select(key, *[(F.col(n) + (F.col(f"_{n}") - F.col(n)) * f).alias(n) for n in names])


def lerp_mesh(first: MeshDataset, second: MeshDataset, f: float) -> MeshDataset:
    """A mesh between two snapshots: points and all floating-point fields that both hold, of points and of cells.

    Both must hold the same points and cells. Cells, incidence and other columns are the first one's."""

    def between(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        kinds = dict(b.dtypes)
        names = [n for n, kind in a.dtypes if n != key and {kind, kinds.get(n)} <= {"double", "float"}]
        moved, others = lerp(a, b, key, names, f, check=True), [n for n in a.columns if n not in names]
        return (moved if others == [key] else a.select(others).join(moved, key)).select(a.columns)

    return first.with_points(between(first.points, second.points, "point_idx")).with_cells(between(first.cells, second.cells, "cell_idx"))


def shifted(t: Column, scale: float, offset: float) -> Column:
    return t * scale + offset


def locked(queries: DataFrame, t: str, at: float | None) -> DataFrame:
    """Queries at their own times, or all at a locked one."""
    return queries if at is None else queries.withColumn(t, F.lit(float(at)))


def snapshots(geometry: DataFrame, field: DataFrame, t: str, at: float) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(geometry, earlier field, later field, factor) for a time. Geometry and field are snapped
    by their own samples, so a mesh that does not move has one snapshot for all field times."""
    def around(df: DataFrame) -> tuple[float, float]:
        ends = df.agg(F.max(F.when(F.col(t) <= at, F.col(t))).alias("low"), F.min(F.when(F.col(t) >= at, F.col(t))).alias("high"), F.min(t).alias("first"), F.max(t).alias("last")).first()
        return (ends.low if ends.low is not None else ends.first), (ends.high if ends.high is not None else ends.last)

    still, (low, high) = around(geometry)[0], around(field)
    pick = lambda df, x: df.where(F.col(t) == F.lit(x)).drop(t)
    return pick(geometry, still), pick(field, low), pick(field, high), (at - low) / (high - low) if high > low else 0.0
