"""Selections: boxes, regions, index ranges, strides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import MeshDataset
from .metrics import AXES, corners
from .scan import dense_index

Box = tuple[tuple[float, float, float], tuple[float, float, float]]


def inflated(box: Box, percent: float) -> Box:
    """A box grown about its centre by a percentage of its size."""
    grow = [(hi - lo) * percent / 200 for lo, hi in zip(*box, strict=True)]
    return tuple(lo - g for lo, g in zip(box[0], grow, strict=True)), tuple(hi + g for hi, g in zip(box[1], grow, strict=True))


def inside(box: Box, names: tuple[str, str, str] = AXES) -> Column:
    """Whether a position is in the closed box."""
    if any(lo > hi for lo, hi in zip(*box, strict=True)):
        raise ValueError("box minimum above its maximum")
    out = F.lit(True)
    for name, lo, hi in zip(names, *box, strict=True):
        out &= F.col(name).between(lo, hi)
    return out


def box_mask(mesh: MeshDataset, box: Box, mode: str = "all") -> DataFrame:
    """cell_idx and mask 0/1: all points inside, any, or the centroid; 0 for a cell without points."""
    if mode not in ("all", "any", "centroid"):
        raise ValueError(f"unknown mode {mode}; one of all, any, centroid")
    if mode == "centroid":
        hit = corners(mesh).groupBy("cell_idx").agg(*[F.avg(a).alias(a) for a in AXES]).select("cell_idx", inside(box).alias("_in"))
    else:
        fold = F.bool_and if mode == "all" else F.bool_or
        hit = corners(mesh).groupBy("cell_idx").agg(fold(inside(box)).alias("_in"))
    return mesh.cells.select("cell_idx").join(hit, "cell_idx", "left").select("cell_idx", F.coalesce(F.col("_in").cast("int"), F.lit(0)).alias("mask"))


def cells_in_box(mesh: MeshDataset, box: Box, mode: str = "all") -> DataFrame:
    """The cells of the mask, ascending, with their new index from 0."""
    return dense_index(box_mask(mesh, box, mode).where("mask = 1").select("cell_idx"), "cell_idx", "new_idx")


def cell_subset(mesh: MeshDataset, cells: DataFrame) -> MeshDataset:
    """The mesh of some cells (cell_idx, new_idx), renumbered; all points stay."""
    # The subset's cells are read once for each table; AQE broadcasts them where they are few.
    kept = mesh.cells.join(cells, "cell_idx").withColumn("old_idx", F.col("cell_idx")).withColumn("cell_idx", F.col("new_idx")).drop("new_idx")
    links = mesh.cell_points.join(cells, "cell_idx").withColumn("cell_idx", F.col("new_idx")).drop("new_idx")
    return MeshDataset(mesh.points, kept, links, mesh.traits)


def region_subset(mesh: MeshDataset, box: Box, mode: str = "all", inflate: float = 0.0) -> MeshDataset:
    return cell_subset(mesh, cells_in_box(mesh, inflated(box, inflate), mode))


def subrange(df: DataFrame, index: str, start: int, count: int, size: int | None = None) -> DataFrame:
    """Rows [start, start + count) of an index that starts at 0, shifted to 0; within ``size``, if given."""
    if start < 0 or count < 0 or (size is not None and start + count > size):
        raise ValueError("start and count must not be negative or go beyond the size")
    return df.where(F.col(index).between(start, start + count - 1)).withColumn(index, F.col(index) - start)


def take_indices(df: DataFrame, index: str, ids: DataFrame, order: str, key: str) -> DataFrame:
    """Rows by explicit indices (order, key), repeats allowed, renumbered by order."""
    wanted = ids.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    return wanted.join(df, wanted["_key"] == df[index]).drop(index, "_key").withColumnRenamed("_order", index)


def pick(df: DataFrame, index: str, *, span: tuple[int, int] | None = None, ids: DataFrame | None = None, order: str = "order", key: str = "id") -> DataFrame:
    """Exactly one of a range and explicit indices."""
    if (span is None) == (ids is None):
        raise ValueError("give either a range or indices")
    return subrange(df, index, *span) if span else take_indices(df, index, ids, order, key)


def used_points(mesh: MeshDataset) -> DataFrame:
    return mesh.points.join(mesh.cell_points, "point_idx", "left_semi")


def unused_points(mesh: MeshDataset) -> DataFrame:
    return mesh.points.join(mesh.cell_points, "point_idx", "left_anti")


def stride_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """Every stride-th row by key, so that at most ``most`` rows stay; stride = ceil(n / most)."""
    numbered = dense_index(df, key, "_rank")
    n = df.agg(F.count("*").alias("_n"))
    stride = F.ceil(F.greatest(F.col("_n"), F.lit(1)) / F.lit(most))
    return numbered.crossJoin(F.broadcast(n)).where(F.col("_rank") % stride == 0).drop("_rank", "_n")


def threshold(value: Column, low: float | None = None, high: float | None = None, below: float | None = None, above: float | None = None) -> Column:
    """Values outside the limits become the fill values (null if none)."""
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(below)).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(above)).otherwise(out)
    return out


def boundary_patch(faces: DataFrame, start: int, count: int) -> DataFrame:
    """The faces of a patch: a contiguous range of face indices."""
    return faces.where(F.col("face_idx").between(start, start + count - 1))
