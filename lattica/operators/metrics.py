"""Bounds, sizes, centres and counts of meshes. Cells without points get zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import MeshDataset

AXES = ("x", "y", "z")


def bounds(points: DataFrame) -> DataFrame:
    """min_x ... max_z of all points, used or not."""
    return points.agg(*[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES])


def piece_bounds(points: DataFrame, piece: str) -> DataFrame:
    """Bounds of each piece of a collection and, with a null piece, of all: one pass."""
    return points.rollup(piece).agg(*[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES])


def corners(mesh: MeshDataset) -> DataFrame:
    """Cells' points with coordinates: cell_idx, point_idx, x, y, z."""
    return mesh.cell_points.join(mesh.points.select("point_idx", *AXES), "point_idx")


def cell_metrics(mesh: MeshDataset) -> DataFrame:
    """Bounds, centre, size (diagonal of the bounds) and point count of each cell, in one aggregation."""
    per = corners(mesh).groupBy("cell_idx").agg(*[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES], *[F.avg(a).alias(f"center_{a}") for a in AXES], F.count("*").alias("n_points"))
    names = [c for c in per.columns if c != "cell_idx"]
    filled = mesh.cells.select("cell_idx").join(per, "cell_idx", "left").select("cell_idx", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return filled.withColumn("size", F.sqrt(sum((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in AXES)))


def cell_bounds(mesh: MeshDataset) -> DataFrame:
    return cell_metrics(mesh).select("cell_idx", *[f"{e}_{a}" for e in ("min", "max") for a in AXES])


def cell_sizes(mesh: MeshDataset) -> DataFrame:
    return cell_metrics(mesh).select("cell_idx", "size")


def centroids(mesh: MeshDataset) -> DataFrame:
    return cell_metrics(mesh).select("cell_idx", *[f"center_{a}" for a in AXES])


def union_of_cell_bounds(mesh: MeshDataset) -> DataFrame:
    """Bounds of the points that cells use."""
    return bounds(corners(mesh))


def cell_point_counts(mesh: MeshDataset) -> DataFrame:
    """Points of each cell, repeats counted."""
    counts = mesh.cell_points.groupBy("cell_idx").agg(F.count("*").alias("n"))
    return mesh.cells.select("cell_idx").join(counts, "cell_idx", "left").select("cell_idx", F.coalesce("n", F.lit(0)).alias("n_points"))


def point_cell_counts(mesh: MeshDataset) -> DataFrame:
    """Incidences of each point, repeats counted."""
    counts = mesh.cell_points.groupBy("point_idx").agg(F.count("*").alias("n"))
    return mesh.points.select("point_idx").join(counts, "point_idx", "left").select("point_idx", F.coalesce("n", F.lit(0)).alias("n_cells"))


#: Cells of one row of point links.
LINKS = 100_000


def point_links(mesh: MeshDataset, most: int = LINKS) -> DataFrame:
    """The distinct cells of each point, sorted: the inverse of the incidence. A point of more
    than ``most`` cells has several rows, told by ``chunk``, which hold a share of them each."""
    pairs = mesh.cell_points.select("point_idx", "cell_idx").distinct()
    loads = pairs.groupBy("point_idx").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    loads = loads.select("point_idx", F.ceil(F.col("_n") / F.lit(most)).cast("long").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("cell_idx"), F.coalesce("_chunks", F.lit(1).cast("long"))).cast("int")
    return pairs.join(loads, "point_idx", "left").groupBy("point_idx", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("cell_idx")).alias("cells"))


def box_edges(points: DataFrame) -> DataFrame:
    """The 12 edges of the bounds: edge, end, x, y, z (24 rows)."""
    b = bounds(points)
    edges = points.sparkSession.range(12).select(F.col("id").cast("int").alias("edge"))
    axis, rest = F.floor(F.col("edge") / 4).cast("int"), (F.col("edge") % 4).cast("int")
    ends = edges.select("edge", axis.alias("axis"), rest.alias("rest"), F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    # Bit of each axis: the edge's own axis takes the end, the other two the bits of rest.
    low, high = F.col("rest") % 2, F.floor(F.col("rest") / 2)
    bit = {"x": F.when(F.col("axis") == 0, F.col("end")).otherwise(low), "y": F.when(F.col("axis") == 1, F.col("end")).when(F.col("axis") == 0, low).otherwise(high), "z": F.when(F.col("axis") == 2, F.col("end")).otherwise(high)}
    return ends.crossJoin(F.broadcast(b)).select("edge", "end", *[F.when(bit[a] == 1, F.col(f"max_{a}")).otherwise(F.col(f"min_{a}")).alias(a) for a in AXES])
