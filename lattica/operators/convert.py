"""Fields between points and cells, and gathering fields by index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import MeshDataset


def to_cells(mesh: MeshDataset, name: str, association: str = "vertex") -> DataFrame:
    """A vertex field as the mean over each cell's points (0 without points); a cell field as it is."""
    if association == "cell":
        return mesh.cells.select("cell_idx", name)
    if association != "vertex":
        raise ValueError("the field's association must be vertex or cell")
    mean = mesh.cell_points.join(mesh.points.select("point_idx", name), "point_idx").groupBy("cell_idx").agg(F.avg(name).alias("_v"))
    return mesh.cells.select("cell_idx").join(mean, "cell_idx", "left").select("cell_idx", F.coalesce("_v", F.lit(0.0)).alias(name))


def to_points(mesh: MeshDataset, name: str, association: str = "cell") -> DataFrame:
    """A cell field as the mean over each point's cells (0 without cells); a vertex field as it is."""
    if association == "vertex":
        return mesh.points.select("point_idx", name)
    if association != "cell":
        raise ValueError("the field's association must be vertex or cell")
    mean = mesh.cell_points.join(mesh.cells.select("cell_idx", name), "cell_idx").groupBy("point_idx").agg(F.avg(name).alias("_v"))
    return mesh.points.select("point_idx").join(mean, "point_idx", "left").select("point_idx", F.coalesce("_v", F.lit(0.0)).alias(name))


def gather(target: DataFrame, index: str, source: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Fields of a source, looked up by the target's index column."""
    values = source.select(F.col(key).alias("_key"), *names)
    return target.join(values, target[index] == values["_key"]).drop("_key")
