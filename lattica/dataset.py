"""Datasets in normal form: points, cells and their incidence, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MeshDataset:
    """points(point_idx, x, y, z, fields), cells(cell_idx, fields) and
    cell_points(cell_idx, point_idx, ...). Operators return new datasets or DataFrames."""

    points: DataFrame
    cells: DataFrame
    cell_points: DataFrame
    traits: dict[str, str] = field(default_factory=dict)

    def with_points(self, points: DataFrame) -> MeshDataset:
        return replace(self, points=points)

    def with_cells(self, cells: DataFrame) -> MeshDataset:
        return replace(self, cells=cells)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_mesh(spark: SparkSession, sf_dir: str) -> MeshDataset:
    """Parts as points, orders as cells, line items as incidence."""
    part, orders, lines = (table(spark, sf_dir, n) for n in ("part", "orders", "lineitem"))
    points = part.select(F.col("p_partkey").alias("point_idx"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"))
    cells = orders.select(F.col("o_orderkey").alias("cell_idx"), F.col("o_totalprice").alias("value"))
    return MeshDataset(points, cells, lines.select(F.col("l_orderkey").alias("cell_idx"), F.col("l_partkey").alias("point_idx")))


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a point cloud: point_idx, x, y, z and value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("point_idx"), (F.col("value") / 10).alias("x"), F.col("user_id").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"), "value")


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the vertex field of an implicit grid: i from quantity, j from
    discount, k from tax; value is the mean extended price."""
    li = table(spark, sf_dir, "lineitem")
    node = [F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("k")]
    return li.groupBy(*node).agg(F.avg("l_extendedprice").alias("value"))
