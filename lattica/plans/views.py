"""What a viewer asks for, each composed of operators and lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import MeshDataset
from ..functions import vectors
from ..operators import convert, grid, integrate, mesh_probe, metrics, resample, select, stats, temporal, topology
from .registry import operator


def mapped(value: Column, domain: tuple[float, float] | None, to: tuple[float, float]) -> Column:
    """A field's values for display; an invalid domain leaves them as they are."""
    return value if domain is None or domain[0] > domain[1] else vectors.remap(value, domain, to)


def field(points: DataFrame, names: list[str], mode: str = "unchanged", component: int = 0) -> Column:
    """One field of several single columns, as a vector, its magnitude or a component."""
    v = vectors.assemble(*[F.col(n) for n in names])
    if len(names) == 1 or mode == "selected component":
        return F.col(names[component if len(names) > 1 else 0]).cast("double")
    return vectors.magnitude(v) if mode == "vector magnitude" else v


def point_cloud(mesh: MeshDataset, cell_fields: tuple[str, ...] = (), used_only: bool = False) -> DataFrame:
    """A mesh's points with its cell fields moved to them."""
    out = select.used_points(mesh) if used_only else mesh.points
    for name in cell_fields:
        out = out.join(convert.to_points(mesh, name), "point_idx")
    return out


@operator("points view", ("mesh",))
def points_view(mesh: MeshDataset, width: str, domain: tuple[float, float], widths: tuple[float, float], most: int = 0) -> DataFrame:
    """Used points with display widths from a field; at most ``most`` of them, by a stride."""
    out = select.used_points(mesh).withColumn("width", mapped(F.col(width), domain, widths))
    return select.stride_sample(out, "point_idx", most) if most else out


@operator("glyphs", ("mesh",))
def glyphs(mesh: MeshDataset, direction: tuple[str, str, str], scale: str, domain: tuple[float, float], scales: tuple[float, float], most: int = 0) -> DataFrame:
    """Used points with an orientation (quaternion) and a scale."""
    out = points_view(mesh, scale, domain, scales, most).withColumnRenamed("width", "scale")
    return out.withColumn("orientation", vectors.direction_quaternion(*[F.col(c).cast("double") for c in direction]))


@operator("faces", ("cells",))
def faces(cells: DataFrame, fields: DataFrame | None = None, external_only: bool = False) -> DataFrame:
    """Faces of cells, with the cells' fields."""
    out = topology.external_faces(cells) if external_only else topology.cell_faces(cells)
    return out if fields is None else out.join(fields, "cell_idx")


def emitter(mesh: MeshDataset, velocity: list[str]) -> DataFrame:
    """The scale that takes the fastest point across the bounds' diagonal: scale, fastest, diagonal."""
    b = metrics.bounds(mesh.points).select(F.sqrt(sum((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in metrics.AXES)).alias("diagonal"))
    speed = mesh.points.agg(F.max(F.sqrt(sum(F.col(c) ** 2 for c in velocity))).alias("fastest"))
    return b.crossJoin(F.broadcast(speed)).select(F.when(F.col("fastest") > 0, F.col("diagonal") / F.col("fastest")).otherwise(1.0).alias("scale"), "fastest", "diagonal")


def gaussian_voxels(points: DataFrame, low: grid.IJK, high: grid.IJK, size: float, factor: float = 2.0, sharpness: float = 2.0) -> DataFrame:
    """Voxels splatted from points: radius = factor x voxel; five voxels or fewer along an axis are refused."""
    if min(h - lo + 1 for lo, h in zip(low, high, strict=True)) <= 5:
        raise ValueError("more than five voxels are needed along each axis")
    centres = grid.voxel_centres(points.sparkSession, low, high, (size,) * 3, "point")
    return resample.gaussian(centres, points, factor * size, sharpness, ["i", "j", "k"])


def prepared(mesh: MeshDataset, name: str, box: select.Box | None = None, mode: str = "all", inflate: float = 0.0, resolution: int | None = None, radius: float | None = None, sharpness: float = 2.0) -> DataFrame:
    """A field of a mesh in a viewer's fixed order: moved to the points if cells have it, cut to
    a region, and splatted into voxels if a resolution is given.

    Without one: point_idx, x, y, z and the field of the points that the region's cells use.
    With one: i, j, k, value and weight of voxels around the region's points; the radius is
    two voxels if none is given."""
    if name not in mesh.points.columns:
        mesh = mesh.with_points(mesh.points.join(convert.to_points(mesh, name), "point_idx"))
    if box is not None:
        mesh = select.region_subset(mesh, box, mode, inflate)
    points = select.used_points(mesh).select("point_idx", *metrics.AXES, name)
    if resolution is None:
        return points
    ends = metrics.bounds(points).first()
    low, high = (tuple(ends[f"{e}_{a}"] for a in metrics.AXES) for e in ("min", "max"))
    first, last, size = grid.fit_voxels(low, high, resolution)
    centres = grid.voxel_centres(points.sparkSession, first, tuple(h - 1 for h in last), (size,) * 3)
    cloud = points.select(*metrics.AXES, F.col(name).alias("value"))
    return resample.gaussian(centres, cloud, radius or 2 * size, sharpness, ["i", "j", "k"])


def field_panel(df: DataFrame, columns: list[str], bins: int = 32) -> tuple[DataFrame, DataFrame]:
    """(field, dtype, n, min, max, mean; histograms of all fields as field, bin, n): one pass
    for the ranges and one for all histograms."""
    found = stats.summary(df, columns)
    return found, stats.histograms(df, columns, bins)


def faces_at(cells: DataFrame, geometry: DataFrame, values: DataFrame, t: str, at: float, name: str) -> DataFrame:
    """Faces with a cell field between its two samples around a time, and the points of the
    geometry's own sample: cell_idx, local_face, pos, x, y, z and the field."""
    points, low, high, f = temporal.snapshots(geometry, values, t, at)
    field = temporal.lerp(low, high, "cell_idx", [name], f)
    flat = faces(cells, field).select("cell_idx", "local_face", F.posexplode("face_pts").alias("pos", "point_idx"), name)
    return flat.join(points.select("point_idx", *metrics.AXES), "point_idx").select("cell_idx", "local_face", "pos", *metrics.AXES, name)


def streamlines(seeds: DataFrame, velocity: DataFrame, nodes: DataFrame, space: grid.ImageGrid, names: list[str], direction: str = "both", longest: float | None = None, **options: object) -> DataFrame:
    """Lines with the fields of the nodes probed along them, cut where they are ``longest`` away
    from the seed along the line; lines cut to a single point go."""
    lines = integrate.streamlines(seeds, velocity, space, direction, **options)
    if longest is not None:
        lines = _cut(lines, longest)
    found = grid.probe(lines.withColumnRenamed("cell_idx", "_cell"), nodes, space, names)
    return found.select("seed_idx", "seq", *metrics.AXES, "t", F.col("_cell").alias("cell_idx"), *[f"probed_{n}" for n in names])


def mesh_streamlines(seeds: DataFrame, cells: DataFrame, points: DataFrame, velocity: list[str], names: list[str], direction: str = "both", longest: float | None = None, faces: DataFrame | None = None, **options: object) -> DataFrame:
    """Lines through a mesh with fields of its points along them, cut as in ``streamlines``."""
    lines = integrate.mesh_streamlines(seeds, cells, points, velocity, direction, faces=faces, fields=tuple(names), **options)
    return lines if longest is None else _cut(lines, longest)


def _cut(lines: DataFrame, longest: float) -> DataFrame:
    lines = lines.where(F.abs("t") <= longest)
    kept = lines.groupBy("seed_idx").agg(F.count("*").alias("_n"), F.min("seq").alias("_first")).where("_n > 1")
    return lines.join(kept, "seed_idx").withColumn("seq", F.col("seq") - F.col("_first")).drop("_n", "_first")


def mesh_volume(cells: DataFrame, points: DataFrame, resolution: int, roi: tuple[grid.Vec, grid.Vec] | None = None, inflate: float = 0.0, faces: DataFrame | None = None, background: float | None = None, field: str = "value", cell_field: bool = False) -> tuple[DataFrame, grid.ImageGrid]:
    """(voxels i, j, k, value and mask, their grid) of a region of a mesh, at most ``resolution`` along an axis."""
    ends = metrics.bounds(points).first()
    box = tuple(tuple(ends[f"{e}_{a}"] for a in metrics.AXES) for e in ("min", "max"))
    low, high, size = grid.fit_voxels(*grid.region(*box, roi, inflate), resolution)
    voxels = mesh_probe.voxelize(cells, points, low, tuple(h - 1 for h in high), (size,) * 3, "cell", faces, background, field, cell_field)
    return voxels, grid.ImageGrid((0.0, 0.0, 0.0), (size,) * 3, low, high)


def volume(nodes: DataFrame, space: grid.ImageGrid, resolution: int, roi: tuple[grid.Vec, grid.Vec] | None = None, inflate: float = 0.0, background: float | None = None) -> tuple[DataFrame, grid.ImageGrid]:
    """(voxels i, j, k, value and mask, their grid) of a region of a volume, at most ``resolution`` along an axis."""
    low, high, size = grid.fit_voxels(*grid.region(*space.bounds, roi, inflate), resolution)
    voxels = grid.voxelize(nodes, space, low, tuple(h - 1 for h in high), (size,) * 3, "cell", background)
    return voxels, grid.ImageGrid((0.0, 0.0, 0.0), (size,) * 3, low, high)


def validated(mesh: MeshDataset) -> MeshDataset:
    """The mesh, if its tables have the columns of the normal form."""
    for name, df, needed in (("points", mesh.points, {"point_idx", "x", "y", "z"}), ("cells", mesh.cells, {"cell_idx"}), ("cell_points", mesh.cell_points, {"cell_idx", "point_idx"})):
        if missing := needed - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    return mesh


def dangling(mesh: MeshDataset) -> DataFrame:
    """Incidences whose point or cell is missing; empty for a sound mesh."""
    no_point = mesh.cell_points.join(mesh.points.select("point_idx"), "point_idx", "left_anti").select("cell_idx", "point_idx")
    no_cell = mesh.cell_points.join(mesh.cells.select("cell_idx"), "cell_idx", "left_anti").select("cell_idx", "point_idx")
    return no_point.unionByName(no_cell).distinct()
