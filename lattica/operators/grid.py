"""Implicit regular grids: points, cells, location, probing, voxels and slices.

A grid is a few numbers. Locating a position is arithmetic, so probing costs one
join of the samples with the cells' corner values, whatever the number of samples.
Ids are i-fastest: id = k (nx ny) + j nx + i.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Vec = tuple[float, float, float]
IJK = tuple[int, int, int]
EDGE = 1e-6


@dataclass(frozen=True)
class ImageGrid:
    """Extents are inclusive point indices."""

    origin: Vec
    spacing: Vec
    low: IJK
    high: IJK

    @property
    def point_dims(self) -> IJK:
        return tuple(h - lo + 1 for lo, h in zip(self.low, self.high, strict=True))

    @property
    def cell_dims(self) -> IJK:
        return tuple(max(1, n - 1) for n in self.point_dims)

    @property
    def bounds(self) -> tuple[Vec, Vec]:
        at = lambda e: tuple(o + s * x for o, s, x in zip(self.origin, self.spacing, e, strict=True))
        return at(self.low), at(self.high)


def linear(i: Column, j: Column, k: Column, dims: IJK) -> Column:
    return k * (dims[0] * dims[1]) + j * dims[0] + i


def unlinear(idx: Column, dims: IJK) -> tuple[Column, Column, Column]:
    return idx % dims[0], F.floor(idx / dims[0]) % dims[1], F.floor(idx / (dims[0] * dims[1]))


def grid_points(spark: SparkSession, grid: ImageGrid) -> DataFrame:
    """point_idx, i, j, k, x, y, z of every grid point, made by arithmetic on a range."""
    n = math.prod(grid.point_dims)
    i, j, k = unlinear(F.col("id"), grid.point_dims)
    ijk = [(c.cast("long") + lo).alias(name) for c, lo, name in zip((i, j, k), grid.low, "ijk", strict=True)]
    df = spark.range(n).select(F.col("id").alias("point_idx"), *ijk)
    return df.select("*", *[(F.lit(o) + F.col(c) * F.lit(s)).alias(a) for o, s, c, a in zip(grid.origin, grid.spacing, "ijk", "xyz", strict=True)])


def cell_points(spark: SparkSession, grid: ImageGrid) -> DataFrame:
    """cell_idx, local_idx and point_idx of the grid's hexahedra, in the usual corner order."""
    dims = grid.cell_dims
    i, j, k = unlinear(F.col("id"), dims)
    steps = F.array(*[F.struct(F.lit(n).alias("local_idx"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, (a, b, c) in enumerate(((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)))])
    cells = spark.range(math.prod(dims)).select(F.col("id").alias("cell_idx"), i.alias("i"), j.alias("j"), k.alias("k"), F.explode(steps).alias("s"))
    return cells.select("cell_idx", "s.local_idx", linear(F.col("i") + F.col("s.a"), F.col("j") + F.col("s.b"), F.col("k") + F.col("s.c"), grid.point_dims).cast("long").alias("point_idx"))


def point_links(spark: SparkSession, grid: ImageGrid) -> DataFrame:
    """point_idx and cell_idx of the cells around every point of the grid, by arithmetic."""
    i, j, k = unlinear(F.col("id"), grid.point_dims)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for c in (-1, 0) for b in (-1, 0) for a in (-1, 0)])
    spread = spark.range(math.prod(grid.point_dims)).select(F.col("id").alias("point_idx"), i.alias("i"), j.alias("j"), k.alias("k"), F.explode(around).alias("s"))
    cell = [F.col("i") + F.col("s.a"), F.col("j") + F.col("s.b"), F.col("k") + F.col("s.c")]
    inside = F.lit(True)
    for c, n in zip(cell, grid.cell_dims, strict=True):
        inside &= c.between(0, n - 1)
    return spread.where(inside).select("point_idx", linear(*cell, grid.cell_dims).cast("long").alias("cell_idx"))


def located(samples: DataFrame, grid: ImageGrid) -> DataFrame:
    """Samples (x, y, z, ...) with cell_idx (null outside) and the position u, v, w in the cell.

    A sample on the upper face belongs to the last cell."""
    out, ok, dims = samples, F.lit(True), grid.cell_dims
    for axis, o, s, lo, hi, n, part in zip("xyz", grid.origin, grid.spacing, grid.low, grid.high, dims, "uvw", strict=True):
        at = (F.col(axis) - F.lit(o)) / F.lit(s)
        rel = F.floor(at) - lo
        rel = F.when((rel == n) & (F.abs(at - hi) <= EDGE), F.lit(n - 1)).otherwise(rel)
        out = out.withColumn(f"_{part}", rel).withColumn(part, at - lo - rel)
        ok &= F.col(f"_{part}").between(0, n - 1)
    return out.withColumn("cell_idx", F.when(ok, linear(F.col("_u"), F.col("_v"), F.col("_w"), dims).cast("long"))).drop("_u", "_v", "_w")


def corner_values(nodes: DataFrame, grid: ImageGrid, value: str = "value") -> DataFrame:
    """cell_idx and its eight corner values (0 where a node is missing), from nodes (i, j, k, value).

    Each node goes to the eight cells it belongs to: a bounded fan-out over nodes, not samples."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for c in (0, 1) for b in (0, 1) for a in (0, 1)])
    spread = nodes.select("i", "j", "k", F.col(value).alias("_v"), F.explode(steps).alias("s"))
    cell = [F.col(c) - lo - F.col(f"s.{s}") for c, lo, s in zip("ijk", grid.low, "abc", strict=True)]
    inside = F.lit(True)
    for c, n in zip(cell, grid.cell_dims, strict=True):
        inside &= c.between(0, n - 1)
    corner = F.col("s.c") * 4 + F.col("s.b") * 2 + F.col("s.a")
    spread = spread.where(inside).select(linear(*cell, grid.cell_dims).cast("long").alias("cell_idx"), corner.alias("corner"), "_v")
    return spread.groupBy("cell_idx").agg(*[F.coalesce(F.max(F.when(F.col("corner") == n, F.col("_v"))), F.lit(0.0)).alias(f"c{n}") for n in range(8)])


def trilinear() -> Column:
    """Interpolation of c0..c7 at u, v, w."""
    at = lambda a, b, t: a + (b - a) * t
    c = [F.col(f"c{n}") for n in range(8)]
    low = at(at(c[0], c[1], F.col("u")), at(c[2], c[3], F.col("u")), F.col("v"))
    high = at(at(c[4], c[5], F.col("u")), at(c[6], c[7], F.col("u")), F.col("v"))
    return at(low, high, F.col("w"))


def probe(samples: DataFrame, nodes: DataFrame, grid: ImageGrid, names: list[str] | None = None, outside: float = 0.0) -> DataFrame:
    """Samples with each vertex field interpolated and a mask 1/0; one location for all fields."""
    names = names or ["value"]
    corners = None
    for n in names:
        c = corner_values(nodes, grid, n).select("cell_idx", F.struct(*[f"c{x}" for x in range(8)]).alias(f"_{n}"))
        corners = c if corners is None else corners.join(c, "cell_idx", "full")
    found = located(samples, grid).join(corners, "cell_idx", "left").withColumn("mask", F.col("cell_idx").isNotNull().cast("int"))
    for n in names:
        flat = found.select("*", *[F.col(f"_{n}.c{x}").alias(f"c{x}") for x in range(8)])
        found = flat.withColumn(f"probed_{n}", F.when(F.col("mask") == 1, F.coalesce(trilinear(), F.lit(0.0))).otherwise(F.lit(outside))).drop(*[f"c{x}" for x in range(8)], f"_{n}")
    return found.drop("u", "v", "w")


def probe_cells(samples: DataFrame, cells: DataFrame, grid: ImageGrid, outside: float = 0.0) -> DataFrame:
    """Samples with the value of the cell (cell_idx, value) they are in, not interpolated."""
    found = located(samples, grid).drop("u", "v", "w").join(cells.select("cell_idx", F.col("value").alias("_v")), "cell_idx", "left")
    return found.withColumn("mask", F.col("cell_idx").isNotNull().cast("int")).withColumn("probed_value", F.when(F.col("mask") == 1, F.coalesce("_v", F.lit(0.0))).otherwise(outside)).drop("_v")


def voxel_centres(spark: SparkSession, low: IJK, high: IJK, size: Vec, association: str = "cell") -> DataFrame:
    """Sample positions of voxels: size (ijk + 0.5) for cells, size ijk for points; extents inclusive."""
    shift = 0.5 if association == "cell" else 0.0
    return grid_points(spark, ImageGrid(tuple(shift * s for s in size), size, low, high)).drop("point_idx")


def voxelize(nodes: DataFrame, grid: ImageGrid, low: IJK, high: IJK, size: Vec, association: str = "cell", background: float | None = None) -> DataFrame:
    """i, j, k, value and mask of voxels. Outside the grid: the background, else the field's minimum."""
    out = probe(voxel_centres(nodes.sparkSession, low, high, size, association), nodes, grid)
    if background is not None:
        return out.select("i", "j", "k", F.when(F.col("mask") == 1, F.col("probed_value")).otherwise(F.lit(background)).alias("value"), "mask")
    least = nodes.agg(F.min("value").alias("_least"))
    return out.crossJoin(F.broadcast(least)).select("i", "j", "k", F.when(F.col("mask") == 1, F.col("probed_value")).otherwise(F.col("_least")).alias("value"), "mask")


def region(low: Vec, high: Vec, roi: tuple[Vec, Vec] | None = None, inflate: float = 0.0) -> tuple[Vec, Vec]:
    """Bounds cut to a region of interest and grown about their centre by a percentage."""
    if roi is not None:
        low, high = tuple(map(max, low, roi[0])), tuple(map(min, high, roi[1]))
        if any(a > b for a, b in zip(low, high, strict=True)):
            raise ValueError("the region of interest does not meet the bounds")
    grow = [(b - a) * inflate / 200 for a, b in zip(low, high, strict=True)]
    return tuple(a - g for a, g in zip(low, grow, strict=True)), tuple(b + g for b, g in zip(high, grow, strict=True))


def voxel_extents(low: Vec, high: Vec, size: float) -> tuple[IJK, IJK]:
    """Extents of cubic voxels of a given size around bounds, none of which lies on the outermost layer."""
    if size <= 0:
        raise ValueError("voxels need a size")
    slack = 1e-5
    first = tuple(math.ceil(a / size - slack * max(1.0, abs(a / size))) - 1 for a in low)
    last = tuple(math.floor(b / size + slack * max(1.0, abs(b / size))) + 1 for b in high)
    return first, last


def fit_voxels(low: Vec, high: Vec, resolution: int) -> tuple[IJK, IJK, float]:
    """Extents and size of cubic voxels around bounds, at most ``resolution`` along an axis.

    An axis of length L meets at most L / size + 2 layers, so L / (resolution - 2) always
    fits; a larger divisor is taken if the bounds lie well enough on its layers."""
    length = max(b - a for a, b in zip(low, high, strict=True))
    far = max(abs(x) for x in (*low, *high))
    sizes = [length / d for d in (resolution, resolution - 1, resolution - 2) if d > 0 and length > 0] + [2 * far or 1.0]
    for size in sizes:
        first, last = voxel_extents(low, high, size)
        if max(b - a for a, b in zip(first, last, strict=True)) <= resolution:
            return first, last, size
    raise ValueError(f"bounds on both sides of a voxel's edge do not fit into {resolution}")


def extents_of(low: Vec, high: Vec, spacing: float) -> IJK:
    """Numbers of voxels along each axis: rounded, at a uniform spacing."""
    return tuple(round((h - lo) / spacing) for lo, h in zip(low, high, strict=True))


def intersection(a: tuple[IJK, IJK], b: tuple[IJK, IJK] | None) -> tuple[IJK, IJK]:
    """Common extents; an empty region of interest is ignored."""
    if b is None:
        return a
    low, high = tuple(map(max, a[0], b[0])), tuple(map(min, a[1], b[1]))
    if any(lo > h for lo, h in zip(low, high, strict=True)):
        raise ValueError("extents do not meet")
    return low, high


def dense_copy(nodes: DataFrame, low: IJK, high: IJK) -> DataFrame:
    """A sub-extent of a dense volume with its own linear index."""
    dims = tuple(h - lo + 1 for lo, h in zip(low, high, strict=True))
    keep = F.lit(True)
    for c, lo, h in zip("ijk", low, high, strict=True):
        keep &= F.col(c).between(lo, h)
    return nodes.where(keep).withColumn("point_idx", linear(*[F.col(c) - lo for c, lo in zip("ijk", low, strict=True)], dims).cast("long"))


def to_volume(field: DataFrame, dims: IJK, index: str = "point_idx", check: bool = False) -> DataFrame:
    """A flat field as (i, j, k, value); with ``check``, its length must be the dims' product."""
    if check and (n := field.count()) != math.prod(dims):
        raise ValueError(f"{n} values for {math.prod(dims)} voxels")
    i, j, k = unlinear(F.col(index), dims)
    return field.select(i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"), "value")


def plane_axes(normal: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that span a plane: where the normal is an axis, the next two axes in
    the order x, y, z, x; else the first of those, laid into the plane, and what is square to it."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    along = np.eye(3)[(int(np.abs(n).argmax()) + 1) % 3]
    u = along - (along @ n) * n
    u /= np.linalg.norm(u)
    return tuple(u.tolist()), tuple(np.cross(n, u).tolist())


def plane_quad(centre: Vec, normal: Vec, low: Vec, high: Vec) -> list[Vec]:
    """The smallest rectangle, along the plane's axes, that holds what of the plane is inside
    a box: corners 00, 10, 11, 01. Four times the centre where nothing is.

    A square of the plane that surely holds all of it is cut by the box's six half spaces."""
    c, axes = np.asarray(centre, float), np.array(plane_axes(normal))
    reach = float(np.abs(np.array([low, high]) - c).max()) * 4 + 1
    cut = np.array([(-reach, -reach), (reach, -reach), (reach, reach), (-reach, reach)])
    for axis in range(3):
        for side, limit in ((1.0, low[axis]), (-1.0, high[axis])):
            room = side * (c[axis] + cut @ axes[:, axis] - limit)  # how far inside each corner is
            room[np.abs(room) < 1e-9 * reach] = 0.0
            kept = []
            for k in range(len(cut)):
                here, there = room[k], room[(k + 1) % len(cut)]
                if here >= 0:
                    kept.append(cut[k])
                if here * there < 0:
                    kept.append(cut[k] + (cut[(k + 1) % len(cut)] - cut[k]) * (here / (here - there)))
            if not kept:
                return [tuple(c.tolist())] * 4
            cut = np.array(kept)
    (a, b), (e, f) = cut.min(axis=0), cut.max(axis=0)
    return [tuple((c + s * axes[0] + t * axes[1]).tolist()) for s, t in ((a, b), (e, b), (e, f), (a, f))]


def slice_positions(spark: SparkSession, quad: list[Vec], width: int, height: int) -> DataFrame:
    """col, row, x, y, z at the pixel centres of a rectangle, row by row."""
    px = spark.range(width * height).select((F.col("id") % width).alias("col"), F.floor(F.col("id") / width).alias("row"))
    u, v = (F.col("col") + 0.5) / width, (F.col("row") + 0.5) / height
    return px.select("col", "row", *[((1 - v) * ((1 - u) * p + u * q) + v * ((1 - u) * s + u * r)).alias(a) for a, p, q, r, s in zip("xyz", *quad, strict=True)])


#: Normals of the slice modes.
SLICES = {"x": ["x"], "y": ["y"], "z": ["z"], "xy": ["x", "y"], "xz": ["x", "z"], "yz": ["y", "z"], "xyz": ["x", "y", "z"]}


def slices(nodes: DataFrame, grid: ImageGrid, mode: str, centre: Vec, width: int, height: int, normal: Vec | None = None) -> DataFrame:
    """Probed planes: slice, col, row, value and mask; mode ``free`` takes a normal."""
    normals = {"free": normal} if mode == "free" else {a: tuple(float(a == b) for b in "xyz") for a in SLICES[mode]}
    planes = None
    for name, n in normals.items():
        p = slice_positions(nodes.sparkSession, plane_quad(centre, n, *grid.bounds), width, height).withColumn("slice", F.lit(name))
        planes = p if planes is None else planes.unionByName(p)
    return probe(planes, nodes, grid).select("slice", "col", "row", F.col("probed_value").alias("value"), "mask")
