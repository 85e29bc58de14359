"""Probing unstructured meshes of mixed cells: samples, voxels, planes and collections of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .spatial import AXES, HEXAHEDRON, POLYHEDRON, PYRAMID, SLACK, SOLIDS, TETRA, VOXEL, WEDGE, Mesh, bounds_of, located, solids

__all__ = ["HEXAHEDRON", "POLYHEDRON", "PYRAMID", "TETRA", "VOXEL", "WEDGE"]

#: Voxels that a task tests at once.
VOXELS = 1 << 19


def checked(cells: DataFrame, faces: DataFrame | None) -> None:
    """Refuses cells that hold no position, before anything else runs."""
    kinds = {r.cell_type for r in cells.select("cell_type").distinct().collect()}  # as many as there are types
    if wrong := sorted(kinds - {*SOLIDS, POLYHEDRON}):
        raise ValueError(f"cells of types {wrong} cannot be probed")
    if POLYHEDRON in kinds and faces is None:
        raise ValueError("polyhedra need faces")


def located_in(samples: DataFrame, key: str, cells: DataFrame, points: DataFrame, faces: DataFrame | None = None, fields: tuple[str, ...] = ("value",)) -> DataFrame:
    """Samples with the cell_idx that holds them, its corners' weights and each field there; null outside all cells."""
    found = located(samples, key, solids(cells, points, list(fields), faces), len(fields), outside=True)
    return found.select(*samples.columns, "cell_idx", "weights", *[F.get("values", F.lit(k)).alias(n) for k, n in enumerate(fields)])


def probe_mesh(samples: DataFrame, key: str, cells: DataFrame, points: DataFrame, faces: DataFrame | None = None, outside: float = 0.0, fields: tuple[str, ...] = ("value",)) -> DataFrame:
    """Samples with cell_idx, mask 1/0 and the fields, interpolated in the cell that holds them.

    cells: cell_idx, cell_type and, but for polyhedra, pts; points: point_idx, x, y, z and the fields; faces, of
    polyhedra: cell_idx, face_idx and face_pts. Cells of fewer than three dimensions hold no
    position and are refused before anything runs. The smallest cell_idx wins."""
    checked(cells, faces)
    found = located_in(samples, key, cells, points, faces, fields)
    return found.select(*samples.columns, "cell_idx", F.col("cell_idx").isNotNull().cast("int").alias("mask"), *[F.coalesce(n, F.lit(outside)).alias(n) for n in fields])


def probe_cells(samples: DataFrame, key: str, cells: DataFrame, points: DataFrame, field: str, faces: DataFrame | None = None, outside: float = 0.0) -> DataFrame:
    """Samples with cell_idx, mask and a field of the cell that holds them, not interpolated."""
    checked(cells, faces)
    found = located_in(samples, key, cells, points, faces, ()).drop("weights")
    held = found.join(cells.select("cell_idx", F.col(field).alias("_v")), "cell_idx", "left")
    return held.select(*samples.columns, "cell_idx", F.col("cell_idx").isNotNull().cast("int").alias("mask"), F.coalesce("_v", F.lit(outside)).alias(field))


def rasterized(cells: DataFrame, points: DataFrame, low: grid.IJK, high: grid.IJK, size: grid.Vec, association: str = "cell", faces: DataFrame | None = None, fields: tuple[str, ...] = ("value",)) -> DataFrame:
    """i, j, k, cell_idx and the fields of the voxels, extents inclusive, that have their sample position in a cell.

    Each cell makes the positions inside its bounds and tests them, so no voxel is searched for and
    cells need not meet; of several cells the smallest stays."""
    shift, step = 0.5 if association == "cell" else 0.0, np.array(size, float)
    first, last = np.array(low), np.array(high)
    names = ["i", "j", "k", "cell_idx", *fields]
    schema = "i long, j long, k long, cell_idx long" + "".join(f", `{n}` double" for n in fields)

    def made(mesh: Mesh) -> Iterator[pa.RecordBatch]:
        for group in mesh.groups:
            begin = np.maximum(np.ceil(group.low / step - shift), first).astype(np.int64)
            end = np.minimum(np.floor(np.where(np.isfinite(group.high), group.high, group.low - 1) / step - shift), last).astype(np.int64)
            dims = np.maximum(end - begin + 1, 0)
            count = dims.prod(axis=1)
            total = np.concatenate(([0], np.cumsum(count)))
            for at in range(0, int(total[-1]), VOXELS):
                number = np.arange(at, min(at + VOXELS, int(total[-1])))
                element = np.searchsorted(total, number, "right") - 1
                n, d = number - total[element], dims[element]
                ijk = begin[element] + np.column_stack([n % d[:, 0], n // d[:, 0] % d[:, 1], n // (d[:, 0] * d[:, 1])])
                w, inside = group.weights((ijk + shift) * step, element)
                ijk, element, w = ijk[inside], element[inside], w[inside]
                value = np.einsum("nk,nkf->nf", w, group.values[element])
                yield pa.RecordBatch.from_arrays([*map(pa.array, ijk.T), pa.array(group.owner[element]), *map(pa.array, value.T)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from made(Mesh(pa.Table.from_batches([batch])))

    box = [(F.lit(float((lo + shift) * s - SLACK)), F.lit(float((hi + shift) * s + SLACK))) for lo, hi, s in zip(low, high, size, strict=True)]
    met = bounds_of(solids(cells, points, list(fields), faces))
    for a, (lo, hi) in zip(AXES, box, strict=True):
        met = met.where((F.col(f"_h{a}") >= lo) & (F.col(f"_l{a}") <= hi))
    hits = met.select("cell_idx", "cell_type", "corners").mapInArrow(run, schema)
    one = F.min(F.struct("cell_idx", *fields))
    return hits.groupBy("i", "j", "k").agg(one.alias("h")).select("i", "j", "k", "h.*")


def voxelize(cells: DataFrame, points: DataFrame, low: grid.IJK, high: grid.IJK, size: grid.Vec, association: str = "cell", faces: DataFrame | None = None, background: float | None = None, field: str = "value", cell_field: bool = False) -> DataFrame:
    """i, j, k, value and mask of every voxel: a field of the points interpolated, or a field of the cells as it is.
    Outside the mesh: the background, else the field's minimum."""
    checked(cells, faces)
    hits = rasterized(cells, points, low, high, size, association, faces, () if cell_field else (field,))
    if cell_field:
        hits = hits.join(cells.select("cell_idx", field), "cell_idx")
    every = grid.voxel_centres(cells.sparkSession, low, high, size, association).select("i", "j", "k")
    out = every.join(hits.select("i", "j", "k", F.col(field).cast("double").alias("_v"), F.lit(1).alias("_m")), ["i", "j", "k"], "left").withColumn("mask", F.coalesce("_m", F.lit(0)))
    if background is not None:
        return out.select("i", "j", "k", F.when(F.col("mask") == 1, F.col("_v")).otherwise(F.lit(float(background))).alias("value"), "mask")
    least = (cells if cell_field else points).agg(F.min(field).cast("double").alias("_least"))
    return out.crossJoin(F.broadcast(least)).select("i", "j", "k", F.when(F.col("mask") == 1, F.col("_v")).otherwise(F.col("_least")).alias("value"), "mask")


def cut_cells(cells: DataFrame, normals: list[grid.Vec], centre: grid.Vec) -> DataFrame:
    """``solids`` that any of the planes through the centre cuts: the signed distances of their bounds' corners lie on both sides."""
    boxed = bounds_of(cells)
    cuts = F.lit(False)
    for n in normals:
        ends = [[(F.col(f"_{e}{a}") - F.lit(float(c))) * F.lit(float(x)) for e in "lh"] for a, c, x in zip(AXES, centre, n, strict=True)]
        cuts |= (sum(F.least(*e) for e in ends) <= 2 * SLACK) & (sum(F.greatest(*e) for e in ends) >= -2 * SLACK)
    return boxed.where(cuts).select(*cells.columns)


def slices(cells: DataFrame, points: DataFrame, mode: str, centre: grid.Vec, width: int, height: int, normal: grid.Vec | None = None, faces: DataFrame | None = None, fields: tuple[str, ...] = ("value",), outside: float = 0.0) -> DataFrame:
    """Probed planes of a mesh in one pass: slice, col, row, cell_idx, mask and the fields; mode ``free`` takes a normal.

    Only cells that a plane cuts are met; planes span the mesh's bounds."""
    checked(cells, faces)
    normals = {"free": normal} if mode == "free" else {a: tuple(float(a == b) for b in AXES) for a in grid.SLICES[mode]}
    ends = points.agg(*[f(a).alias(f"{n}_{a}") for n, f in (("low", F.min), ("high", F.max)) for a in AXES]).first()
    low, high = (tuple(float(ends[f"{n}_{a}"]) for a in AXES) for n in ("low", "high"))
    planes = None
    for name, n in normals.items():
        p = grid.slice_positions(points.sparkSession, grid.plane_quad(centre, n, low, high), width, height).withColumn("slice", F.lit(name))
        planes = p if planes is None else planes.unionByName(p)
    number = F.array_position(F.array(*[F.lit(n) for n in normals]), F.col("slice"))
    planes = planes.withColumn("_key", (number * height + F.col("row")) * width + F.col("col"))
    cut = cut_cells(solids(cells, points, list(fields), faces), list(normals.values()), centre)
    found = located(planes, "_key", cut, len(fields), outside=True)
    return found.select("slice", "col", "row", "cell_idx", F.col("cell_idx").isNotNull().cast("int").alias("mask"), *[F.coalesce(F.get("values", F.lit(k)), F.lit(outside)).alias(n) for k, n in enumerate(fields)])


def first_piece(hits: list[DataFrame], key: str) -> DataFrame:
    """Hits (key, cell_idx, value) of the pieces of a collection, in order: each key with the
    first piece that has it."""
    every = None
    for k, one in enumerate(hits):
        part = one.where("cell_idx is not null").select(key, F.lit(k).alias("piece_id"), "cell_idx", "value")
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min(F.struct("piece_id", "cell_idx", "value")).alias("h")).select(key, "h.*")
