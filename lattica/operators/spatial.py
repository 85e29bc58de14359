"""Location of positions in the cells of a mesh, without a width to be given.

Space is split at medians of a bounded sample of cell centres into boxes of about LEAF_CELLS
cells. A cell goes to every box that its bounds meet, a position to the one it is in; a box with many
positions is dealt to several tasks. Within a task cells are put into bins that suit their own
size, so sizes may differ a thousandfold in one place; what shares a bin is compared by
bounds, and the exact test follows. Geometry travels once for each box, not for each bin. A small
mesh is sent to the tasks, so that positions stay where they are however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .scan import dealt
from .shapes import HEX, HEX_CORNERS, hex_weights, weights

AXES = ("x", "y", "z")
#: Cells of a box of space, boxes at most (beyond, they hold more cells), and sampled centres for each.
LEAF_CELLS, MOST_LEAVES, CENTRES = 50_000, 1 << 15, 16
#: Numbers (positions and fields of cells' corners) of a mesh that is sent to the tasks, at most.
MOST_SENT = 1_000_000
#: Tasks that a mesh's cells are dealt to before they are copied for the parts of a box, at most.
COPIERS = 512
#: Positions of one task, and pairs that are tested at once.
POSITIONS, PAIRS = 25_000, 1 << 20
#: How far bounds reach beyond their cell, and weights under zero.
SLACK = 1e-6
#: Published cell types: solids that hold positions, and the number of their points; fixed values.
TETRA, VOXEL, HEXAHEDRON, WEDGE, PYRAMID, POLYHEDRON = 10, 11, 12, 13, 14, 42
SOLIDS = {TETRA: 4, VOXEL: 8, HEXAHEDRON: 8, WEDGE: 6, PYRAMID: 5}
#: Odd numbers that spread the three indices of a bin over 64 bits.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64).view(np.int64)
#: A voxel's corners in a hexahedron's order.
VOXEL_ORDER = (0, 1, 3, 2, 4, 5, 7, 6)


def solids(cells: DataFrame, points: DataFrame, fields: list[str], faces: DataFrame | None = None) -> DataFrame:
    """cell_idx, cell_type and corners (face, pos, point_idx, x, y, z and the points' fields) of each cell.

    cells: cell_idx, cell_type and, but for polyhedra, pts; faces, of polyhedra: cell_idx, face_idx and face_pts."""
    flat = None
    if "pts" in cells.columns:
        flat = cells.where(F.col("cell_type") != POLYHEDRON).select("cell_idx", "cell_type", F.lit(0).cast("long").alias("face"), F.posexplode("pts").alias("pos", "point_idx"))
    if faces is not None:
        some = cells.where(F.col("cell_type") == POLYHEDRON).select("cell_idx", "cell_type")
        ring = faces.join(some, "cell_idx").select("cell_idx", "cell_type", F.col("face_idx").cast("long").alias("face"), F.posexplode("face_pts").alias("pos", "point_idx"))
        flat = ring if flat is None else flat.unionByName(ring)
    corner = F.struct("face", "pos", "point_idx", *[F.col(a).cast("double").alias(a) for a in AXES], *[F.col(n).cast("double").alias(f"v{k}") for k, n in enumerate(fields)])
    met = flat.join(points.select("point_idx", *dict.fromkeys((*AXES, *fields))), "point_idx")
    return met.groupBy("cell_idx", "cell_type").agg(F.sort_array(F.collect_list(corner)).alias("corners"))


def corner(pos: int, at: list[Column], *values: Column) -> Column:
    """A corner as ``solids`` has it, of a cell that is not in normal form: its place in the cell, position and fields."""
    where = [c.cast("double").alias(a) for c, a in zip(at, AXES, strict=True)]
    return F.struct(F.lit(0).cast("long").alias("face"), F.lit(pos).alias("pos"), F.lit(pos).cast("long").alias("point_idx"), *where, *[v.cast("double").alias(f"v{k}") for k, v in enumerate(values)])


def bounds_of(cells: DataFrame) -> DataFrame:
    """cells with the bounds _lx ... _hz of their corners."""
    ends = {f"_{e}{a}": f(F.transform("corners", lambda c: c[a])) for e, f in (("l", F.array_min), ("h", F.array_max)) for a in AXES}
    return cells.withColumns(ends)


# In a task: cells as arrays


@dataclass
class Elements:
    """Cells, or tetrahedra of polyhedra, of one number of corners: owners (n,), corners (n, k, 3), values (n, k, fields)."""

    owner: np.ndarray
    corners: np.ndarray
    values: np.ndarray
    levels: list[tuple[float, np.ndarray, np.ndarray]] = field(default_factory=list)

    #: Bins are shifted, so that cells on a regular grid do not touch both sides of a border.
    SHIFT = 0.371

    def __post_init__(self):
        self.low, self.high = self.corners.min(axis=1) - SLACK, self.corners.max(axis=1) + SLACK
        if self.corners.shape[1] in (4, HEX):  # frames of tetrahedra and parallelepipeds
            a = self.corners[:, (1, 2, 3) if self.corners.shape[1] == 4 else (1, 3, 4)] - self.corners[:, :1]
            self.affine = np.abs(np.linalg.det(a)) >= 1e-20
            if self.corners.shape[1] == 4:
                self.high[~self.affine] = -np.inf  # a flat one holds nothing
            else:
                bent = np.abs(self.corners[:, :1] + HEX_CORNERS @ a - self.corners).max(axis=(1, 2), initial=0)
                self.affine &= bent <= 1e-9 * np.abs(a).max(axis=(1, 2), initial=0)
            self.frame = np.zeros((len(a), 3, 3))
            self.frame[self.affine] = np.linalg.inv(a[self.affine].transpose(0, 2, 1))
        self.lows, self.highs = np.ascontiguousarray(self.low.T), np.ascontiguousarray(self.high.T)
        extent = np.ptp(self.corners, axis=1).max(axis=1, initial=0)
        base = float(np.median(extent[extent > 0])) if (extent > 0).any() else 1.0
        level = np.maximum(np.ceil(np.log2(np.maximum(extent / base, 1e-30)) - 1e-9), 0).astype(int)
        for k in np.unique(level).tolist():
            rows, width = np.flatnonzero(level == k), base * 2.0**k
            first, last = (np.floor(e[rows] / width + self.SHIFT).astype(np.int64) for e in (self.low + 2 * SLACK, np.where(np.isfinite(self.high), self.high, self.low) - 2 * SLACK))
            first, last = np.minimum(first, last), np.maximum(first, last)
            keys, who = [], []
            for corner in range(8):
                step = np.array([corner & 1, corner >> 1 & 1, corner >> 2])
                there = (first + step <= last).all(axis=1)
                keys.append(self._key((first + step)[there]))
                who.append(rows[there])
            keys, who = np.concatenate(keys), np.concatenate(who)
            order = np.argsort(keys, kind="stable")
            self.levels.append((width, keys[order], who[order]))

    @staticmethod
    def _key(at: np.ndarray) -> np.ndarray:
        """One number for a bin; different bins may share it, which only brings pairs that the test drops."""
        return at @ MIXERS

    def pairs(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, element) of positions inside bounds, some at a time.

        Bins hold what their bounds touch without the slack, so positions at a bin's border are looked up on both sides."""
        columns = np.ascontiguousarray(p.T)
        for width, keys, who in self.levels:
            near, below, above = (np.floor((p + d * SLACK) / width + self.SHIFT).astype(np.int64) for d in (0, -4, 4))
            lookups = [(np.arange(len(p)), near)]
            if len(rows := np.flatnonzero((below != above).any(axis=1))):
                tried = [near[rows]]
                for corner in range(8):
                    at = np.where([corner >> a & 1 for a in range(3)], above[rows], below[rows])
                    new = np.all([(at != x).any(axis=1) for x in tried], axis=0)
                    tried.append(np.where(new[:, None], at, near[rows]))
                    lookups.append((rows[new], at[new]))
            for rows, bins in lookups:
                key = self._key(bins)
                first, count = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                count -= first
                ends = np.cumsum(count)
                begin = 0
                while begin < len(rows):
                    stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                    n = count[begin:stop]
                    row = np.repeat(rows[begin:stop], n)
                    element = who[np.repeat(first[begin:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    for x, low, high in zip(columns, self.lows, self.highs, strict=True):
                        at = x[row]
                        inside = np.flatnonzero((at >= low[element]) & (at <= high[element]))
                        row, element = row[inside], element[inside]
                    yield row, element
                    begin = stop

    def weights(self, p: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the corners, inside) of pairs."""
        k = self.corners.shape[1]
        if k not in (4, HEX):
            return weights(p, self.corners[element])
        r = np.einsum("nij,nj->ni", self.frame[element], p - self.corners[element, 0])
        if k == 4:
            w = np.column_stack([1 - (r[:, 0] + r[:, 1] + r[:, 2]), r])
            return w, _all(w >= -SLACK)
        w, inside = hex_weights(r), _all((r >= -SLACK) & (r <= 1 + SLACK))
        if len(rows := np.flatnonzero(~self.affine[element])):
            w[rows], inside[rows] = weights(p[rows], self.corners[element[rows]])
        return w, inside


def _all(told: np.ndarray) -> np.ndarray:
    """Rows of few columns that are all true."""
    out = told[:, 0].copy()
    for k in range(1, told.shape[1]):
        out &= told[:, k]
    return out


def polyhedra(owner: np.ndarray, face: np.ndarray, point: np.ndarray, xyz: np.ndarray, v: np.ndarray) -> Elements:
    """Star-convex polyhedra as tetrahedra of the cell's centre, a face's centre and an edge, from the corners of
    their faces in order. Centres are means of the points they stand for, each once."""
    both = np.column_stack([xyz, v])
    begins = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (face[1:] != face[:-1]))))
    counts = np.diff(np.append(begins, len(owner)))
    of_face = np.repeat(np.arange(len(begins)), counts)
    face_mean = (np.add.reduceat(both, begins) / counts[:, None])[of_face]
    ids, of_cell = np.unique(owner, return_inverse=True)
    order = np.lexsort((point, of_cell))
    once = order[np.concatenate(([True], (of_cell[order][1:] != of_cell[order][:-1]) | (point[order][1:] != point[order][:-1])))]
    total = np.zeros((len(ids), both.shape[1]))
    np.add.at(total, of_cell[once], both[once])
    cell_mean = (total / np.bincount(of_cell[once], minlength=len(ids))[:, None])[of_cell]
    after = np.arange(1, len(owner) + 1)
    after[begins + counts - 1] = begins
    corners = np.stack([cell_mean, face_mean, both, both[after]], axis=1)
    return Elements(owner, corners[..., :3], corners[..., 3:])


class Mesh:
    """Cells of ``solids`` rows that a task has: where positions lie in them, and values there."""

    def __init__(self, table: pa.Table):
        lists = table["corners"].combine_chunks() if table.num_rows else table["corners"].chunk(0) if table["corners"].num_chunks else pa.array([], table.schema.field("corners").type)
        flat, begin, count = lists.flatten(), lists.offsets.to_numpy()[:-1] - (lists.offsets[0].as_py() if len(lists) else 0), lists.value_lengths().to_numpy(zero_copy_only=False)
        names = [f.name for f in flat.type]
        column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        xyz = np.column_stack([column(a) for a in AXES])
        self.fields = sum(n[0] == "v" for n in names)
        v = np.column_stack([column(f"v{k}") for k in range(self.fields)]) if self.fields else np.zeros((len(xyz), 0))
        ids, kinds = (table[c].to_numpy().astype(np.int64) for c in ("cell_idx", "cell_type"))
        self.cells, self.sizes = ids, np.zeros(len(ids))
        some = np.flatnonzero(count > 0)
        if len(some):
            low, high = np.minimum.reduceat(xyz, begin[some]), np.maximum.reduceat(xyz, begin[some])
            self.sizes[some] = np.linalg.norm(high - low, axis=1)
        order = np.argsort(ids, kind="stable")
        self.cells, self.sizes = ids[order], self.sizes[order]
        self.groups: list[Elements] = []
        for kind, k in SOLIDS.items():
            rows = np.flatnonzero((kinds == kind) & (count == k))
            if len(rows):
                at = begin[rows][:, None] + np.array(VOXEL_ORDER if kind == VOXEL else range(k))
                self.groups.append(Elements(ids[rows], xyz[at], v[at]))
        solid = np.flatnonzero(np.repeat(kinds == POLYHEDRON, count))
        if len(solid):
            self.groups.append(polyhedra(np.repeat(ids, count)[solid], column("face")[solid], column("point_idx")[solid], xyz[solid], v[solid]))

    def find(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell or -1, values, weights, their number, a hint) of positions (n, 3); the smallest cell wins.

        A hint is a group of elements and one of them."""
        n = len(p)
        cell, value, w, corners = np.full(n, -1, np.int64), np.zeros((n, self.fields)), np.zeros((n, 8)), np.zeros(n, np.int64)
        hint = np.full((n, 2), -1)
        for number, group in enumerate(self.groups):
            k = group.corners.shape[1]
            for row, element in group.pairs(p):
                parts, inside = group.weights(p[row], element)
                row, element, parts = row[inside], element[inside], parts[inside]
                order = np.lexsort((element, group.owner[element], row))
                first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
                row, element, parts = row[first], element[first], parts[first]
                better = (cell[row] < 0) | (group.owner[element] < cell[row])
                row, element, parts = row[better], element[better], parts[better]
                cell[row], corners[row] = group.owner[element], k
                hint[row, 0], hint[row, 1] = number, element
                w[row] = 0
                w[row, :k] = parts
                value[row] = np.einsum("nk,nkf->nf", parts, group.values[element])
        return cell, value, w, corners, hint

    def near(self, p: np.ndarray, hint: np.ndarray) -> np.ndarray:
        """Values at positions, each looked for first in the element of its hint: where fields have no jumps between
        cells, any cell that holds a position will do. Zero outside."""
        out, open_ = np.zeros((len(p), self.fields)), np.ones(len(p), bool)
        for number, group in enumerate(self.groups):
            rows = np.flatnonzero(hint[:, 0] == number)
            if len(rows):
                w, inside = group.weights(p[rows], hint[rows, 1])
                rows = rows[inside]
                out[rows] = np.einsum("nk,nkf->nf", w[inside], group.values[hint[rows, 1]])
                open_[rows] = False
        out[open_] = self.find(p[open_])[1]
        return out

    def size_of(self, cells: np.ndarray) -> np.ndarray:
        """Diagonals of cells that are here."""
        return self.sizes[np.searchsorted(self.cells, cells)]


# On the cluster: boxes of space


@dataclass(frozen=True)
class Splits:
    """A tree of splits: node k cuts ``axis[k]`` at ``at[k]``; children under zero are leaves -1 - leaf."""

    axis: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.axis) + 1

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64) if len(self.axis) else np.full(len(p), -1, np.int64)
        while len(rows := np.flatnonzero(node >= 0)):
            k = node[rows]
            node[rows] = np.where(p[rows, self.axis[k]] < self.at[k], self.left[k], self.right[k])
        return -1 - node

    def meeting(self, low: np.ndarray, high: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of boxes that meet a leaf, or a leaf grown by its reach."""
        reach = np.zeros(self.leaves) if reach is None else reach
        grown = np.zeros(len(self.axis))
        of = lambda child: reach[-1 - child] if child < 0 else grown[child]
        for k in range(len(self.axis) - 1, -1, -1):  # children have higher numbers
            grown[k] = max(of(self.left[k]), of(self.right[k]))
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        open_ = [(0 if len(self.axis) else -1, np.arange(len(low)))]
        while open_:
            k, some = open_.pop()
            if k < 0:
                rows.append(some)
                leaves.append(np.full(len(some), -1 - k))
                continue
            a, at = self.axis[k], self.at[k]
            for child, meets in ((self.left[k], low[some, a] - of(self.left[k]) <= at), (self.right[k], high[some, a] + of(self.right[k]) >= at)):
                if meets.any():
                    open_.append((int(child), some[meets]))
        return np.concatenate(rows), np.concatenate(leaves)


def splits(centres: np.ndarray, leaves: int) -> Splits:
    """About so many leaves of equal numbers of centres, by halves along the longest axis."""
    axis, at, left, right = [], [], [], []
    number = iter(range(leaves + len(centres) + 1))

    def grow(some: np.ndarray, n: int) -> int:
        spread = np.ptp(some, axis=0) if len(some) else np.zeros(3)
        if n < 2 or not spread.max():
            return -1 - next(number)
        a = int(spread.argmax())
        cut = float(np.median(some[:, a]))
        if not (some[:, a] < cut).any():
            cut = float(some[some[:, a] > cut, a].min())
        k = len(axis)
        axis.append(a)
        at.append(cut)
        left.append(0)
        right.append(0)
        lower = some[:, a] < cut
        left[k], right[k] = grow(some[lower], n // 2), grow(some[~lower], n - n // 2)
        return k

    grow(centres, leaves)
    return Splits(np.array(axis, int), np.array(at, float), np.array(left, int), np.array(right, int))


def split_space(boxed: DataFrame, key: str = "cell_idx", per_leaf: int | None = None) -> Splits:
    """Splits from a sample of the centres of boxes (_lx ... _hz): those of the smallest hashes of the key."""
    n = boxed.count()
    leaves = min(MOST_LEAVES, -(-n // (per_leaf or LEAF_CELLS)))
    if leaves < 2:
        return splits(np.zeros((0, 3)), 1)
    share = min(1.0, CENTRES * leaves / n)
    some = boxed.where(F.xxhash64(key) < F.lit(int((share - 0.5) * 2.0**64))) if share < 1 else boxed
    centre = [((F.col(f"_l{a}") + F.col(f"_h{a}")) / 2).alias(a) for a in AXES]
    return splits(some.select(*centre).toPandas().to_numpy(float), leaves)


def _with(batch: pa.RecordBatch, rows: np.ndarray, name: str, values: np.ndarray, drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in drop]
    taken = batch.select(kept).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(values.astype(np.int64))], [*kept, name])


def in_leaves(df: DataFrame, tree: Splits, axes: Sequence[str] = AXES) -> DataFrame:
    """Positions (x, y, z, ...) with the leaf they are in."""
    schema = T.StructType([*df.schema.fields, T.StructField("leaf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in axes])
            yield _with(batch, np.arange(len(p)), "leaf", tree.leaf_of(p))

    return df.mapInArrow(run, schema)


def to_leaves(boxed: DataFrame, tree: Splits, reach: np.ndarray | None = None) -> DataFrame:
    """Boxes (_lx ... _hz, which go) once for each leaf that they meet."""
    ends = tuple(f"_{e}{a}" for e in "lh" for a in AXES)
    schema = T.StructType([*(f for f in boxed.schema.fields if f.name not in ends), T.StructField("leaf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (np.column_stack([batch.column(f"_{e}{a}").to_numpy(zero_copy_only=False) for a in AXES]) for e in "lh")
            rows, leaves = tree.meeting(low - 2 * SLACK, high + 2 * SLACK, reach)
            for k in range(0, len(rows), 4096):
                yield _with(batch, rows[k : k + 4096], "leaf", leaves[k : k + 4096], ends)

    return boxed.mapInArrow(run, schema)


def parts_of(spark: SparkSession, loads: dict[int, int], rows: int) -> DataFrame:
    """leaf and the number of tasks it is dealt to; as many rows as there are leaves with a load."""
    return spark.createDataFrame([(leaf, -(-n // rows)) for leaf, n in loads.items()], "leaf long, parts long")


def copies(held: DataFrame, parts: DataFrame, box: str, tasks: int, *keys: str) -> DataFrame:
    """held once for each part (from 0) of its box; parts: box and parts. Rows are dealt by keys before they are
    copied, as the one task that holds a box would else write the copies for all of its parts."""
    return held.join(parts, box).repartition(tasks, *keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def sent(cells: DataFrame, fields: int) -> Broadcast | None:
    """``solids`` for all tasks, or None if there are too many."""
    corners = cells.agg(F.sum(F.size("corners"))).first()[0] or 0
    if corners * (len(AXES) + fields) > MOST_SENT:
        return None
    return cells.sparkSession.sparkContext.broadcast(cells.select("cell_idx", "cell_type", "corners").toArrow())


def meet(samples: DataFrame, keys: list[str], cells: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str, rows: int = POSITIONS) -> DataFrame:
    """``run`` over the samples (leaf, ...) and the cells (leaf, ...) of each leaf, in parts of about ``rows`` samples.

    Both are written tables. Cells of leaves without samples go nowhere."""
    spark = samples.sparkSession
    loads = {r.leaf: r["count"] for r in samples.groupBy("leaf").count().collect()}
    parts = F.broadcast(parts_of(spark, loads, rows))
    left = samples.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts"))).drop("parts")
    # As many partitions as groups: the groups are long work on few bytes.
    n = max(1, sum(-(-x // rows) for x in loads.values()))
    right = copies(cells, parts, "leaf", min(n, COPIERS), "cell_idx")
    left, right = (x.repartition(n, "leaf", "part") for x in (left, right))
    return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(run, schema)


def located(samples: DataFrame, key: str, cells: DataFrame, fields: int, per_leaf: int | None = None, outside: bool = False) -> DataFrame:
    """key, cell_idx, weights and values of the samples (key, x, y, z) that lie in a cell of ``solids``; with
    ``outside`` all samples with all of their columns, and nulls where there is no cell."""
    scratch = Scratch(samples.sparkSession, "located")
    boxed = scratch.write(bounds_of(cells), "cells")
    at = [F.col(a).cast("double").alias(f"_{a}") for a in AXES]
    found = T.StructType([T.StructField("cell_idx", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def hits(some: pa.Table | pa.RecordBatch, mesh: Mesh, kept: list[str], outside: bool = False) -> tuple[list[pa.Array], list[str]]:
        p = np.column_stack([some.column(f"_{a}").to_numpy(**({"zero_copy_only": False} if isinstance(some, pa.RecordBatch) else {})) for a in AXES])
        cell, value, w, corners = mesh.find(p)[:4]
        hit = np.flatnonzero(cell >= 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(corners[hit]))).astype(np.int32)), pa.array(w[hit][np.arange(8) < corners[hit][:, None]]))
        values = pa.ListArray.from_arrays(pa.array((np.arange(len(hit) + 1) * fields).astype(np.int32)), pa.array(value[hit, :fields].ravel()))
        told = [pa.array(cell[hit]), lists, values]
        if outside:
            place = np.zeros(len(p), np.int64)
            place[hit] = np.arange(len(hit))
            told = [x.take(pa.array(place, mask=cell < 0)) for x in told]
        else:
            some = some.take(pa.array(hit))
        return [*(some.column(c) for c in kept), *told], [*kept, *found.names]

    if per_leaf is None and (whole := sent(boxed, fields)):
        kept = samples.columns if outside else [key]

        def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mesh = Mesh(whole.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(*hits(batch, mesh, kept, outside))

        return dealt(samples.select(*kept, *at), POSITIONS, key).mapInArrow(among, T.StructType([*(samples.schema[c] for c in kept), *found]))

    def run(some: pa.Table, around: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(*hits(some, Mesh(around), [key]))

    tree = split_space(boxed, per_leaf=per_leaf)
    placed = scratch.write(in_leaves(samples.select(key, *at), tree, [f"_{a}" for a in AXES]), "samples")
    some = meet(placed, [key], to_leaves(boxed, tree), run, T.StructType([samples.schema[key], *found]))
    return samples.join(some, key, "left") if outside else some
