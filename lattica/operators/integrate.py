"""Streamlines by adaptive Cash-Karp steps over a velocity on a grid or on a mesh of any solid cells.

Seeds are spread over tasks and each Arrow batch of them is advanced together, both ways at once. A grid of
up to MOST_NODES, and a small mesh, is sent to the tasks. A larger one is cut into blocks with a
margin as wide as a step can look: lines are grouped by block, advanced until they leave
it, and regrouped, round by round; all ways take the same steps. Velocity is normalised
where it is sampled, so steps are lengths; a step's length is told in sizes of the cell that it starts in;
tolerances and limits are the caller's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .grid import ImageGrid
from .mesh_probe import checked
from .scan import dealt
from .spatial import COPIERS, Mesh, bounds_of, copies, in_leaves, sent, solids, split_space, to_leaves

MOST_NODES = 4_000_000
#: Seeds of one task, and points of the lines of a block's part at most, where the block is large, and of lines made at once.
SEEDS, PART_POINTS = 2_500, 500_000
#: Positions whose velocity on a grid is made at once, so that all of it stays in a core's cache.
CACHED = 4_096
#: Cells of a block along an axis, and how many step lengths from a position its stages lie at most:
#: the largest sum of a stage row's absolute values.
BLOCK, LOOK = 64, 6.7
#: Nodes of a block with its margin.
MOST_BLOCK_NODES = 16_000_000
LINES = ["seed_idx", "seq", "x", "y", "z", "t", "cell_idx"]
POINTS = "seed_idx long, forward boolean, step long, x double, y double, z double, t double, cell_idx long"
#: The embedded Cash-Karp pair: stage rows, fifth-order and fourth-order weights; fixed values.
STAGES = [[1 / 5], [3 / 40, 9 / 40], [3 / 10, -9 / 10, 6 / 5], [-11 / 54, 5 / 2, -70 / 27, 35 / 27], [1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096]]
FIFTH = [37 / 378, 0, 250 / 621, 125 / 594, 0, 512 / 1771]
FOURTH = [2825 / 27648, 0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4]


def locate(grid: ImageGrid, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell ijk, position in it, inside) of positions (n, 3); cells are whole doubles."""
    rel, f, ok = np.empty(p.shape, float, "F"), np.empty(p.shape, float, "F"), np.ones(len(p), bool)
    for a, (origin, step, low, high, dim) in enumerate(zip(grid.origin, grid.spacing, grid.low, grid.high, grid.cell_dims, strict=True)):
        at, cell = (p[:, a] - origin) / step, rel[:, a]
        np.subtract(np.floor(at), low, out=cell)
        if (last := cell == dim).any():
            cell[last & (np.abs(at - high) <= 1e-6)] = dim - 1
        at -= low
        np.subtract(at, cell, out=f[:, a])
        ok &= (cell >= 0) & (cell < dim)
    return rel, f, ok


def cell_of(grid: ImageGrid, p: np.ndarray) -> np.ndarray:
    return _number(grid, *locate(grid, p)[::2])


def _number(grid: ImageGrid, rel: np.ndarray, ok: np.ndarray) -> np.ndarray:
    nx, ny, _ = grid.cell_dims
    return np.where(ok, rel[:, 2] * (nx * ny) + rel[:, 1] * nx + rel[:, 0], -1).astype(np.int64)


@dataclass
class Lines:
    """The heads of lines: positions, next step lengths in cell sizes, times and numbers of steps."""

    at: np.ndarray
    dt: np.ndarray
    clock: np.ndarray
    step: np.ndarray

    @classmethod
    def begin(cls, seeds: np.ndarray, forward: bool, initial: float) -> Lines:
        n = len(seeds)
        return cls(seeds.astype(float).copy(), np.full(n, initial if forward else -initial), np.zeros(n), np.zeros(n, int))

    @classmethod
    def begin_all(cls, seeds: np.ndarray, ways: list[bool], initial: float) -> Lines:
        """The lines of one way after those of the other, to be advanced together."""
        each = [cls.begin(seeds, way, initial) for way in ways]
        return cls(*(np.concatenate([getattr(x, n) for x in each]) for n in ("at", "dt", "clock", "step")))


class GridVelocity:
    """Unit velocities of a dense array (nk, nj, ni, 3) on a grid, or on a part of a whole one."""

    def __init__(self, values: np.ndarray, grid: ImageGrid, whole: ImageGrid | None = None):
        self.grid, self.whole = grid, whole or grid
        self.values = np.ascontiguousarray(values.reshape(-1, 3).T)
        nx, ny, _ = grid.point_dims
        self.strides = (1, nx, nx * ny)
        self.corners = np.array([(c & 1) + (c >> 1 & 1) * nx + (c >> 2) * nx * ny for c in range(8)])[:, None]

    def __call__(self, p: np.ndarray, hint: np.ndarray | None = None) -> np.ndarray:
        return self._velocity(p, np.empty(0))

    def _velocity(self, p: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Unit velocities (n, 3), column by column; their cells go into ``cells`` where it has room for them."""
        out = np.empty((3, len(p)))
        for begin in range(0, len(p), CACHED):
            some = slice(begin, begin + CACHED)
            rel, f, ok = locate(self.grid, p[some])
            out[:, some] = self._in(rel, f, ok)
            if len(cells):
                cells[some] = _number(self.grid, rel, ok) if self.whole is self.grid else cell_of(self.whole, p[some])
        return out.T

    def _in(self, rel: np.ndarray, f: np.ndarray, ok: np.ndarray) -> np.ndarray:
        first = np.where(ok, sum(rel[:, a] * n for a, n in enumerate(self.strides)), 0).astype(np.int64)
        x, y, z = ((1 - f[:, a], f[:, a]) for a in range(3))
        w = np.empty((8, len(first)))
        for c, (a, b) in enumerate((a, b) for b in y for a in x):
            np.multiply(a, b, out=w[c])
        np.multiply(w[:4], z[1], out=w[4:])
        w[:4] *= z[0]
        parts = self.values.take(first + self.corners, axis=1)
        parts *= w
        out = parts[:, 0]
        for c in range(1, 8):  # in this order whatever the batch, so a line does not depend on what is with it
            out += parts[:, c]
        return unit_columns(out) * ok

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell or -1, unit velocity, other fields, hint for what is near) of positions."""
        cell = np.empty(len(p), np.int64)
        return cell, self._velocity(p, cell), np.zeros((len(p), 0)), np.zeros((len(p), 0))

    def size_of(self, cells: np.ndarray) -> np.ndarray:
        return np.full(len(cells), float(np.linalg.norm(self.whole.spacing)))


class MeshVelocity:
    """Unit velocities in the cells of a mesh, whose first three fields they are; further fields go along."""

    def __init__(self, mesh: Mesh):
        self.mesh, self.size_of = mesh, mesh.size_of

    def __call__(self, p: np.ndarray, hint: np.ndarray) -> np.ndarray:
        return unit(self.mesh.near(np.ascontiguousarray(p), hint)[:, :3])

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cell, values, _, _, hint = self.mesh.find(np.ascontiguousarray(p))
        return cell, unit(values[:, :3]), values[:, 3:], hint


def unit(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(unit_columns(v.T).T)


def unit_columns(v: np.ndarray) -> np.ndarray:
    """Unit vectors of the columns (3, n); zero stays."""
    n = np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return np.divide(v, n, out=np.zeros(v.shape), where=n > 0)


def _sum(weights: list[float], k: list[np.ndarray]) -> np.ndarray:
    out = weights[0] * k[0]
    for a, b in zip(weights[1:], k[1:], strict=True):
        if a:
            out += a * b
    return out


def _length(v: np.ndarray) -> np.ndarray:
    """Lengths of the columns (3, n)."""
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _once(at: np.ndarray, dt: np.ndarray, k1: np.ndarray, field: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error, next position, mean velocity) of one step; positions and velocities are columns (3, n)."""
    k = [k1]
    for row in STAGES:
        k.append(np.ascontiguousarray(field((at + dt * _sum(row, k)).T).T))
    v5, v4 = (_sum(w, k) for w in (FIFTH, FOURTH))
    after = at + dt * unit_columns(v5)
    return _length(after - at - dt * unit_columns(v4)), after, v5


def _step(at: np.ndarray, dt: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float, field: Callable, k1: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(used, suggested, next position, mean velocity) of one adaptive step of each line; columns as in ``_once``.

    Fixed values: ten tries, factors 0.9 and 1.2, power -1/4. A step whose shrunk length falls
    under the least is kept as it was computed."""
    used, suggested, sign = dt.copy(), dt.copy(), np.sign(dt)
    after, mean, rows = np.zeros_like(at), np.zeros_like(at), np.arange(len(dt))
    for _ in range(10):
        if not len(rows):
            break
        least, most = low[rows], high[rows]
        error, after[:, rows], mean[:, rows] = _once(at.take(rows, axis=1), used[rows], k1.take(rows, axis=1), lambda p, near=hint[rows]: field(p, near))
        size = np.abs(used[rows])
        shrink = (error > tolerance) & (size > least)
        with np.errstate(divide="ignore"):
            shorter = 0.9 * size * (np.maximum(error, 1e-300) / tolerance) ** -0.25 if tolerance > 0 else least.copy()
        ended = shrink & ((shorter < least) | (shorter > most))
        suggested[rows[ended]] = sign[rows[ended]] * np.clip(shorter, least, most)[ended]
        again = shrink & ~ended
        used[rows[again]] = sign[rows[again]] * shorter[again]
        done = ~shrink
        suggested[rows[done]] = sign[rows[done]] * np.clip(np.where(error < tolerance, 1.2 * size, size), least, most)[done]
        rows = rows[again]
    return used, suggested, after, mean


def advance(lines: Lines, field: GridVelocity | MeshVelocity, home: Callable | None = None, *, least: float = 0.01, most: float = 1.0, steps: int = 100, tolerance: float = 1e-5, stop: Callable | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(recorded points as row, step, position, time, cell and other fields, rows that left home unfinished).

    Lines are changed in place. Step lengths are in sizes of the cell they start in. ``stop(before, after, dt,
    velocity)`` may end lines: an array of booleans."""
    out: list[tuple[np.ndarray, ...]] = []
    away: list[np.ndarray] = []
    rows = np.flatnonzero(lines.step < steps)
    cells, k1, more, hint = field.at(lines.at[rows])
    now, k1, goes = np.ascontiguousarray(lines.at[rows].T), np.ascontiguousarray(k1.T), cells >= 0
    while True:
        size = field.size_of(cells[goes])
        goes[goes] = size > 1e-10
        size = size[size > 1e-10]
        kept = np.flatnonzero(goes)
        rows, cells, more, hint = (x[kept] for x in (rows, cells, more, hint))
        now, k1 = (x.take(kept, axis=1) for x in (now, k1))
        if not len(rows):
            break
        out.append((rows, lines.step[rows], now.T, lines.clock[rows], cells, more))
        used, suggested, after, mean = _step(now, lines.dt[rows] * size, least * size, most * size, tolerance, field, k1, hint)
        cells, k1, more, hint = field.at(after.T)
        goes = (np.abs(used) > 1e-7) & (cells >= 0)
        if stop is not None:
            goes &= ~stop(now.T, after.T, used, mean.T)
        speed = _length(mean)
        lines.clock[rows] += np.divide(used, speed, out=np.zeros_like(used), where=speed > 0)
        lines.dt[rows], lines.at[rows] = suggested / size, after.T
        lines.step[rows] += 1
        goes &= lines.step[rows] < steps
        if home is not None:
            left = goes & ~home(after.T)
            away.append(rows[left])
            goes &= ~left
        now, k1 = after, np.ascontiguousarray(k1.T)
    empty = (np.empty(0, int), np.empty(0, int), np.empty((0, 3)), np.empty(0), np.empty(0, int), field.at(np.zeros((0, 3)))[2])
    points = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else empty
    return points, np.concatenate(away) if away else np.empty(0, int)


def _filled(got: pd.DataFrame, grid: ImageGrid) -> np.ndarray:
    nx, ny, nz = grid.point_dims
    out = np.zeros((nz, ny, nx, 3))
    out[got.k - grid.low[2], got.j - grid.low[1], got.i - grid.low[0]] = got[["vx", "vy", "vz"]].to_numpy()
    return out


def _inside(nodes: DataFrame, grid: ImageGrid) -> DataFrame:
    keep = F.lit(True)
    for c, lo, hi in zip("ijk", grid.low, grid.high, strict=True):
        keep &= F.col(c).between(lo, hi)
    return nodes.where(keep).select("i", "j", "k", "vx", "vy", "vz")


def _whole(seeds: DataFrame, ways: list[bool], initial: float, options: dict, more: list[str], made: Callable[[], GridVelocity | MeshVelocity]) -> DataFrame:
    """All lines, numbered, each made whole in one batch by the velocity that a task makes for itself."""
    names = [*LINES, *more]
    schema = "seed_idx long, seq long, x double, y double, z double, t double, cell_idx long" + "".join(f", `{n}` double" for n in more)

    seeds_at_once = max(SEEDS, PART_POINTS // (len(ways) * max(1, options.get("steps", 100))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = made()
        for batch in batches:
            for begin in range(0, batch.num_rows, seeds_at_once):
                some = batch.slice(begin, seeds_at_once)
                at = np.column_stack([some.column(a).to_numpy(zero_copy_only=False).astype(float) for a in "xyz"])
                head, seq, *told = advance(Lines.begin_all(at, ways, initial), field, **options)[0]
                row = head % len(at)
                if len(ways) == 2:  # the backward part, last point first and without the seed, comes before
                    behind = (head >= len(at)) == ways[0]
                    kept = ~behind | (seq > 0)
                    row, seq, behind, told = row[kept], seq[kept], behind[kept], [x[kept] for x in told]
                    back = np.bincount(row[behind], minlength=len(at))
                    seq = back[row] + np.where(behind, -seq, seq)
                kept = np.bincount(row, minlength=len(at))[row] > 1
                row, seq, (where, t, cell, others) = row[kept], seq[kept], [x[kept] for x in told]
                values = [seq, *where.T, t, cell, *others.T]
                yield pa.RecordBatch.from_arrays([some.column("seed_idx").take(pa.array(row)), *(pa.array(np.ascontiguousarray(v)) for v in values)], names)

    return dealt(seeds.select(F.col("seed_idx").cast("long").alias("seed_idx"), "x", "y", "z"), SEEDS, "seed_idx").mapInArrow(run, schema)


def _points(seed: np.ndarray, forward: np.ndarray, row: np.ndarray, step: np.ndarray, at: np.ndarray, t: np.ndarray, cell: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"seed_idx": seed[row], "forward": forward[row], "step": step, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "t": t, "cell_idx": cell})


def _rounds(scratch: Scratch, seeds: DataFrame, ways: list[bool], initial: float, margins: DataFrame, keys: list[str], owner: Callable[[DataFrame], DataFrame], field_of: Callable, options: dict, more: list[str]) -> DataFrame:
    """Recorded points of all lines, block by block, in rounds until no line goes on.

    margins: block and what a block needs, by keys; owner adds the block that heads are in; ``field_of(block, arrow
    table)`` makes a block's velocity and the test of who is at home in it."""
    begin = seeds.select("seed_idx", *[F.col(a).cast("double").alias(a) for a in "xyz"], F.explode(F.array(*[F.lit(w) for w in ways])).alias("forward"))
    heads = begin.select("seed_idx", "forward", "x", "y", "z", F.when(F.col("forward"), initial).otherwise(-initial).alias("dt"), F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("step"))
    heads = scratch.write(owner(heads), "heads-0")
    schema = POINTS + ", dt double" + "".join(f", `{n}` double" for n in more)

    def run(key: tuple, some: pa.Table, around: pa.Table) -> pa.Table:
        some = some.to_pandas()
        names = [*(c.split()[0] for c in POINTS.split(", ")), "dt", *more]
        made = []
        if len(some) and around.num_rows:
            field, home = field_of(key[0].as_py(), around)
            lines = Lines(some[["x", "y", "z"]].to_numpy(float), some.dt.to_numpy(float), some.t.to_numpy(float), some.step.to_numpy(int))
            found, left = advance(lines, field, home, **options)
            seed, forward = some.seed_idx.to_numpy(), some.forward.to_numpy()
            made.append(_points(seed, forward, *found[:5]).assign(dt=np.nan, **{n: found[5][:, k] for k, n in enumerate(more)}))
            made.append(_points(seed, forward, left, lines.step[left], lines.at[left], lines.clock[left], np.full(len(left), -1)).assign(dt=lines.dt[left], **{n: np.nan for n in more}))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.float64(), *[pa.float64()] * len(more)]
        whole = pd.concat(made, ignore_index=True) if made else pd.DataFrame({n: [] for n in names})
        return pa.table([pa.array(whole[n], k, from_pandas=False) for n, k in zip(names, kinds, strict=True)], names=names)

    points = None
    sizes = scratch.write(margins.groupBy("block").agg(F.count("*").alias("held")), "sizes")
    for k in count(1):
        # A block that many lines are in is sent to several tasks.
        # One whose own rows are many gets larger parts, so that copies of them do not outgrow the lines.
        rows = F.greatest(F.lit(SEEDS), F.least(F.floor(F.col("held") / 4), F.lit(PART_POINTS // max(1, options.get("steps", 100)))))
        loads = heads.groupBy("block").count().join(sizes, "block").select("block", F.ceil(F.col("count") / rows).alias("parts"))
        loads = scratch.write(loads, f"loads-{k}")
        n = int(loads.agg(F.sum("parts")).first()[0] or 1)
        shared = heads.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("seed_idx", "forward"), F.col("parts")))
        needed = copies(margins, loads, "block", min(n, COPIERS), *keys)
        moved = shared.drop("parts").groupBy("block", "part").cogroup(needed.groupBy("block", "part")).applyInArrow(run, schema)
        moved = scratch.write(moved, f"round-{k}")
        some = moved.where(F.isnan("dt")).drop("dt")
        points = some if points is None else points.unionByName(some)
        heads = scratch.write(owner(moved.where(~F.isnan("dt")).drop("cell_idx", *more)), f"heads-{k}")
        if heads.isEmpty():
            return points


def _in_blocks(seeds: DataFrame, nodes: DataFrame, grid: ImageGrid, ways: list[bool], initial: float, options: dict, block: int) -> DataFrame:
    """Recorded points of all lines over a grid that is cut into blocks of nodes."""
    scratch = Scratch(seeds.sparkSession, "streamlines")
    look = LOOK * options.get("most", 1.0) * math.sqrt(sum(s * s for s in grid.spacing))
    reach = [math.ceil(look / s) + 1 for s in grid.spacing]
    if math.prod(min(n, block + 2 * r) for n, r in zip(grid.point_dims, reach, strict=True)) > MOST_BLOCK_NODES:
        raise ValueError("a step may look at more nodes than a task can hold: take smaller blocks or a smaller longest step")
    counts = [-(-n // block) for n in grid.cell_dims]
    number = lambda b: (b[2] * counts[1] + b[1]) * counts[0] + b[0]

    # A node goes to its own block and to those whose margin holds it.
    spread = _inside(nodes, grid)
    for c, lo, n, r in zip("ijk", grid.low, counts, reach, strict=True):
        first, last = F.floor((F.col(c) - lo - r - 1) / block), F.floor((F.col(c) - lo + r) / block)
        spread = spread.withColumn(f"_{c}", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(n - 1).cast("long")))))
    margins = scratch.write(spread.select(number([F.col(f"_{c}") for c in "ijk"]).alias("block"), "i", "j", "k", "vx", "vy", "vz").repartition("block"), "blocks")

    def owner(heads: DataFrame) -> DataFrame:
        parts = []
        for a, o, s, lo, n in zip("xyz", grid.origin, grid.spacing, grid.low, counts, strict=True):
            parts.append(F.least(F.greatest(F.floor((F.floor((F.col(a) - o) / s) - lo) / block), F.lit(0).cast("long")), F.lit(n - 1).cast("long")))
        return heads.withColumn("block", number(parts))

    def field_of(b: int, around: pa.Table) -> tuple[GridVelocity, Callable]:
        ijk = [b % counts[0], b // counts[0] % counts[1], b // (counts[0] * counts[1])]
        low = tuple(int(max(lo, lo + k * block - r)) for lo, k, r in zip(grid.low, ijk, reach, strict=True))
        high = tuple(int(min(hi, lo + (k + 1) * block + r)) for lo, hi, k, r in zip(grid.low, grid.high, ijk, reach, strict=True))
        part = ImageGrid(grid.origin, grid.spacing, low, high)
        first = np.array([lo + k * block for lo, k in zip(grid.low, ijk, strict=True)])

        def home(p: np.ndarray) -> np.ndarray:
            rel = np.floor((p - np.array(grid.origin)) / np.array(grid.spacing)) - first
            return ((rel >= 0) & (rel < block)).all(axis=1)

        return GridVelocity(_filled(around.to_pandas(), part), part, grid), home

    return _rounds(scratch, seeds, ways, initial, margins, ["i", "j", "k"], owner, field_of, options, [])


def _joined(found: DataFrame, direction: str, more: list[str]) -> DataFrame:
    """Recorded points of a written table as numbered lines; those of a single point go."""
    if direction == "both":
        found = found.where("forward or step > 0")
    lengths = found.groupBy("seed_idx").agg(F.count("*").alias("_n"), F.count(F.when(~F.col("forward"), 1)).alias("_back"))
    lines = found.join(lengths.where("_n > 1"), "seed_idx")
    seq = F.col("step")
    if direction == "both":  # backward points, last first and without the seed, come before
        seq = F.when(F.col("forward"), F.col("_back") + F.col("step")).otherwise(F.col("_back") - F.col("step"))
    return lines.select("seed_idx", seq.alias("seq"), "x", "y", "z", "t", "cell_idx", *more)


def _ways(direction: str) -> list[bool]:
    if direction not in ("forward", "backward", "both"):
        raise ValueError("direction must be forward, backward or both")
    return {"forward": [True], "backward": [False], "both": [True, False]}[direction]


def mesh_streamlines(seeds: DataFrame, cells: DataFrame, points: DataFrame, velocity: list[str], direction: str = "both", initial: float = 0.2, faces: DataFrame | None = None, fields: tuple[str, ...] = (), per_leaf: int | None = None, **options: object) -> DataFrame:
    """seed_idx, seq, x, y, z, t, cell_idx and the fields along the lines through seeds (seed_idx, x, y, z).

    cells, points and faces as in ``mesh_probe.probe_mesh``; velocity names three fields of the points. A small mesh
    is sent to the tasks; a larger one is cut into boxes of space, each with the cells that a step from inside it can look at; a cell's size is its
    bounds' diagonal. On a face the smallest cell is told. Lines may leave through a hole and none walks
    along faces, so cells need not fit together."""
    checked(cells, faces)
    fields = tuple(fields)
    ways, scratch = _ways(direction), Scratch(seeds.sparkSession, "streamlines")
    boxed = scratch.write(bounds_of(solids(cells, points, [*velocity, *fields], faces)), "cells")
    if per_leaf is None and (whole := sent(boxed, len(velocity) + len(fields))):
        return _whole(seeds, ways, initial, options, list(fields), lambda: MeshVelocity(Mesh(whole.value)))
    tree = split_space(boxed, per_leaf=per_leaf)
    size = F.sqrt(sum((F.col(f"_h{a}") - F.col(f"_l{a}")) ** 2 for a in "xyz"))
    sizes = to_leaves(boxed.select(size.alias("size"), *[f"_{e}{a}" for e in "lh" for a in "xyz"]), tree).groupBy("leaf").agg(F.max("size").alias("size"))
    reach = np.zeros(tree.leaves)
    for r in sizes.collect():  # a row for each box of space
        reach[r.leaf] = LOOK * options.get("most", 1.0) * r.size
    margins = scratch.write(to_leaves(boxed, tree, reach).withColumnRenamed("leaf", "block").repartition("block"), "margins")

    def field_of(leaf: int, around: pa.Table) -> tuple[MeshVelocity, Callable]:
        return MeshVelocity(Mesh(around)), lambda p: tree.leaf_of(p) == leaf

    owner = lambda heads: in_leaves(heads, tree).withColumnRenamed("leaf", "block")
    return _joined(_rounds(scratch, seeds, ways, initial, margins, ["cell_idx"], owner, field_of, options, list(fields)), direction, list(fields))


def streamlines(seeds: DataFrame, nodes: DataFrame, grid: ImageGrid, direction: str = "both", initial: float = 0.2, block: int | None = None, **options: object) -> DataFrame:
    """seed_idx, seq, x, y, z, t, cell_idx of the lines through seeds (seed_idx, x, y, z).

    Both directions: the backward part reversed without the seed, then the forward
    part. Lines of fewer than two points are dropped. Without ``block``, a grid beyond
    MOST_NODES is cut into blocks of BLOCK cells along an axis."""
    ways = _ways(direction)
    if block or math.prod(grid.point_dims) > MOST_NODES:
        return _joined(_in_blocks(seeds, nodes, grid, ways, initial, options, block or BLOCK), direction, [])
    values = seeds.sparkSession.sparkContext.broadcast(_filled(_inside(nodes, grid).toPandas(), grid))
    return _whole(seeds, ways, initial, options, [], lambda: GridVelocity(values.value, grid))
