"""Column expressions for scalars, vectors (arrays) and colours; no actions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def component(v: Column, i: int) -> Column:
    """The i-th component, from 0."""
    return F.element_at(v, i + 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def assemble(*parts: Column) -> Column:
    """A vector of scalar columns."""
    return F.array(*[p.cast("double") for p in parts])


def vector_field(kinds: dict[str, str], names: list[str], size: int) -> Column:
    """A vector of ``size`` components from one array column or from as many scalar columns
    (``kinds``: the table's column types)."""
    vectors_ = [n for n in names if kinds[n].startswith("array")]
    if len(names) == 1 and vectors_:
        return cast_vector(F.col(names[0]), "double")
    if len(names) != size or vectors_:
        raise ValueError(f"{size} components are one array or {size} scalars, not {names}")
    return assemble(*[F.col(n) for n in names])


def checksum(v: Column) -> Column:
    """CRC-32 of a value's text: a checksum of each row; sums of it do not depend on the rows' order."""
    return F.crc32(F.to_json(F.struct(v.alias("v"))).cast("binary"))


def scalarize(v: Column, size: int) -> Column:
    """One component as it is, several as their magnitude."""
    return component(v, 0) if size == 1 else magnitude(v)


def cast_vector(v: Column, kind: str) -> Column:
    return F.transform(v, lambda x: x.cast(kind))


def broadcast_scalar(s: Column, size: int) -> Column:
    """A scalar as each component of a vector."""
    return F.array_repeat(s, size)


def add_scalar(v: Column, s: float) -> Column:
    return F.transform(v, lambda x: x + F.lit(s))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cross(a: Column, b: Column) -> Column:
    c = component
    return F.array(c(a, 1) * c(b, 2) - c(a, 2) * c(b, 1), c(a, 2) * c(b, 0) - c(a, 0) * c(b, 2), c(a, 0) * c(b, 1) - c(a, 1) * c(b, 0))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = magnitude(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def truncate(v: Column) -> Column:
    """Towards zero, as a C cast does."""
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))


def remap(v: Column, domain: tuple[float, float], to: tuple[float, float]) -> Column:
    """Clamped to the domain, then affine to the range. An inverted domain changes
    nothing; a domain of one value maps everything to the range's start."""
    (a, b), (p, q) = domain, to
    if a > b:
        return v
    if a == b:
        return F.lit(float(p))
    return (F.least(F.greatest(v, F.lit(float(a))), F.lit(float(b))) - a) / (b - a) * (q - p) + p


def colormap(v: Column, domain: tuple[float, float], points: list[tuple[float, tuple[float, float, float, float]]]) -> Column:
    """RGBA of the first segment of control points (position in 0..1, colour) that holds a value."""
    points = sorted(points)
    t = remap(v, domain, (0.0, 1.0))
    out = F.lit(None).cast("array<double>")
    for (x0, c0), (x1, c1) in reversed(list(zip(points, points[1:], strict=False))):
        w = (t - x0) / (x1 - x0)
        out = F.when((t >= x0) & (t <= x1), F.array(*[F.lit(a) + (F.lit(b) - F.lit(a)) * w for a, b in zip(c0, c1, strict=True)])).otherwise(out)
    return out


def colour_table(points: list[tuple[float, tuple[float, ...]]], n: int) -> list[tuple[float, ...]]:
    """n samples of a colour map, for a lookup texture; on the driver, n is small."""
    points = sorted((min(max(x, 0.0), 1.0), c) for x, c in points)
    out = []
    for k in range(n):
        t = k / (n - 1) if n > 1 else 0.0
        hit = next(((p, q) for p, q in zip(points, points[1:], strict=False) if p[0] <= t <= q[0] and p[0] < q[0]), None)
        if hit is None:
            out.append(points[0][1] if t < points[0][0] else points[-1][1])
        else:
            (x0, a), (x1, b) = hit
            out.append(tuple(p + (q - p) * (t - x0) / (x1 - x0) for p, q in zip(a, b, strict=True)))
    return out


def direction_quaternion(x: Column, y: Column, z: Column) -> Column:
    """(qx, qy, qz, qw) that turns +X into a direction, by the half vector; opposite
    and zero directions give what the half vector leaves."""
    n = F.sqrt(x * x + y * y + z * z)
    unit = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    hx, hy, hz = unit(x) + 1.0, unit(y), unit(z)
    h = F.sqrt(hx * hx + hy * hy + hz * hz)
    part = lambda c: F.when(h > 0, c / h).otherwise(F.lit(0.0))
    return F.array(F.lit(0.0), -part(hz), part(hy), part(hx))


#: Support radius in smoothing lengths and normalisation in three dimensions: fixed values of the kernels.
SPH = {"cubic": (2.0, 1 / math.pi), "quartic": (2.5, 1 / (20 * math.pi)), "quintic": (3.0, 1 / (120 * math.pi)), "wendland": (2.0, 21 / (16 * math.pi))}


def sph_weight(kind: str, q: Column) -> Column:
    """Kernel shape at q = distance / smoothing length."""
    reach = lambda a, p: F.pow(F.greatest(F.lit(a) - q, F.lit(0.0)), F.lit(float(p)))
    if kind == "cubic":
        return 0.25 * reach(2.0, 3) - reach(1.0, 3)
    if kind == "quartic":
        return reach(2.5, 4) - 5 * reach(1.5, 4) + 10 * reach(0.5, 4)
    if kind == "quintic":
        return reach(3.0, 5) - 6 * reach(2.0, 5) + 15 * reach(1.0, 5)
    if kind == "wendland":
        return F.pow(F.greatest(1 - 0.5 * q, F.lit(0.0)), F.lit(4.0)) * (1 + 2 * q)
    raise ValueError(f"unknown kernel {kind}; one of {sorted(SPH)}")
