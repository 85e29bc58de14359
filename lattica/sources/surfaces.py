"""Surface meshes: OBJ, STL and PLY (text or binary)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .files import read_arrays


def _obj(content: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    """Points with their colours, if they have any, normals with their place in each face's corners, and faces."""
    points, normals, faces, corners = [], [], [], []
    for line in content.decode("utf-8", "replace").splitlines():
        words = line.split()
        if words[:1] == ["v"]:
            points.append([float(x) for x in words[1:]])
        elif words[:1] == ["vn"]:
            normals.append([float(x) for x in words[1:4]])
        elif words[:1] == ["f"]:
            parts = [w.split("/") for w in words[1:]]
            place = lambda k, n: k - 1 if k > 0 else n + k
            faces.append([place(int(p[0]), len(points)) for p in parts])
            corners += [place(int(p[2]), len(normals)) if len(p) > 2 and p[2] else -1 for p in parts]
    yield "points", "vertex", np.array([p[:3] for p in points], float).reshape(-1, 3)
    if points and all(len(p) >= 6 for p in points):
        yield "colors", "vertex", np.array([p[3:6] for p in points], float)
    if normals:
        yield "normals", "none", np.array(normals, float)
        yield "face_normals", "topology", np.array(corners)
    yield "counts", "face", np.array([len(f) for f in faces])
    yield "faces", "topology", np.array([k for f in faces for k in f])


def _stl(content: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    n = int(np.frombuffer(content, "<u4", 1, 80)[0]) if len(content) >= 84 else 0
    if len(content) == 84 + 50 * n:
        rows = np.frombuffer(content, np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")]), n, 84)
        normals, corners = rows["normal"], rows["corners"].reshape(-1, 3)
    else:
        lines = [x.split() for x in content.decode("ascii", "replace").splitlines()]
        normals = np.array([[float(v) for v in w[2:5]] for w in lines if w[:2] == ["facet", "normal"]])
        corners = np.array([[float(v) for v in w[1:4]] for w in lines if w[:1] == ["vertex"]])
    points, faces = np.unique(corners, axis=0, return_inverse=True)  # equal corners are one point
    yield "points", "vertex", points
    yield "normals", "face", normals
    yield "faces", "topology", faces.reshape(-1, 3)


#: Number types and byte orders of PLY files: fixed values.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLY_ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}


@dataclass
class Element:
    """An element of a PLY file: rows of properties, each (name, type, type of the length of a list or none)."""

    name: str
    rows: int
    properties: list[tuple[str, str, str]] = field(default_factory=list)


def _ply_header(content: bytes) -> tuple[str, list[Element], int]:
    """Byte order ("" for text), elements, and where the rows begin."""
    head, mark, _ = content.partition(b"end_header")
    if not content.startswith(b"ply") or not mark:
        raise ValueError("not a PLY file")
    order, elements = None, []
    for words in (line.split() for line in head.decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            order = PLY_ORDERS[words[1]]
        elif words[:1] == ["element"]:
            elements.append(Element(words[1], int(words[2])))
        elif words[:2] == ["property", "list"]:
            elements[-1].properties.append((words[4], PLY_TYPES[words[3]], PLY_TYPES[words[2]]))
        elif words[:1] == ["property"]:
            elements[-1].properties.append((words[2], PLY_TYPES[words[1]], ""))
    if order is None:
        raise ValueError("the PLY file has no format line")
    return order, elements, content.index(b"\n", len(head)) + 1


def _ply_runs(content: bytes, at: int, element: Element, order: str) -> Iterator[np.ndarray]:
    """Records of a binary element, in runs of rows whose lists are of the same lengths; ``name#`` is a length."""
    left, look = element.rows, 1024
    while left:
        kinds: list[tuple] = []
        for name, kind, length in element.properties:
            if length:
                n = int(np.frombuffer(content, order + length, 1, at + np.dtype(kinds).itemsize)[0])
                kinds += [(f"{name}#", order + length), (name, order + kind, (n,))]
            else:
                kinds.append((name, order + kind))
        record = np.dtype(kinds)
        some = min(left, look, (len(content) - at) // record.itemsize) if record.itemsize else left
        if not some:
            raise ValueError(f"the PLY file ends within {element.name}")
        rows = np.frombuffer(content, record, some, at)
        same = np.ones(some, bool)
        for name, _, length in element.properties:
            if length:
                same &= rows[f"{name}#"] == rows[f"{name}#"][0]
        run = some if same.all() else int(same.argmin())
        look = max(16, 4 * run)  # short runs look ahead little, so the work stays linear
        yield rows[:run]
        left, at = left - run, at + run * record.itemsize


def _ply_columns(content: bytes, at: int, element: Element, order: str) -> tuple[dict[str, np.ndarray], int]:
    """The values of each property, lists one after the other with their lengths as ``name#``, and the end."""
    parts: dict[str, list[np.ndarray]] = {c: [] for name, _, length in element.properties for c in ([f"{name}#", name] if length else [name])}
    if order:
        for rows in _ply_runs(content, at, element, order):
            at += rows.nbytes
            for name, found in parts.items():
                found.append(rows[name].reshape(-1))
    else:
        lines = content[at:].split(b"\n")
        filled = [k for k, line in enumerate(lines) if line.strip()][: element.rows]
        if len(filled) < element.rows:
            raise ValueError(f"the PLY file ends within {element.name}")
        values: dict[str, list[float]] = {c: [] for c in parts}
        for k in filled:
            words = iter(lines[k].split())
            for name, kind, length in element.properties:
                number = float if kind[0] == "f" else int
                if length:
                    values[f"{name}#"].append(n := int(next(words)))
                    values[name] += [number(next(words)) for _ in range(n)]
                else:
                    values[name].append(number(next(words)))
        at += sum(len(line) + 1 for line in lines[: filled[-1] + 1]) if filled else 0
        parts = {c: [np.array(v)] for c, v in values.items()}
    return {c: np.concatenate(found) if found else np.empty(0) for c, found in parts.items()}, at


def _ply(content: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    """Points, normals, colours and faces under the names of the other formats; every other property of a
    vertex or face under its own name, lists with their lengths as ``name_counts``."""
    order, elements, at = _ply_header(content)
    for element in elements:
        columns, at = _ply_columns(content, at, element, order)
        place = element.name if element.name in ("vertex", "face") else "none"
        if element.name == "vertex":
            for name, parts in (("points", ["x", "y", "z"]), ("normals", ["nx", "ny", "nz"]), ("colors", ["red", "green", "blue"])):
                if all(p in columns for p in parts):
                    yield name, place, np.stack([columns.pop(p) for p in parts], axis=1).astype(float)
        lists = {name for name, _, length in element.properties if length}
        for name in lists & {"vertex_indices", "vertex_index"} if element.name == "face" else ():
            yield "counts", "face", columns.pop(f"{name}#").astype(np.int64)
            yield "faces", "topology", columns.pop(name).astype(np.int64)
        for name, values in columns.items():
            own = name.removesuffix("#")
            label = own if element.name in ("vertex", "face") else f"{element.name}_{own}"
            if name.endswith("#"):
                yield f"{label}_counts", place, values.astype(np.int64)
            else:
                yield label, "none" if own in lists else place, values


def parse(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
    suffix = name.lower().rpartition(".")[2]
    return {"stl": _stl, "ply": _ply}.get(suffix, _obj)(content)


def read_surface(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None) -> DataFrame:
    return read_arrays(spark, path, parse, arrays)
