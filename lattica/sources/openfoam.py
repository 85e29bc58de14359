"""Files of polyMesh cases: points, faces, owner, neighbour and fields, text or binary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .files import read_arrays

#: Components of field classes.
WIDTHS = {"vectorField": 3, "volVectorField": 3, "pointVectorField": 3, "volScalarField": 1, "pointScalarField": 1, "volSymmTensorField": 6, "volTensorField": 9}


def _header(content: bytes) -> dict[str, str]:
    """The entries of the FoamFile block."""
    block = re.search(rb"FoamFile\s*\{(.*?)\}", content, re.S)
    return {k.decode(): v.decode().strip().strip('"') for k, v in re.findall(rb"(\w+)\s+([^;]+);", block[1])} if block else {}


def _list(content: bytes, at: int) -> tuple[int, int]:
    """(count, first position inside) of the list that begins at or after a position."""
    m = re.compile(rb"(\d+)\s*\(").search(content, at)
    if not m:
        raise ValueError("no list found")
    return int(m[1]), m.end()


def _numbers(content: bytes, at: int, n: int, width: int, binary: bool, kind: str) -> tuple[np.ndarray, int]:
    """n entries of a list of scalars, labels or vectors, and where they end."""
    if binary:
        step = np.dtype(kind).itemsize * n * width
        return np.frombuffer(content, kind, n * width, at).reshape(n, width), at + step
    end = content.index(b")", at) if width == 1 else content.index(b")", content.rindex(b"(", at, _close(content, at))) + 1
    flat = np.array(content[at:end].translate(None, b"()").split() if width == 1 else re.sub(rb"[()]", b" ", content[at:end]).split(), float)
    return flat[: n * width].reshape(n, width), end


def _close(content: bytes, at: int) -> int:
    """Where a list of bracketed entries closes: a bracket that follows another one's close."""
    m = re.compile(rb"\)\s*\)").search(content, at)
    return m.end() - 1 if m else len(content)


def parse(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
    head = _header(content)
    binary, arch = head.get("format") == "binary", head.get("arch", "")
    label = "<i8" if "label=64" in arch else "<i4"
    scalar = "<f4" if "scalar=32" in arch else "<f8"
    kind = head.get("class", "")
    body = content.find(b"}", content.find(b"FoamFile")) + 1
    if kind == "vectorField":
        n, at = _list(content, body)
        yield "points", "vertex", _numbers(content, at, n, 3, binary, scalar)[0]
    elif kind == "labelList":
        n, at = _list(content, body)
        yield head.get("object", "labels"), "face", _numbers(content, at, n, 1, binary, label)[0][:, 0]
    elif kind == "faceCompactList":
        n, at = _list(content, body)
        offsets, end = _numbers(content, at, n, 1, binary, label)
        m, at = _list(content, end)
        yield "offsets", "face", offsets[:, 0]
        yield "faces", "topology", _numbers(content, at, m, 1, binary, label)[0][:, 0]
    elif kind == "faceList":
        n, at = _list(content, body)
        lists = [x.split() for x in re.findall(rb"\d+\s*\(([\d\s]*)\)", content[at:])[:n]]
        yield "offsets", "face", np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        yield "faces", "topology", np.array([int(x) for one in lists for x in one])
    elif kind in WIDTHS:
        m = re.compile(rb"internalField\s+nonuniform\s+List<\w+>").search(content, body)
        if m:
            n, at = _list(content, m.end())
            yield head.get("object", "field"), "vertex" if kind.startswith("point") else "cell", _numbers(content, at, n, WIDTHS[kind], binary, scalar)[0]


def read_openfoam(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None) -> DataFrame:
    return read_arrays(spark, path, parse, arrays)
