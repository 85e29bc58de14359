"""Parts of files: arrays of NumPy and VTK XML files read by byte range, as a Spark data source.

The planner reads headers only: where each array's values stand, of what type, and for compressed
arrays the table of blocks. Runs of rows, or of blocks, are partitions, so a file of any size is read by as
many tasks as its rows make, and arrays and rows that nobody asks for are not read. Files are opened by
pyarrow's file systems. What stands in a file as text or base64, or in one deflated stream, has no
byte ranges; those are read as a whole, text by ``files.read_arrays``.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from ..functions.names import parse_slices
from .files import CHUNK, ROWS
from .vtk_xml import SECTIONS, TYPES

#: Bytes of values of one partition, about.
PART = 32 << 20
#: Compressors of VTK's blocks; fixed names.
CODECS = {None: "", "vtkZLibDataCompressor": "zlib", "vtkLZ4DataCompressor": "lz4_raw"}
Box = tuple[int, int, int]


class NoRanges(ValueError):
    """A file whose arrays don't stand at known bytes."""


@dataclass(frozen=True)
class Array:
    """Where an array's rows stand: one run of bytes, or compressed blocks (byte offsets of their begins and the end)."""

    name: str
    association: str
    kind: str
    shape: tuple[int, ...]
    offset: int
    codec: str = ""
    blocks: tuple[int, ...] = ()
    block_bytes: int = 0
    last_bytes: int = 0

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * int(np.prod(self.shape[1:], dtype=int))


@dataclass
class Unit(D.InputPartition):
    """Rows [first, last) of an array, every ``step``-th, which become rows from ``idx`` on; ``inner`` cuts further axes."""

    path: str
    array: Array
    first: int
    last: int
    step: int
    idx: int
    inner: tuple[Box, ...]


def opened(path: str) -> BinaryIO:
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


# Planning


def plan_npy(f: BinaryIO, name: str, at: int = 0) -> Array:
    f.seek(at)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise ValueError(f"{name} holds objects")
    if fortran and len(shape) > 1:
        raise NoRanges(f"{name} is in columns")
    return Array(name, "none", kind.str, shape or (1,), f.tell())


def plan_npz(f: BinaryIO) -> Iterator[Array]:
    with zipfile.ZipFile(f) as held:
        for entry in held.infolist():
            if entry.compress_type != zipfile.ZIP_STORED:
                raise NoRanges(f"{entry.filename} is one deflated stream")
            f.seek(entry.header_offset + 26)
            skip = int.from_bytes(f.read(2), "little") + int.from_bytes(f.read(2), "little")
            yield plan_npy(f, entry.filename.removesuffix(".npy"), entry.header_offset + 30 + skip)


def plan_vtk(f: BinaryIO) -> Iterator[Array]:
    """Arrays in the raw appended part of a VTK XML file; only the header and the tables of blocks are read."""
    head, start = b"", None
    while start is None:
        more = f.read(1 << 16)
        head += more
        start = re.search(rb"<AppendedData[^>]*>\s*_", head)
        if not more and start is None:
            raise NoRanges("no appended data")
    if b'encoding="base64"' in start[0]:
        raise NoRanges("appended data in base64")
    root = ET.fromstring(head[: start.end() - 1] + b"</AppendedData></VTKFile>")
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    number = np.dtype(order + TYPES[root.get("header_type", "UInt32")])
    if root.get("compressor") not in CODECS:
        raise NoRanges(f"compressor {root.get('compressor')}")
    codec = CODECS[root.get("compressor")]
    pieces = list(root[0].iter("Piece"))
    if len(pieces) > 1:
        raise NoRanges("several pieces share their names")

    def numbers(at: int, n: int) -> list[int]:
        f.seek(at)
        return np.frombuffer(f.read(n * number.itemsize), number).tolist()

    for section in pieces[0] if pieces else ():
        association = SECTIONS.get(section.tag)
        for node in section.iter("DataArray") if association else ():
            if node.get("format") != "appended":
                raise NoRanges("arrays inside the header")
            label = "points" if association == "points" else node.get("Name")
            label = f"{association}_{label}" if association in ("verts", "lines", "polys", "strips") else label
            kind, width = np.dtype(order + TYPES[node.get("type")]), int(node.get("NumberOfComponents") or 1)
            row, at = kind.itemsize * width, start.end() + int(node.get("offset"))
            if not codec:
                yield Array(label, association, kind.str, (numbers(at, 1)[0] // row, width), at + number.itemsize)
                continue
            n, size, last = numbers(at, 3)
            sizes = numbers(at + 3 * number.itemsize, n)
            total = (n - 1) * size + (last or size) if n else 0
            begins = np.concatenate(([0], np.cumsum(sizes))).astype(int) + at + (3 + n) * number.itemsize
            yield Array(label, association, kind.str, (total // row, width), at, codec, tuple(begins.tolist()), size, last or size)


def plan(path: str) -> list[Array]:
    with opened(path) as f:
        if path.endswith(".npy"):
            return [plan_npy(f, "data")]
        return list(plan_npz(f) if path.endswith(".npz") else plan_vtk(f))


def units(path: str, array: Array, cut: tuple[slice, ...] = (), part: int = PART) -> Iterator[Unit]:
    """The partitions of an array's rows, or of a slice of them."""
    boxes = [s.indices(n) for s, n in zip((*cut, *[slice(None)] * (len(array.shape) - len(cut))), array.shape, strict=True)]
    (first, last, step), inner = boxes[0], tuple(boxes[1:])
    if step < 0:
        raise ValueError("rows are read forwards")
    rows = max(1, part // max(1, array.row_bytes) // step) * step
    for idx, at in enumerate(range(first, last, rows)):
        yield Unit(path, array, at, min(last, at + rows), step, idx * (rows // step), inner)


# Reading


def values(f: BinaryIO, unit: Unit) -> np.ndarray:
    """The rows of a partition: only their bytes, or the blocks that hold them, are read."""
    a = unit.array
    begin, end = unit.first * a.row_bytes, unit.last * a.row_bytes
    if not a.codec:
        f.seek(a.offset + begin)
        raw = f.read(end - begin)
    else:
        one, n = begin // a.block_bytes, len(a.blocks) - 1
        stop = min(n, -(-end // a.block_bytes))
        f.seek(a.blocks[one])
        packed, parts = f.read(a.blocks[stop] - a.blocks[one]), []
        for k in range(one, stop):
            some = packed[a.blocks[k] - a.blocks[one] : a.blocks[k + 1] - a.blocks[one]]
            size = a.last_bytes if k == n - 1 else a.block_bytes
            parts.append(zlib.decompress(some) if a.codec == "zlib" else pa.Codec(a.codec).decompress(some, size, asbytes=True))
        raw = b"".join(parts)[begin - one * a.block_bytes : end - one * a.block_bytes]
    table = np.frombuffer(raw, a.kind).reshape(-1, *a.shape[1:])[:: unit.step]
    table = table[(slice(None), *(slice(*b) for b in unit.inner))]
    return table.reshape(len(table), -1).astype(float)


class ArrayReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.wanted = json.loads(options["arrays"]) if "arrays" in options else None
        self.cuts = json.loads(options.get("slices", "{}"))
        self.part = int(options.get("part", PART))

    def partitions(self) -> list[Unit]:
        out = []
        for path in self.paths:
            for array in plan(path):
                if self.wanted is None or array.name in self.wanted:
                    out += units(path, array, parse_slices(self.cuts[array.name]) if array.name in self.cuts else (), self.part)
        return out

    def read(self, unit: Unit | None) -> Iterator[pa.RecordBatch]:
        if unit is None:  # nothing was planned
            return
        with opened(unit.path) as f:
            table = values(f, unit)
        for at in range(0, len(table), CHUNK):
            some = table[at : at + CHUNK]
            n, width = some.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(some.ravel()))
            idx = pa.array(np.arange(unit.idx + at, unit.idx + at + n))
            yield pa.RecordBatch.from_arrays([pa.array([unit.path] * n), pa.array([unit.array.name] * n), pa.array([unit.array.association] * n), idx, lists], ROWS.names)


class FilteredReader(ArrayReader):
    """For sessions that hand filters to Python sources (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        """Only arrays that a filter names are planned; Spark applies the filter again."""
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In)) and f.attribute == ("array",):
                names = [f.value] if isinstance(f, D.EqualTo) else list(f.value)
                self.wanted = names if self.wanted is None else [n for n in self.wanted if n in names]
            yield f


class ArraySource(D.DataSource):
    """spark.read.format("lattica_arrays") with options paths, arrays, slices (JSON) and part (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "lattica_arrays"

    def schema(self):
        return ROWS

    def reader(self, schema) -> ArrayReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ArrayReader)(self.options)


def read_ranges(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None, slices: dict[str, str] | None = None, part: int = PART, **values: object) -> DataFrame:
    """The arrays of files (file, array, association, idx, value), read by ranges of about ``part`` bytes.

    ``slices`` cuts arrays by name (``"1:5, ::2"``); the first axis is cut before anything is read. A file without
    byte ranges is a ``NoRanges`` error, told before the read begins."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        plan(p)
    spark.dataSource.register(ArraySource)
    source = spark.read.format("lattica_arrays").option("paths", json.dumps(paths)).option("part", str(part)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if arrays is not None:
        source = source.option("arrays", json.dumps(arrays))
    if slices:
        source = source.option("slices", json.dumps({k: v.format(**values) for k, v in slices.items()}))
    return source.load()
