"""XML files of VTK: unstructured and structured grids, images and polygon data.

Arrays may be text, base64 or appended (raw or base64), plain or in zlib blocks.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .files import read_arrays

TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
SECTIONS = {"PointData": "vertex", "CellData": "cell", "Points": "points", "Cells": "topology", "Coordinates": "points", "Verts": "verts", "Lines": "lines", "Polys": "polys", "Strips": "strips"}


class Layout:
    """Byte order, header type and compression of a file, and its appended data."""

    def __init__(self, content: bytes):
        # Appended raw data isn't XML: it stands between "_" and the closing tag.
        start = re.search(rb"<AppendedData[^>]*>\s*_", content)
        self.appended, self.encoded = b"", False
        if start:
            end = content.rfind(b"</AppendedData>")
            self.appended = content[start.end() : end]
            self.encoded = b'encoding="base64"' in start[0]
            content = content[: start.end() - 1] + content[end:]
        self.root = ET.fromstring(content)
        order = "<" if self.root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        self.order, self.head = order, np.dtype(order + TYPES[self.root.get("header_type", "UInt32")])
        self.compressor = self.root.get("compressor")
        if self.compressor not in (None, "vtkZLibDataCompressor"):
            raise ValueError(f"compressor {self.compressor} is not supported")

    def _payload(self, raw: bytes) -> bytes:
        """Bytes after a header, decompressed."""
        n = self.head.itemsize
        if not self.compressor:
            size = int(np.frombuffer(raw, self.head, 1)[0])
            return raw[n : n + size]
        blocks = int(np.frombuffer(raw, self.head, 1)[0])
        sizes, at, out = np.frombuffer(raw, self.head, blocks, 3 * n), (3 + blocks) * n, []
        for s in sizes.tolist():
            out.append(zlib.decompress(raw[at : at + s]))
            at += s
        return b"".join(out)

    def _base64(self, text: bytes) -> bytes:
        """Header and data are encoded together, or, when compressed, one after the other."""
        text = re.sub(rb"\s+", b"", text)
        if not self.compressor:
            n = self.head.itemsize
            size = int(np.frombuffer(base64.b64decode(text[: -(-n // 3) * 4])[:n], self.head)[0])
            return self._payload(base64.b64decode(text[: -(-(n + size) // 3) * 4]))
        n = self.head.itemsize
        blocks = int(np.frombuffer(base64.b64decode(text[: -(-n // 3) * 4])[:n], self.head)[0])
        head = -(-(3 + blocks) * n // 3) * 4
        header = base64.b64decode(text[:head])
        sizes = int(np.frombuffer(header, self.head, blocks, 3 * n).sum())
        return self._payload(header + base64.b64decode(text[head : head + -(-sizes // 3) * 4]))

    def values(self, node: ET.Element) -> np.ndarray:
        kind, width = np.dtype(self.order + TYPES[node.get("type")]), int(node.get("NumberOfComponents") or 1)
        how = node.get("format", "ascii")
        if how == "ascii":
            flat = np.array((node.text or "").split(), kind.newbyteorder("="))
        elif how == "binary":
            flat = np.frombuffer(self._base64((node.text or "").encode()), kind)
        else:
            part = self.appended[int(node.get("offset")) :]
            flat = np.frombuffer(self._base64(part) if self.encoded else self._payload(part), kind)
        return flat.reshape(-1, width) if width > 1 else flat


def parse(content: bytes, name: str, wanted: list[str] | None = None) -> Iterator[tuple[str, str, np.ndarray]]:
    """Every data array, or the wanted ones, of which alone the data is decoded; points are
    called ``points``, an image's numbers origin, spacing and extent."""
    layout = Layout(content)
    grid = layout.root[0]
    for key in ("WholeExtent", "Origin", "Spacing"):
        if grid.get(key):
            yield {"WholeExtent": "extent"}.get(key, key.lower()), "none", np.array(grid.get(key).split(), float)
    for piece in grid.iter("Piece"):
        for section in piece:
            association = SECTIONS.get(section.tag)
            for node in section.iter("DataArray") if association else ():
                label = "points" if association == "points" else node.get("Name")
                label = f"{association}_{label}" if association in ("verts", "lines", "polys", "strips") else label
                if wanted is None or label in wanted:
                    yield label, association, layout.values(node)


def read_vtk(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None) -> DataFrame:
    return read_arrays(spark, path, partial(parse, wanted=arrays), arrays)


def cell_points(arrays: DataFrame, offsets: str = "offsets", connectivity: str = "connectivity") -> DataFrame:
    """(file, cell_idx, local_idx, point_idx) from ends of cells and flat connectivity.

    The ends of the cells before and of each cell become a range that is exploded and
    joined with the flat positions: no row has to see all of a file."""
    from pyspark.sql import functions as F

    end = F.col("value")[0].cast("long")
    ends = arrays.where(F.col("array") == offsets).select("file", F.col("idx").alias("cell_idx"), end.alias("end"), (F.col("idx") + 1).alias("next"))
    start = ends.select("file", F.col("next").alias("cell_idx"), F.col("end").alias("start"))
    spans = ends.join(start, ["file", "cell_idx"], "left").select("file", "cell_idx", F.coalesce("start", F.lit(0)).alias("start"), "end")
    flat = spans.where("end > start").select("file", "cell_idx", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    points = arrays.where(F.col("array") == connectivity).select("file", "idx", F.col("value")[0].cast("long").alias("point_idx"))
    return flat.join(points, ["file", "idx"]).select("file", "cell_idx", (F.col("idx") - F.col("start")).alias("local_idx"), "point_idx")
