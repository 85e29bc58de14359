"""VTK's old file format (.vtk), as text or binary: points, cells and data arrays.

The arrays have the names that the XML reader gives, so ``datasets`` takes both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .files import read_arrays

#: Published type names; binary files are big-endian.
TYPES = {"unsigned_char": "u1", "char": "i1", "unsigned_short": "u2", "short": "i2", "unsigned_int": "u4", "int": "i4", "unsigned_long": "u8", "long": "i8", "float": "f4", "double": "f8", "vtkIdType": "i8", "vtktypeint64": "i8", "vtktypeint32": "i4"}
#: Components of the attributes that are told by their keyword alone.
WIDTHS = {"VECTORS": 3, "NORMALS": 3, "TENSORS": 9}
LISTS = {"VERTICES": "verts", "LINES": "lines", "POLYGONS": "polys", "TRIANGLE_STRIPS": "strips"}


class Cursor:
    """Words and numbers of a file, from a place onwards."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0
        self.line(), self.line()
        self.binary = self.line().upper() == "BINARY"

    def line(self) -> str:
        """The next line that is not empty; empty at the end."""
        while self.at < len(self.content):
            end = self.content.find(b"\n", self.at)
            end = len(self.content) if end < 0 else end
            text, self.at = self.content[self.at : end].decode("latin-1").strip(), end + 1
            if text:
                return text
        return ""

    def numbers(self, n: int, kind: str) -> np.ndarray:
        code = np.dtype(TYPES[kind])
        if self.binary:
            out = np.frombuffer(self.content, code.newbyteorder(">"), n, self.at)
            self.at += n * code.itemsize
            return out.astype(code)
        words: list[str] = []
        while len(words) < n:
            text = self.line()
            if not text:
                raise ValueError(f"{n - len(words)} numbers are missing")
            words += text.split()
        return np.array(words, code)


def _cells(cursor: Cursor, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """(connectivity, ends of cells), from lists that begin with their length, or from offsets."""
    place = cursor.at
    words = cursor.line().split()
    if words[:1] == ["OFFSETS"]:
        ends = cursor.numbers(first, words[1])
        return cursor.numbers(second, cursor.line().split()[1]), ends[1:]
    cursor.at = place
    flat, heads, at = cursor.numbers(second, "int"), [], 0
    for _ in range(first):
        heads.append(at)
        at += int(flat[at]) + 1
    return np.delete(flat, heads), np.cumsum(flat[heads])


def parse(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
    cursor, association, n = Cursor(content), "none", 0
    while words := cursor.line().split():
        key = words[0].upper()
        if key == "POINTS":
            yield "points", "points", cursor.numbers(3 * int(words[1]), words[2]).reshape(-1, 3)
        elif key == "DIMENSIONS":
            yield "extent", "none", np.array([x for d in words[1:4] for x in (0, int(d) - 1)], float)
        elif key in ("ORIGIN", "SPACING", "ASPECT_RATIO"):
            yield "origin" if key == "ORIGIN" else "spacing", "none", np.array(words[1:4], float)
        elif key == "CELLS" or key in LISTS:
            connectivity, ends = _cells(cursor, int(words[1]), int(words[2]))
            prefix = f"{LISTS[key]}_" if key in LISTS else ""
            yield f"{prefix}connectivity", "topology", connectivity
            yield f"{prefix}offsets", "topology", ends
        elif key == "CELL_TYPES":
            yield "types", "topology", cursor.numbers(int(words[1]), "int")
        elif key in ("POINT_DATA", "CELL_DATA"):
            association, n = ("vertex" if key == "POINT_DATA" else "cell"), int(words[1])
        elif key == "SCALARS":
            width = int(words[3]) if len(words) > 3 else 1
            place = cursor.at
            if not cursor.line().upper().startswith("LOOKUP_TABLE"):
                cursor.at = place
            values = cursor.numbers(n * width, words[2])
            yield words[1], association, values.reshape(-1, width) if width > 1 else values
        elif key in WIDTHS:
            yield words[1], association, cursor.numbers(n * WIDTHS[key], words[2]).reshape(-1, WIDTHS[key])
        elif key == "FIELD":
            for _ in range(int(words[2])):
                label, width, rows, kind = cursor.line().split()[:4]
                values = cursor.numbers(int(width) * int(rows), kind)
                yield label, association, values.reshape(-1, int(width)) if int(width) > 1 else values
        elif key in ("METADATA", "INFORMATION", "DATASET"):
            continue
        elif key == "LOOKUP_TABLE":
            cursor.numbers(4 * int(words[2]), "unsigned_char" if cursor.binary else "float")
        else:
            raise ValueError(f"{key} is not read")


def read_legacy(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None) -> DataFrame:
    return read_arrays(spark, path, parse, arrays)
