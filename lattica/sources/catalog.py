"""Readers by file name, and readers that a user adds."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ensight, files, npz, openfoam, surfaces, vtk_legacy, vtk_xml

Reader = Callable[..., DataFrame]
#: (priority, pattern, reader); the highest priority that matches reads the file.
_readers: list[tuple[int, re.Pattern, Reader]] = []


def add_reader(pattern: str, reader: Reader, priority: int = 0) -> None:
    _readers.append((priority, re.compile(pattern, re.I), reader))
    _readers.sort(key=lambda r: -r[0])


def reader_for(path: str) -> Reader:
    for _, pattern, reader in _readers:
        if pattern.search(path):
            return reader
    raise ValueError(f"no reader for {path}")


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return reader_for(path)(spark, path, **options)


def read_with(parse: files.Parser) -> Reader:
    """A reader from a parser of whole files: what a user writes for a new format."""
    return lambda spark, path, arrays=None: files.read_arrays(spark, path, parse, arrays)


add_reader(r"\.np[yz]$", npz.read_npz)
add_reader(r"\.(vtu|vti|vts|vtp)$", vtk_xml.read_vtk)
add_reader(r"\.vtk$", vtk_legacy.read_legacy)
add_reader(r"\.geo$", ensight.read_geometry)
add_reader(r"\.(case|encas)$", ensight.read_case)
add_reader(r"\.(obj|stl|ply)$", surfaces.read_surface)
add_reader(r"(^|/)(points|faces|owner|neighbour)$|/polyMesh/", openfoam.read_openfoam)
