"""NumPy archives and arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import parse_slices
from .files import read_arrays

#: Names, letters and digits only, by which a coordinate array is recognised: fixed values.
COORDINATES = ("coords", "coordinates", "points", "positions", "xyz")


def parser(slices: dict[str, str] | None = None, **values: object):
    """Archives and single arrays; ``slices`` cuts named arrays (``"1:5, ::2"``), with
    ``{name}`` in it replaced by keyword values such as a time step."""

    def parse(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
        loaded = np.load(io.BytesIO(content), allow_pickle=False)
        found = {"data": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}
        for key, array in found.items():
            if slices and key in slices:
                array = array[parse_slices(slices[key], **values)]
            yield key, "none", np.atleast_1d(array)

    return parse


def read_npz(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None, slices: dict[str, str] | None = None, **values: object) -> DataFrame:
    return read_arrays(spark, path, parser(slices, **values), arrays)
