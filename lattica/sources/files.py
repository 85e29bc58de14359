"""Files as rows: every reader gets whole files through Spark, so any store that Spark
reads will do, and files are parsed where they are read. One file is one row; the
numbers in it come out as rows of (file, array, idx, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.StructType([T.StructField("file", T.StringType()), T.StructField("array", T.StringType()), T.StructField("association", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])
#: Rows of one output batch.
CHUNK = 50_000

#: A parser yields (array name, association, values of shape (n,) or (n, components)).
Parser = Callable[[bytes, str], Iterator[tuple[str, str, np.ndarray]]]


def read_arrays(spark: SparkSession, path: str | list[str], parse: Parser, arrays: list[str] | None = None) -> DataFrame:
    """The arrays of all files at a path; only those named, if any are."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for array, association, values in parse(content.as_py(), name):
                    if arrays is not None and array not in arrays:
                        continue
                    table = np.asarray(values, float).reshape(len(values), -1)
                    for at in range(0, len(table), CHUNK):
                        some = table[at : at + CHUNK]
                        n, width = some.shape
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(some.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([array] * n), pa.array([association] * n), pa.array(np.arange(at, at + n)), lists], ROWS.names)

    return files.mapInArrow(run, ROWS)


def concatenated(arrays: DataFrame, name: str) -> DataFrame:
    """One array over several files, files in the order of their names: (file, idx, value)
    with idx counted on from file to file."""
    one = arrays.where(F.col("array") == name).select("file", "idx", "value")
    sizes = one.groupBy("file").agg((F.max("idx") + 1).alias("n"))
    # One row for each file, in order.
    base = sizes.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return one.join(base, "file").select("file", (F.col("base") + F.col("idx")).alias("idx"), "value")


def vectors(arrays: DataFrame, name: str, names: list[str], key: str) -> DataFrame:
    """An array's components as columns, its index as ``key``."""
    one = arrays.where(F.col("array") == name)
    return one.select("file", F.col("idx").alias(key), *[F.col("value")[i].alias(n) for i, n in enumerate(names)])
