"""Tables on shared storage that cut lineage: they survive a lost executor and are read by every executor."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open scopes of scratch tables, innermost last.
_scopes: list[list[Scratch]] = []


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Frees the scratch tables made inside, once the result that rests on them is written."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for scratch in made:
            scratch.drop()


class Scratch:
    """Tables in the folder the cluster names in spark.checkpoint.dir.

    Where the setting is missing, a local session (tests) gets a temporary folder, and on a
    cluster it is an error, as no other folder is known to be shared. The session is left as it is.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _local_folder()
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        for made in _scopes:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Frees a table, or all of them, that no later plan reads."""
        jvm, target = self.spark._jvm, self.path(name) if name else self.root
        path = jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
