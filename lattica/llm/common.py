"""What the text operators share: word hashing and skew-safe lookups."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_scope

__all__ = ["Scratch", "scratch_scope"]

#: White space of every contract: the six ASCII characters.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_mark(text: Column) -> Column:
    """A hash of a row's text, which tells rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows of ``gone`` (doc_id, row_mark), a written
    table. Columns are taken from their tables, so docs may have any other names."""
    key = docs["doc_id"].cast("long")
    return docs.join(gone, key.eqNullSafe(gone["doc_id"]) & (row_mark(docs["text"]) == gone["row_mark"]), "left_anti")


def lookup(left: DataFrame, stats: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], slots: int = 1000, merge: bool = False) -> DataFrame:
    """left outer join of rows with a table unique on ``keys``, safe for hot keys.

    A key that holds at least ``total / slots`` of the rows is heavy; there are at
    most ``slots`` of those, so they are broadcast. All other keys are shuffled,
    and rows already answered are dealt evenly by the hash of ``spread``. With ``merge``,
    light keys are shuffled at every size: for a table that grows with wide rows on the left.
    """
    values = [c for c in stats.columns if c not in keys]
    is_heavy = F.col(weight) * F.lit(slots) >= F.lit(total)
    heavy = stats.where(is_heavy).select(*keys, F.struct(*values).alias("_heavy"))
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # Never true, and no literal, so that it stays a join key.
    light = stats.where(~is_heavy).select(*renamed, F.xxhash64(*keys).alias("_to"), (F.col(weight) < 0).alias("_never"), F.struct(*values).alias("_light"))
    deal = left.join(F.broadcast(heavy), keys, "left").withColumn("_done", F.col("_heavy").isNotNull())
    deal = deal.withColumn("_deal", F.when(F.col("_done"), F.xxhash64(*spread)).otherwise(F.xxhash64(*keys)))
    on = [deal[k] == light[f"_k{i}"] for i, k in enumerate(keys)] + [deal["_deal"] == light["_to"], deal["_done"] == light["_never"]]
    joined = deal.join(light.hint("merge") if merge else light, on, "left")
    return joined.select(*[deal[c] for c in left.columns], *[F.coalesce(F.col(f"_heavy.{v}"), F.col(f"_light.{v}")).alias(v) for v in values])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; hashing a word costs less than finding it in a table."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n words, from the words' hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    p, out = np.uint64(seed | 1), hashes[:m].copy()
    for j in range(1, n):
        out *= p
        out += hashes[j : j + m]
    return mix(out)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
