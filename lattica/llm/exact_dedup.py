"""Exact dedup through a log-structured merge index of text digests.

Digests arrive in batches. The memtable of a batch (its distinct digests with the
smallest identifier and the count) is flushed as a sorted run with a Bloom filter
for each shard; full levels are compacted into one run that keeps the smallest
identifiers. A digest that an older run's filter may hold, or that repeats in its
own memtable, is a hit, and the texts of hits are compared byte by byte.

Hot groups cost little: a memtable is pre-aggregated in each task, and rows meet
their group through ``common.lookup``. Only texts that a bit filter of the hit digests,
of a fixed size, may hold are shuffled for the comparison.

Defined results: a null text counts as empty. Rows with a null doc_id come last in
a group. Rows that repeat doc_id and text are all reported, one of them kept. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, Scratch, documents, lookup, row_mark, text_or_empty, without

BATCHES = 3
SHARD_ROWS = 250_000
#: Bloom filter: bits for each digest and probes; about one false hit in 100.
BITS, PROBES = 10, 6
#: Bits of the filter in front of the byte comparison, and of a row of it: at most 32,768 rows of 64 words of 64 bits.
HIT_BITS, WORD, ROW = 1 << 27, 6, 12

FILTER = T.StructType([T.StructField("shard", T.LongType()), T.StructField("bits", T.BinaryType())])


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _slots(digests: pa.Array, bits: int) -> np.ndarray:
    """Bit numbers (rows x PROBES) of digests, by double hashing of their first 16 bytes."""
    width = 16
    raw = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in digests.to_pylist()), "<u8").reshape(-1, 2)
    step = raw[:, 1:] | np.uint64(1)
    return (raw[:, :1] + step * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def _filters(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One filter for each shard of a stretch of a sorted run: batches of a shard share it."""

    def build(batches):
        at, field = None, np.zeros(bits, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(field).tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            shards, slots = batch.column("shard").to_numpy(), _slots(batch.column("digest"), bits)
            for shard in np.unique(shards).tolist():
                if shard != at:
                    if at is not None:
                        yield done()
                    at = shard
                    field[:] = 0
                field[slots[shards == shard].ravel()] = 1
        if at is not None:
            yield done()

    return build


def _probe(bits: int):
    """The digests of a shard that one of the filters may hold."""

    def probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not rows.num_rows or not filters.num_rows:
            return rows.slice(0, 0).select(["digest"])
        slots = _slots(rows.column("digest").combine_chunks(), bits)
        hit = np.zeros(rows.num_rows, bool)
        for raw in filters.column("bits").to_pylist():
            field = np.unpackbits(np.frombuffer(raw, np.uint8))
            hit |= field[slots].all(axis=1)
        return rows.filter(pa.array(hit)).select(["digest"])

    return probe


class DigestIndex:
    """Runs of (digest, keep, n) on shared storage; keep = (no_id, doc_id, row) of the smallest row."""

    def __init__(self, scratch: Scratch, expected_rows: int, fanout: int = 2):
        self.scratch, self.fanout = scratch, fanout
        self.shards = max(8, math.ceil(expected_rows / SHARD_ROWS))
        self.bits = 8 * math.ceil(BITS * max(1000, expected_rows / self.shards) / 8)
        self.runs: list[tuple[int, DataFrame, DataFrame]] = []
        self._made = 0

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    def _flush(self, entries: DataFrame, level: int) -> None:
        self._made += 1
        run = entries.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)))
        run = self.scratch.write(run.repartition("shard").sortWithinPartitions("shard", "digest"), f"run-{self._made}")
        filters = self.scratch.write(run.select("shard", "digest").mapInArrow(_filters(self.bits), FILTER), f"filter-{self._made}")
        self.runs.append((level, run, filters))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Those of distinct digests that the filters may hold: no digest of a run is missed."""
        if not self.runs:
            return digests.select("digest").limit(0)
        filters = self.runs[0][2]
        for _, _, more in self.runs[1:]:
            filters = filters.unionByName(more)
        rows = digests.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard"), "digest")
        return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_probe(self.bits), T.StructType([T.StructField("digest", T.BinaryType())]))

    def insert(self, memtable: DataFrame) -> None:
        self._flush(memtable, 0)
        level = 0
        while sum(at == level for at, _, _ in self.runs) >= self.fanout:
            full = [run for at, run, _ in self.runs if at == level]
            self.runs = [x for x in self.runs if x[0] != level]
            self._flush(self.merged(self._all(full)), level + 1)
            level += 1

    @staticmethod
    def _all(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.select("digest", "keep", "n")

    def resolve(self, hits: DataFrame) -> DataFrame:
        """Over all runs: the smallest identifier and the count of the digests that were hit."""
        rows = self._all([run for _, run, _ in self.runs])
        return self.merged(rows.join(hits, "digest", "left_semi"))


def _spot(digest: str) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(HIT_BITS - 1))


def may_hit(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose digest a filter of ``digests`` may hold: all that are among them and few others,
    while there are fewer than ``HIT_BITS`` digests. The filter's size is bounded, so it is broadcast."""
    spot = digests.select(_spot("digest").alias("spot"))
    words = spot.groupBy(F.shiftright("spot", WORD).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits"))
    filters = words.groupBy(F.shiftright("word", ROW - WORD).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    placed = rows.withColumn("_spot", _spot("digest")).withColumn("_row", F.shiftright("_spot", ROW))
    held = F.getbit(F.try_element_at("_words", F.shiftright("_spot", WORD)), F.col("_spot").bitwiseAND(F.lit(63)).cast("int")) == 1
    return placed.join(F.broadcast(filters), "_row").where(held).select(*rows.columns)


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: doc_id, row_mark, digest, keep_id, group_size, kept.

    ``digest`` may be weak; texts that only share a digest are told apart by their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = normalised(text_or_empty())
    rows = docs.select("doc_id", row_mark(F.col("text")).alias("row_mark"), digest(norm).alias("digest"), F.monotonically_increasing_id().alias("row"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    rows = scratch.write(rows, "digests")
    total = rows.count()

    index = DigestIndex(scratch, total)
    hits = None
    for k in range(batches):
        entry = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
        memtable = DigestIndex.merged(rows.where(F.col("batch") == k).select("digest", entry.alias("keep"), F.lit(1).cast("long").alias("n")))
        memtable = scratch.write(memtable, f"memtable-{k}")
        found = memtable.where("n > 1").select("digest").unionByName(index.lookup(memtable))
        hits = found if hits is None else hits.unionByName(found)
        hits = scratch.write(hits, f"hits-{k}")
        index.insert(memtable)
    groups = scratch.write(index.resolve(hits.distinct()).where("n > 1"), "groups")

    # Byte verification: the texts of all rows whose digest was hit.
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    same = lookup(may_hit(texts, groups), groups.select("digest", F.col("n").alias("hits")), ["digest"], "hits", total, ["row"], merge=True).where("hits is not null")
    variants = scratch.write(same.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")), "variants")
    collided = scratch.write(variants.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "collided")

    found = groups.join(collided.select("digest"), "digest", "left_anti").select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n")
    out = lookup(rows.select("doc_id", "row_mark", "digest", "row"), found, ["digest"], "n", total, ["row"])
    out = out.select("doc_id", "row_mark", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"))
    if collided.isEmpty():
        return out
    # Digests with more than one text: their rows are grouped by the text itself. Rows that
    # repeat doc_id and text are counted and dealt again, the first of them to stay.
    clash = docs.select("doc_id", row_mark(F.col("text")).alias("row_mark"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    clash = clash.join(collided.select("digest"), "digest", "left_semi").groupBy("digest", "norm", "doc_id", "row_mark").agg(F.count("*").alias("times"))
    first = clash.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_mark")).alias("first"), F.sum("times").alias("group_size"))
    told = clash.join(first, ["digest", "norm"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_mark") == F.col("first.row_mark"))
    told = told.select("doc_id", "row_mark", "digest", F.col("first.doc_id").alias("keep_id"), "group_size", is_first.alias("one"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k"))
    told = told.select("doc_id", "row_mark", "digest", "keep_id", "group_size", (F.col("one") & (F.col("k") == 1)).alias("kept"))
    return out.join(collided.select("digest"), "digest", "left_anti").select(told.columns).unionByName(told)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text no row with a smaller doc_id has.

    The rows that go, which are few, are looked up by doc_id and a hash of the text. Of
    rows that repeat both, one stays."""
    scratch = Scratch(docs.sparkSession, "gone")
    found = exact_duplicates(docs).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "row_mark").agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
    found = scratch.write(found.where(~F.col("stays") | (F.col("times") > 1)), "gone")
    out = without(docs, found.select("doc_id", "row_mark"))
    again = found.where("stays").select("doc_id", "row_mark")
    if again.isEmpty():
        return out
    mark = [docs["doc_id"].cast("long").eqNullSafe(again["doc_id"]), row_mark(docs["text"]) == again["row_mark"]]
    return out.unionByName(docs.join(again, mark, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
