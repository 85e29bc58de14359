"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes are summed for each slot, and a
versioned table says which shard owns a slot. Version 0 deals the slots round
robin. A rebalancing edits that map: each shard keeps its largest slots up to the
mean load, and only the slots beyond it move, largest first, to the shard with the
least bytes. The map and the loads have as many rows as there are slots, a fixed
number, whatever the input. Versions are kept at a path of the caller's, where a later
run finds the newest and edits it.

Only DataFrame functions run here. Defined results: a null text has no bytes (size
1, CRC 0); a slot is hashed from doc_id and text, so rows with a null or repeated doc_id
spread over the slots; rows that repeat both share a slot and are numbered by their
count, not one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, text_or_empty

SHARDS, SLOTS = 16, 4096
#: Rows of a bucket, the part of a slot that is numbered in one window.
BUCKET_ROWS = 50_000
#: Numbers of one repeated row that are made at once.
DEAL = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row."""
    body = text_or_empty()
    return docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round robin."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: only slots beyond a shard's mean load move.

    ``shards`` may be larger than before; new shards start empty and slots flow to
    them. The greedy step folds over at most as many entries as there are slots.
    """
    now = slot_map.join(loads, "virtual_slot", "left").fillna(0, ["bytes", "rows"])
    mean = now.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    filled = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    now = now.crossJoin(F.broadcast(mean)).withColumn("moves", (filled > F.col("mean")) & (F.col("bytes") > 0))
    stays = F.array_sort(F.collect_list(F.when(~F.col("moves"), F.struct("shard", "bytes"))))
    free = F.sort_array(F.collect_list(F.when(F.col("moves"), F.struct("bytes", "virtual_slot"))), asc=False)
    base = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("stays", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    moved_type = "array<struct<virtual_slot:int,shard:int>>"

    def place(state, slot):
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        load = F.transform(state["load"], lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.array_append(state["moved"], F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))).alias("moved"))

    folded = now.agg(stays.alias("stays"), free.alias("free"), (F.max("version") + 1).alias("next"))
    folded = folded.select("next", F.aggregate("free", F.struct(base.alias("load"), F.array().cast(moved_type).alias("moved")), place, lambda s: s["moved"]).alias("moved"))
    moved = folded.select(F.inline("moved")).withColumnRenamed("shard", "to_shard")
    return now.join(F.broadcast(moved), "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to_shard", "shard").alias("shard"))


def place(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Rows with their shard and their gapless position in it.

    A slot is cut into buckets of about BUCKET_ROWS rows. Equal rows are counted, which
    each task does before the shuffle; counts are summed in the order of a bucket, and
    buckets get offsets by a prefix sum over their totals, slot by slot.
    """
    owned = slot_map.join(loads, "virtual_slot", "left").fillna(0, ["bytes", "rows"])
    offset = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    owned = owned.select("virtual_slot", "shard", "version", F.coalesce(offset, F.lit(0)).alias("base"), F.ceil(F.greatest("rows", F.lit(1)) / F.lit(BUCKET_ROWS)).alias("buckets"))
    known = ["doc_id", "size", "text_crc32"]
    cut = rows.join(F.broadcast(owned.select("virtual_slot", "buckets")), "virtual_slot")
    bucket = F.pmod(F.xxhash64(F.lit(1), *known), F.col("buckets"))
    counted = cut.groupBy("virtual_slot", bucket.alias("bucket"), *known).agg(F.count("*").alias("times"))
    within = F.sum("times").over(W.partitionBy("virtual_slot", "bucket").orderBy(*known)) - F.col("times")
    totals = counted.groupBy("virtual_slot", "bucket").agg(F.sum("times").alias("n"))
    before = F.sum("n").over(W.partitionBy("virtual_slot").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select("virtual_slot", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = counted.withColumn("within", within).join(totals, ["virtual_slot", "bucket"]).join(F.broadcast(owned.drop("buckets")), "virtual_slot")
    first = F.col("base") + F.col("before") + F.col("within")
    dealt = numbered.withColumn("first", first).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(DEAL).cast("long"))))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + DEAL - 1, F.col("times") - 1))))
    return dealt.select(*known, "virtual_slot", "shard", "version", (F.col("first") + F.col("k")).alias("slot"))


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a map kept at a path; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    kept = spark.read.parquet(path)
    version = kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with shard and slot, all versions of the slot map).

    The map at ``map_path`` is edited, or made if there is none; without a path it is a
    scratch table of this call."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(records(docs, slots), "records")
    loads = scratch.write(slot_loads(rows), "loads")
    path = map_path or scratch.path("slot_map")
    last = newest(docs.sparkSession, path)
    start = first_map(docs.sparkSession, shards, slots) if last is None else scratch.write(last, "last")
    edited = scratch.write(rebalance(start, loads, shards).coalesce(1), "edited")
    (edited if last is not None else start.unionByName(edited)).coalesce(1).write.mode("append").parquet(path)
    return place(rows, edited, loads), docs.sparkSession.read.parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
