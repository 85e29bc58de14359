"""Line dedup: which lines of each document stay, as compressed bitmaps.

A line's key is the line with ASCII white space stripped at both ends and A-Z in
lower case, held as two 64-bit hashes. Keys are counted first for each doc_id, then over
the documents, pre-aggregated in every task both times, so a line that a third of all documents hold
meets in no task. Only lines that repeat are then range-partitioned by
hash with a secondary sort by document (largest first) and position, and streamed:
the first occurrence names the document that keeps its lines. The few hashes that
hold a thousandth of all occurrences or more get their document from the counts.

Only DataFrame functions run here. Defined results: a null or empty text is one
empty line; a row is told from rows with the same doc_id by a hash of its text, so
repeated rows get the same answer; rows of one doc_id count as one document, and so do those
of none; a null doc_id comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, lookup, text_or_empty

MIN_CHARS, MIN_DOCS = 40, 5
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does it where there is no other letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(lines: Column, min_chars: int) -> Column:
    """Two hashes for each line long enough, null for the others."""

    def key(line):
        k = lower_ascii(F.btrim(line, F.lit(SPACES)))
        return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b")))

    return F.transform(lines, key)


def runs(dropped: Column, n: Column) -> Column:
    """A bitmap of n bits as run lengths: kept, dropped, kept, ... from sorted dropped positions."""
    # First and last positions of the dropped runs; each is found from its neighbours alone.
    first = F.filter(dropped, lambda p, i: F.coalesce(p - F.get(dropped, i - 1) > 1, F.lit(True)))
    last = F.filter(dropped, lambda p, i: F.coalesce(F.get(dropped, i + 1) - p > 1, F.lit(True)))
    ends = F.arrays_zip(first.alias("first"), last.alias("last"))
    pairs = F.zip_with(ends, F.concat(F.array(F.lit(-1)), F.slice(last, 1, F.size(last) - 1)), lambda x, before: F.array(x["first"] - before - 1, x["last"] - x["first"] + 1))
    return F.concat(F.flatten(pairs), F.array(n - 1 - F.element_at(last, -1)))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each row that loses lines: doc_id, text_hash, n_dropped, keep_runs.

    keep_runs are run lengths over the row's lines: kept, dropped, kept and so on.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    body = text_or_empty()
    lines = docs.select("doc_id", F.xxhash64(body).alias("text_hash"), line_keys(F.split(body, "\n"), min_chars).alias("keys"))
    lines = scratch.write(lines.where(F.exists("keys", lambda k: k.isNotNull())), "keys")

    once = lines.select("doc_id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k")).select("doc_id", "k.a", "k.b")
    by_doc = once.groupBy("a", "b", "doc_id").agg(F.count("*").alias("rows"))
    counts = by_doc.groupBy("a", "b").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.max("doc_id").alias("last_doc")).where(F.col("docs") >= min_docs)
    counts = scratch.write(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    found = lines.select("doc_id", "text_hash", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).where("k is not null")
    found = found.select("doc_id", "text_hash", "n", "pos", "k.a", "k.b")
    # Heavy hashes have their answer; the others only learn that they repeat.
    seen = counts.withColumn("heavy_doc", F.when(F.col("rows") * 1000 >= total, F.struct("last_doc"))).select("a", "b", "rows", "heavy_doc")
    again = lookup(found, seen, ["a", "b"], "rows", total, ["doc_id", "pos"]).where("rows is not null")
    again = scratch.write(again, "again")
    heavy = again.where("heavy_doc is not null").withColumn("keeper", F.col("heavy_doc.last_doc"))
    light = again.where("heavy_doc is null").repartitionByRange("a", "b").sortWithinPartitions("a", "b", F.desc_nulls_last("doc_id"), "pos")
    stream = W.partitionBy("a", "b").orderBy(F.desc_nulls_last("doc_id"), "pos")
    light = light.withColumn("keeper", F.first("doc_id").over(stream))
    lost = heavy.unionByName(light).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    by_row = lost.groupBy("doc_id", "text_hash", "n").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return by_row.select("doc_id", "text_hash", F.size("dropped").cast("long").alias("n_dropped"), runs(F.col("dropped"), F.col("n")).alias("keep_runs"))


def apply_bitmap(text: Column, keep_runs: Column) -> Column:
    """The lines of a text that a bitmap keeps, joined."""
    stays = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    pairs = F.arrays_zip(F.split(text, "\n").alias("line"), stays.alias("stays"))
    return F.array_join(F.transform(F.filter(pairs, lambda x: x["stays"]), lambda x: x["line"]), "\n")


def kept_lines(docs: DataFrame) -> DataFrame:
    """Every row with n_lines, n_dropped and the text that stays, as ``kept``."""
    bitmaps = keep_bitmaps(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_dropped", "keep_runs")
    body = docs.select("doc_id", text_or_empty().alias("text"))
    joined = body.join(bitmaps, body["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(body["text"]) == F.col("_hash")), "left")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(apply_bitmap(F.col("text"), F.col("keep_runs"))).alias("kept"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, c.last_doc IS NOT NULL AND c.last_doc <> doc_id AS lost FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
