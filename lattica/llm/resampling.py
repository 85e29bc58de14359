"""Importance resampling towards a target distribution.

Texts are bags of hashed features, runs of words up to a given length. The buckets of
all documents and of all target texts are counted, a bucket's gain is the logarithm of its
smoothed odds, and a document's weight the mean gain of its features. Gumbel noise from
a hash of doc_id makes the highest scores a draw without replacement.

CRCs are taken of distinct features only: of a piece of text, those of equal length are
one matrix of bytes, whose CRCs are updated together, column by column; the buckets are
then scattered back to where the features occur. Texts are read twice, once to count and
once to weigh; between them pass as many numbers as there are buckets, a fixed number.

Scores are integers of a narrow range (noise lies between -3,132 and 22,872, gains are
logarithms), so rows are ranked by counts of each score, from which every score gets its first
rank, and by doc_id within a score. Rows that are equal in all columns are numbered by their count.

Defined results: a null or empty text has no features and weight 0; a null doc_id is
hashed as an empty text and comes last among ties; repeated rows are rows of their own and
get ranks of their own; without target texts or documents the counts are zero; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents
from .spans import Piece, byte_set, pieces, text_buffer, words

BUCKETS, SHARE, MIN_FEATURES, SEED, LONGEST_RUN = 10_000, 10, 20, 2024, 1
#: Bytes outside the contract's set of separators.
WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: A longer feature is alone in its matrix, so it gets its CRC by itself.
LONG = 256
#: Equal rows that are numbered at once.
DEAL = 4096


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, from the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of bytes."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(features: pa.Array) -> np.ndarray:
    """CRC-32 of each of some distinct features (large_binary), those of equal length together."""
    offsets = np.frombuffer(features.buffers()[1], np.int64)[features.offset : features.offset + len(features) + 1]
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    lengths, out = np.diff(offsets), np.zeros(len(features), np.uint32)
    if not len(out):
        return out
    order = np.argsort(lengths, kind="stable")
    sizes, begin = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, begin[1:]), strict=True):
        if size > LONG:
            out[rows] = [zlib.crc32(data[a : a + size]) for a in offsets[rows].tolist()]
        else:
            out[rows] = crc_columns(data[offsets[rows][:, None] + np.arange(size)])
    return out


def feature_buckets(piece: Piece, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs: (number of features before each text's begin and the end, buckets of the features)."""
    before, index, distinct = words(Piece(LOWER[piece.data], piece.first, piece.offsets), WORD)
    yield before, (crcs(distinct) % np.uint32(buckets)).astype(np.int64)[index]
    for n in range(2, longest + 1):
        joined = distinct.to_pylist()
        begins = np.concatenate([np.arange(a, max(a, b - n + 1)) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)])
        runs = pa.array([b" ".join(joined[x] for x in index[k : k + n].tolist()) for k in begins.tolist()], pa.large_binary()).dictionary_encode()
        counts = np.maximum(np.diff(before) - n + 1, 0)
        yield np.concatenate(([0], np.cumsum(counts))), (crcs(runs.dictionary) % np.uint32(buckets)).astype(np.int64)[runs.indices.to_numpy(zero_copy_only=False)]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """bucket and n, the occurrences of its features in all texts: one row a task and bucket is shuffled.

    With runs of several words, a text beyond a piece has no run across a cut; words have no such edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(*text_buffer(batch.column(0)), WORD):
                for _, found in feature_buckets(piece, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_all: dict[int, int], of_target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log odds of each bucket, rounded down."""
    s_all, t_all = float(sum(of_all.values()) + buckets), float(sum(of_target.values()) + buckets)
    odds = (float(of_target.get(b, 0) + 1) * s_all / (float(of_all.get(b, 0) + 1) * t_all) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in odds], np.int64)


def _weighed(gain: np.ndarray, buckets: int, longest: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for piece in pieces(*text_buffer(batch.column("text")), WORD):
                rows = slice(piece.first, piece.first + piece.texts)
                for before, found in feature_buckets(piece, buckets, longest):
                    sums = np.concatenate(([0], np.cumsum(gain[found])))
                    n[rows] += np.diff(before)
                    total[rows] += sums[before[1:]] - sums[before[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total // np.maximum(n, 1))], names)

    return run


def gumbel(seed: int) -> F.Column:
    """A thousand times Gumbel noise from a hash of doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, buckets: int = BUCKETS, least: int = MIN_FEATURES, seed: int = SEED, longest: int = LONGEST_RUN) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank, null unless drawn: of the N
    documents with ``least`` features the floor(share N / 100) highest scores are."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    counted = [{r.bucket: r.n for r in bucket_counts(x, buckets, longest).collect()} for x in (docs, target)]  # a number for each bucket
    gain = gains(*counted, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_features", "weight")])
    weighed = rows.mapInArrow(_weighed(gain, buckets, longest, schema.names), schema)
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel(seed)), "scored")

    fit = F.col("n_features") >= least
    # A row for each score: some ten thousands, whatever the number of documents.
    levels = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    levels = scratch.write(levels.withColumn("above", F.coalesce(above, F.lit(0).cast("long"))).coalesce(1), "levels")
    drawn = (levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * share) // 100
    ahead = levels.where(F.col("above") < drawn)
    lowest = ahead.agg(F.min("score")).first()[0]
    reached = fit & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)

    known = ["doc_id", "n_features", "weight", "score"]
    equal = scored.where(reached).groupBy(*known).agg(F.count("*").alias("times"))
    within = F.sum("times").over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")) - F.col("times")
    placed = equal.withColumn("within", within).join(F.broadcast(ahead.select("score", "above")), "score")
    chunks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(DEAL).cast("long")))).repartition("score", "doc_id", "at")
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + DEAL - 1, F.col("times") - 1))))
    rank = F.col("above") + F.col("within") + F.col("k") + 1
    ranked = each.select(*known, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 bit by bit over the bytes of distinct words.
SQL = r"""
WITH tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) AS r(n))),
docs AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rn FROM documents),
dw AS (SELECT doc_id, rn, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
c AS (SELECT w, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM u, tab),
db AS (SELECT doc_id, rn, b FROM dw JOIN c USING (w)), bb AS (SELECT b FROM bw JOIN c USING (w)),
s AS (SELECT b, count(*) AS n FROM db GROUP BY 1), t AS (SELECT b, count(*) AS n FROM bb GROUP BY 1),
g AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM db) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bb) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.b = t.b),
d AS (SELECT rn, count(*) AS n, sum(gain) AS total FROM db JOIN g USING (b) GROUP BY 1),
w AS (SELECT doc_id, rn, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight FROM docs LEFT JOIN d USING (rn)),
h AS (SELECT *, list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i + 1]) - 1 AS BIGINT)), lambda a, b: a * 16 + b, 0::BIGINT) AS h FROM w),
z AS (SELECT doc_id, rn, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (rn)
"""
