"""Hard-negative mining by Four-Russians scoring.

Components become integers. Candidates are packed by bit planes: a byte holds one bit of
eight dimensions of a row, and the highest plane counts negative, as in two's complement. For a block
of anchors and each group of eight dimensions a table holds the sums of all 256 subsets
of the anchors' components. A score is then a sum of table rows, one for each plane and
group, shifted by the plane: the whole exact inner product, without a multiplication.

Anchors are a stated set of queries against all rows. Both sides are cut into blocks, and
a task scores a block of anchors against a stripe of candidate blocks, one after the
other, with the best of each anchor so far as the bound of what is looked at. A first
pass finds positives, a second one the negatives within each positive's bounds; the
tasks' best, a few rows for each anchor and stripe, meet in a window.

Defined results: rows without vec_id take no part, as those without label or vector or with a
component that is null or no finite number; rows that repeat a vec_id count once, the
smallest label and vector; a shorter vector counts as if zeros followed; integers of more
than 40 bits are cut to 40; products are 64-bit; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
#: Components beyond this are cut.
MOST = 1 << 39
#: Rows of a block of candidates and of anchors; candidate blocks of a stripe at most, and stripes from which
#: a stripe has more than one block; what is scored at once.
BLOCK, ANCHORS, STRIPE, STRIPES = 4096, 4096, 64, 256
AT_ONCE_ANCHORS, AT_ONCE_ROWS = 256, 1024
GROUP = 8
PACKED = "n int, width int, planes int, vec_id binary, label binary, bits binary"
HITS = "anchor_id long, slot int, vec_id long, score long"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (of every seventh id the next one) and v, the components as integers, of the rows that take part."""
    x = F.transform("embedding", lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(float(-MOST))), F.lit(float(MOST - 1)))))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    vec, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(vec.alias("vec_id"), F.struct(moved.alias("label"), x.alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a column of lists, with zeros behind the shorter ones, in whole groups."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = -(-int(lengths.max(initial=0)) // GROUP) * GROUP or GROUP
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(v: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes: bit d of a byte is the plane's bit of the group's dimension d."""
    planes = max(int(max(v.max(initial=0), -1 - v.min(initial=0))).bit_length() + 1, 1)
    weights = 1 << np.arange(GROUP)
    parts = v.reshape(len(v), -1, GROUP)
    return np.stack([(((parts >> p) & 1) * weights).sum(axis=2).astype(np.uint8).T for p in range(planes)])


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of the group's components that each byte chooses, by doubling."""
    groups = anchors.shape[1] // GROUP
    out = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for d in range(GROUP):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + anchors[:, d::GROUP].T[:, None].astype(kind)
    return out


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products from tables and bit planes, highest plane first."""
    planes, groups, rows = bits.shape
    out = np.zeros((rows, tables.shape[2]), tables.dtype)
    for p in range(planes - 1, -1, -1):
        out <<= 1
        for g in range(groups):
            part = tables[g][bits[p, g]]
            out = out - part if p == planes - 1 else np.add(out, part, out=out)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates as one row for each block, in order of vec_id within it."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            some = batch.slice(k, BLOCK)
            order = np.argsort(some.column("vec_id").to_numpy(), kind="stable")
            bits = bit_planes(matrix(some.column("v"))[order])
            ids, labels = (some.column(c).to_numpy()[order].astype(np.int64).tobytes() for c in ("vec_id", "label"))
            values = [[len(order)], [bits.shape[1] * GROUP], [len(bits)], [ids], [labels], [bits.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in PACKED.split(", ")])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("vec_id", "label"))
    return ids, labels, np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], row["width"] // GROUP, row["n"])


class Best:
    """The first rows of each slot by falling score and rising id; a slot is an anchor, or an anchor's positive."""

    def __init__(self, slots: int, most: int):
        self.most, self.slot, self.score, self.id = most, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bound = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank[keep] == self.most - 1
        self.bound[self.slot[full]] = self.score[full]


def _mine(anchors: pa.Table, stripe: pa.Table, most: int) -> pa.Table:
    """The best candidates of each anchor, or of each of an anchor's bounds: with ``low`` and ``high`` lists those of
    other labels between them, without the anchor's label."""
    a_ids, a_labels, a_v = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["v"].combine_chunks())
    bounded = "low" in anchors.column_names
    lows, highs = (anchors[c].combine_chunks() for c in ("low", "high")) if bounded else (None, None)
    blocks, out = [_unpacked(r) for r in stripe.to_pylist()], []
    for k in range(0, len(a_ids), AT_ONCE_ANCHORS):
        ids, labels, v = (x[k : k + AT_ONCE_ANCHORS] for x in (a_ids, a_labels, a_v))
        if bounded:
            counts = np.diff(lows.offsets.to_numpy())[k : k + AT_ONCE_ANCHORS]
            first = int(lows.offsets[k].as_py())
            low, high = (x.values.to_numpy()[first : first + counts.sum()] for x in (lows, highs))
        else:
            counts = np.ones(len(ids), np.int64)
            low, high = np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
        anchor = np.repeat(np.arange(len(ids)), counts)
        part = np.arange(len(anchor)) - np.repeat(np.cumsum(counts) - counts, counts)
        best, tables = Best(len(anchor), most), {}
        for c_ids, c_labels, bits in blocks:
            width = max(v.shape[1], bits.shape[1] * GROUP)
            largest = int(np.abs(v).sum(axis=1).max(initial=0)) << bits.shape[0]
            kind = np.int32 if largest < 1 << 31 else np.int64
            if (width, kind) not in tables:
                tables[width, kind] = subset_sums(np.pad(v, ((0, 0), (0, width - v.shape[1]))), kind)
            table = tables[width, kind][: bits.shape[1]]
            for r in range(0, len(c_ids), AT_ONCE_ROWS):
                rows = slice(r, r + AT_ONCE_ROWS)
                s = scores(table, bits[:, :, rows])
                same = c_labels[rows][:, None] == labels
                fits = ~same if bounded else same & (c_ids[rows][:, None] != ids)
                for slots in range(int(counts.max(initial=0))):  # a positive of each anchor at a time
                    chosen = np.flatnonzero(part == slots)
                    of = anchor[chosen]
                    among = s[:, of]
                    row, at = np.nonzero(fits[:, of] & (among <= high[chosen]) & (among >= np.maximum(low, best.bound)[chosen]))
                    if len(row):
                        best.add(chosen[at], among[row, at].astype(np.int64), c_ids[rows][row])
        out.append(pa.table([pa.array(ids[anchor[best.slot]]), pa.array(part[best.slot].astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=[c.split()[0] for c in HITS.split(", ")]))
    return pa.concat_tables(out)


def _first(anchors: DataFrame, stripes: DataFrame, n_stripes: int, n_blocks: int, most: int) -> DataFrame:
    """anchor_id, slot, vec_id, score and rank from 1 of the first ``most`` candidates of every slot."""
    left = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(max(n_stripes, 1) - 1))))
    right = stripes.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))))
    found = left.groupBy("anchor_block", "stripe").cogroup(right.groupBy("anchor_block", "stripe")).applyInArrow(lambda a, b: _mine(a, b, most) if a.num_rows and b.num_rows else _none(), HITS)
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _none() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=[c.split()[0] for c in HITS.split(", ")])


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors,
    rows whose vec_id is a multiple of ``every``."""
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = scratch.write(integers(embeddings), "rows")
    stripes = scratch.write(rows.mapInArrow(_pack, PACKED), "packed")
    sizes = stripes.agg(F.count("*").alias("n")).first().n
    n_stripes = max(-(-sizes // STRIPE), min(sizes, STRIPES))
    stripes = scratch.write(stripes.withColumn("stripe", (F.monotonically_increasing_id() % max(n_stripes, 1)).cast("int")), "stripes")
    of = rows.where(F.col("vec_id") % every == 0)
    n_blocks = -(-of.count() // ANCHORS)
    anchors = scratch.write(of.withColumn("anchor_block", F.pmod(F.xxhash64("vec_id"), F.lit(max(n_blocks, 1))).cast("int")), "anchors")
    near = scratch.write(_first(anchors, stripes, n_stripes, n_blocks, positives), "positives")

    # Bounds in integers: low s <= 100 x <= high s. Decimals, as a long product may not hold.
    exact = F.col("score").cast("decimal(20,0)")
    least, most = F.ceil(exact * low / 100).cast("long"), F.floor(exact * high / 100).cast("long")
    slot = F.col("rank") - 1
    bounds = near.where(F.col("score") >= 0).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(slot.alias("slot"), least.alias("low"), most.alias("high")))).alias("b"))
    bounded = anchors.join(bounds.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "anchor_block", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    found = _first(scratch.write(bounded, "bounded"), stripes, n_stripes, n_blocks, negatives)
    pairs = near.select("anchor_id", slot.alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same QUALIFY r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
