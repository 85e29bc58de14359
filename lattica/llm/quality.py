"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass turns every whole text into a row of statistics: shares of kinds of bytes, of
words and of line ends, repetition and length. Labels meet these narrow rows, never the
texts. The trees are fitted on a bounded sample of labelled rows (SAMPLE rows, those of the
smallest hash of doc_id): statistics are put into bins at the sample's quantiles, and a tree
grows level by level from sums of gradients for each node, statistic and bin. Trees of one
depth lie flat in three arrays (statistic, threshold, leaf), node k above 2k+1 and 2k+2, and
all rows of an Arrow batch walk a tree at once.

Labels, lang, source and doc_id are no inputs of a score. Defined results: a null or empty
text has statistics of zero and a score like any; a null doc_id is not held out and has no
label; of a document's labels the mean is learned, labels other than 0 and 1 count as none;
rows that repeat a doc_id with other texts are learned as the row of the smallest
statistics; without labels every score is 0.5, with labels of one kind it is near that kind;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents
from .spans import Piece, byte_set, pieces, text_buffer, words

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE = 64, 40, 4, 0.2, 1.0, 1.0

#: Kinds of bytes; what is in none is a letter in lower case.
KINDS = ["lower", "upper", "digit", "blank", "line end", "stop", "mark", "bracket", "symbol", "bar", "beyond ASCII", "control"]
KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:", b"!?", b"()[]{}<>\"'", b"#$%&*+-/=@\\^_`~", b"|", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127])], 1):
    KIND[list(_bytes)] = _k
BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
STATISTICS = [*(f"share of bytes: {k}" for k in KINDS), "bytes", "words", "lines", "bytes a word", "words a line", "words like the one before", "distinct words", "words that begin in upper case", "words in upper case", "words that end in a letter", "words that end in a mark or symbol", "bytes like the one before", "lines of one word"]


def _counts(piece: Piece) -> np.ndarray:
    """Sums over each text of a piece: bytes of each kind, then words, repeated, distinct, upper begins,
    upper throughout, letter ends, mark ends, repeated marks, lines of one word."""
    n, k = piece.texts, len(KINDS)
    out = np.zeros((n, k + 9), np.int64)
    if not len(piece.data):
        return out
    kind = KIND[piece.data]
    text = np.repeat(np.arange(n), np.diff(piece.offsets))
    out[:, :k] = np.bincount(text * k + kind, minlength=n * k).reshape(n, k)
    before, index, distinct = words(piece, ~BLANK)
    per_text = lambda of, flags: np.bincount(of, weights=flags, minlength=n).astype(np.int64)
    out[:, k] = np.diff(before)
    doubled = (piece.data[1:] == piece.data[:-1]) & (kind[1:] >= KINDS.index("stop")) & (kind[1:] <= KINDS.index("bar")) & (text[1:] == text[:-1])
    out[:, k + 7] = per_text(text[1:], doubled)
    if len(index):
        owner = np.repeat(np.arange(n), np.diff(before))
        again = np.zeros(len(index), bool)
        again[1:] = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
        out[:, k + 1] = per_text(owner, again)
        out[:, k + 2] = np.bincount(np.unique(owner * len(distinct) + index) // len(distinct), minlength=n)
        at = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        letters = KIND[np.frombuffer(distinct.buffers()[2], np.uint8)]
        first, last = letters[at[:-1]], letters[at[1:] - 1]
        uppers = np.add.reduceat(letters == 1, at[:-1])
        lowers = np.add.reduceat((letters == 0) | (letters == KINDS.index("beyond ASCII")), at[:-1])
        letter_end = (last <= 1) | (last == KINDS.index("beyond ASCII"))
        mark_end = (last >= KINDS.index("mark")) & (last <= KINDS.index("bar"))
        for c, flags in enumerate((first == 1, (uppers > 1) & (lowers == 0), letter_end, mark_end), k + 3):
            out[:, c] = per_text(owner, flags[index])
        lone = np.zeros(len(index), bool)  # a line's first word with a line end behind it
        inside = ~BLANK[piece.data]
        begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & (text[1:] == text[:-1]))))
        ends = begins + np.diff(at)[index]
        line_end = kind == KINDS.index("line end")
        opens = np.concatenate(([True], line_end[:-1] | (text[1:] != text[:-1])))[begins]
        closes = np.concatenate((line_end, [True]))[np.minimum(ends, len(line_end))] | (np.concatenate((text, [-1]))[np.minimum(ends, len(text))] != owner)
        lone |= opens & closes
        out[:, k + 8] = per_text(owner, lone)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, statistics) of a string column. Of a text beyond a piece, words are compared within its pieces."""
    k, sums = len(KINDS), np.zeros((len(column), len(KINDS) + 9), np.int64)
    for piece in pieces(*text_buffer(column), ~BLANK):
        sums[piece.first : piece.first + piece.texts] += _counts(piece)
    size, n, lines = sums[:, :k].sum(axis=1), sums[:, k], sums[:, KINDS.index("line end")] + 1
    over = lambda a, b: a / np.maximum(b, 1)
    repeated, distinct, begin, upper, letter, mark, doubled, lone = sums[:, k + 1 :].T
    return np.column_stack([*(over(c, size) for c in sums[:, :k].T), np.log1p(size), np.log1p(n), np.log1p(lines), over(size, n), over(n, lines), over(repeated, n), over(distinct, n), over(begin, n), over(upper, n), over(letter, n), over(mark, n), over(doubled, size), over(lone, lines)]).astype(np.float32)


@dataclass
class Forest:
    """Trees of one depth: (trees, inner nodes) statistics and thresholds, (trees, leaves) values."""

    prior: float
    statistic: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows (n, statistics): every row goes one level down at a time."""
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.statistic.shape[1]
        for statistic, threshold, leaf in zip(self.statistic, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, statistic[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Ascending thresholds of each statistic, at quantiles that occur; a value is in the bin of the edges below it."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T] if len(x) else [np.empty(0, np.float32)] * x.shape[1]


def histograms(codes: np.ndarray, node: np.ndarray, nodes: int, bins: int, *values: np.ndarray) -> list[np.ndarray]:
    """(nodes, statistics, bins) sums of each of some values over rows (n, statistics) of bin numbers."""
    n, m = codes.shape
    cell = ((node[:, None] * m + np.arange(m)) * bins + codes).ravel()
    return [np.bincount(cell, weights=np.repeat(v, m), minlength=nodes * m * bins).reshape(nodes, m, bins) for v in values]


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float = RIDGE, least: float = LEAST_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, statistic, bin) of each node's best split into the bins up to one and those above."""
    left_g, left_h = g.cumsum(axis=2)[..., :-1], h.cumsum(axis=2)[..., :-1]
    all_g, all_h = g.sum(axis=2)[..., None], h.sum(axis=2)[..., None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < least) | (right_h < least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosted trees for logistic loss; y may lie between 0 and 1. A node without a gain sends all rows left."""
    inner = (1 << depth) - 1
    edges = bin_edges(x, bins)
    codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]) if len(x) else np.zeros(x.shape, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    out, statistic, threshold, leaf = np.full(len(x), prior), [], [], []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        s, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(x), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            gain, which, at = best_splits(*histograms(codes, node - first, 1 << level, bins, g, h))
            for k in np.flatnonzero(gain > 1e-9):
                s[first + k], t[first + k] = which[k], edges[which[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), s[node]] > t[node])
        sums = [np.bincount(node - inner, weights=v, minlength=inner + 1) for v in (g, h)]
        leaf.append(rate * sums[0] / (sums[1] + RIDGE))
        out += leaf[-1][node - inner]
        statistic.append(s)
        threshold.append(t)
    empty = (np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    return Forest(prior, *(np.array(v) for v in (statistic, threshold, leaf))) if statistic else Forest(prior, *empty)


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id is kept for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text as an array."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["doc_id", "x"])

    return rows.mapInArrow(run, schema)


def learned(stats: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Forest:
    """Trees from the documents with a label that are not held out, of which the ``sample`` smallest hashes are taken."""
    quality = F.col("quality").cast("double")
    known = labels.where(quality.isin(0.0, 1.0) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(quality).alias("y"))
    # Each id once before the join, so that no id is heavy in it.
    once = stats.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("x").alias("x"))
    labelled = scratch.write(once.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id")), "labelled")
    # Hashes are even, so under this one lie few more than the sample; those alone are sorted.
    reach = (sample + 6 * sample**0.5 + 100) / max(labelled.count(), 1)
    if reach < 1:
        labelled = labelled.where(F.col("at") < int((reach - 0.5) * 2.0**64))
    rows = labelled.orderBy("at", "doc_id").limit(sample).select("x", "y").toPandas()
    x = np.array(rows.x.tolist(), np.float32).reshape(len(rows), len(STATISTICS))
    return fit(x, rows.y.to_numpy(float))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score and predicted of described documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.score(x))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (higher: good text is likelier) and predicted of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(described(docs), "statistics")
    return scored(stats, learned(stats, labels, scratch, sample))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
