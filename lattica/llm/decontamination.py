"""Benchmark decontamination by greedy string tiling.

Words of documents and test items are hashed, and runs of ``min_match`` words are hashed
from them as in Karp-Rabin matching: these are the seeds. A bit filter of the items' seeds,
of a fixed size whatever their number, goes to all tasks; a document keeps the words that
lie under its hits, usually none, and its seeds are joined with the items' in Spark. To
cover a share of an item, tiles must hold a certain number of its seed positions; so many
less one of its commonest seeds are left out of the join, and no pair can be missed. A stem
that all items share thus makes pairs only with items that consist of little else.

For each document and item that meet, the longest match of words not yet marked is marked
in both, again and again, until no match of ``min_match`` words is left. The length of the
longest match is found by bisection over running hashes, and matches of that length are
marked from left to right, so memory is in proportion to the two sequences, however often
they repeat themselves. The share of an item's words under tiles is its coverage; the order
of the tiles does not matter, so passages whose parts were moved are still found.

Words are compared in lower case and without ASCII punctuation. Defined results: a
null text has no words; an item of fewer than ``min_match`` words is one seed and is found
whole or not at all, in documents of any length; an item without words is never found;
repeated rows and repeated items are each reported; a null doc_id is reported as null;
without documents or items the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, gram_hashes, mix, row_mark, without, word_hashes

MIN_MATCH, COVERAGE = 5, 0.5
#: Bits of the filter that every task holds, and of a piece of it: 16 MB and 64 KB.
FILTER_BITS, PIECE_BITS = 1 << 27, 1 << 19

ITEMS = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("item_hashes", T.BinaryType()), T.StructField("seeds", T.ArrayType(T.LongType()))])
PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("bits", T.BinaryType())])
HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_mark", T.LongType()), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("at", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
TILE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_start", "item_start", "length")])
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row_mark", "item_id", "item_words", "covered_words")] + [T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(TILE))])

_BLANKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


def seeds(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; runs of different sizes are told apart."""
    return mix(gram_hashes(hashes, size) + np.uint64(size))


def _running(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, from which a run's hash is one product and one difference."""
    base = 0x9E3779B97F4A7C15
    powers = np.empty(len(hashes) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = base
    powers = np.multiply.accumulate(powers)
    # sum of h[i] * base^(-i), by the inverse of the odd base, so that prefixes are plain sums
    inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * np.multiply.accumulate(inverse)[:-1])))
    return prefix, powers


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling (doc position, item position, length) of two sequences of word hashes.

    Of matches of one length the leftmost in the document comes first, then the leftmost
    in the item. Zeros match nothing."""
    sides = []
    for own, other in ((doc, item), (item, doc)):
        taken = ~np.isin(own, other) | (own == 0)
        sides.append((own, taken, *_running(own)))

    def runs(side, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the runs of n words of which none is taken."""
        own, taken, prefix, powers = side
        before = np.concatenate(([0], np.cumsum(taken)))
        starts = np.flatnonzero(before[n:] == before[:-n]) if len(own) >= n else np.empty(0, int)
        return starts, (prefix[starts + n] - prefix[starts]) * powers[starts]

    def shared(n: int) -> bool:
        return bool(len(np.intersect1d(runs(sides[0], n)[1], runs(sides[1], n)[1])))

    out: list[tuple[int, int, int]] = []
    high = min(len(doc), len(item))
    while high >= min_match and shared(min_match):
        low, top = min_match, high
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if shared(middle) else (low, middle - 1)
        n = low
        (starts, hashes), (in_item, item_hashes) = runs(sides[0], n), runs(sides[1], n)
        order = np.argsort(item_hashes, kind="stable")
        in_item, item_hashes = in_item[order], item_hashes[order]
        left, right = np.searchsorted(item_hashes, hashes, "left"), np.searchsorted(item_hashes, hashes, "right")
        able = left < right
        doc_taken, item_taken = sides[0][1], sides[1][1]
        pointer: dict[int, int] = {}  # the first place of a hash that may still be free
        free_from = 0
        for a, first, last in zip(starts[able].tolist(), left[able].tolist(), right[able].tolist(), strict=True):
            if a < free_from:
                continue
            at = pointer.get(first, first)
            while at < last and (item_taken[in_item[at]] or item_taken[in_item[at] + n - 1]):
                at += 1
            pointer[first] = at
            for b in in_item[at:last].tolist():
                if not (item_taken[b] or item_taken[b + n - 1]) and np.array_equal(doc[a : a + n], item[b : b + n]):
                    doc_taken[a : a + n] = item_taken[b : b + n] = True
                    out.append((a, b, n))
                    free_from = a + n
                    break
        high = n - 1
    return sorted(out)


def _read_items(min_match: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            hashes = [word_hashes(words(text)) for text in batch.column("text").to_pylist()]
            found = [np.unique(seeds(h, min(len(h), min_match))) if len(h) else h for h in hashes]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([len(h) for h in hashes], pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary()), lists], ITEMS.names)

    return run


def _filter_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of the filter that a task's seeds set bits in."""
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for spot in _spots(batch.column("seed").to_numpy().view(np.uint64)):
            piece = spot // np.uint64(PIECE_BITS)
            for p in np.unique(piece).tolist():
                inside = (spot[piece == p] % np.uint64(PIECE_BITS)).astype(np.int64)
                np.bitwise_or.at(pieces.setdefault(p, np.zeros(PIECE_BITS // 8, np.uint8)), inside >> 3, np.uint8(1) << (inside & 7).astype(np.uint8))
    if pieces:
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], PIECES.names)


def _united(rows: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE_BITS // 8, np.uint8)
    for raw in rows.column("bits").to_pylist():
        bits |= np.frombuffer(raw, np.uint8)
    return pa.table([rows.column("piece").slice(0, 1), pa.array([bits.tobytes()], pa.binary())], names=PIECES.names)


def _spots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    out = np.ones(len(hashes), bool)
    for probe in range(2):
        at = np.flatnonzero(out)
        spot = _spots(hashes[at])[probe]
        out[at] = (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1
    return out


def _hits(sent, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of documents with a seed that items may have: the seeds, and place and hash of the words under them."""

    def run(batches):
        for batch in batches:
            bits, out = sent.value, []
            for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_mark").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = words(text)
                hashes, found, under = word_hashes(seen), [], None
                for size in sizes:
                    runs = seeds(hashes, size)
                    at = np.flatnonzero(_held(bits, runs))
                    if len(at):
                        found.append(np.unique(runs[at]))
                        under = np.zeros(len(seen), bool) if under is None else under
                        under[(at[:, None] + np.arange(size)).ravel()] = True
                if found:
                    kept = np.flatnonzero(under)
                    out.append((doc, mark, np.concatenate(found).view(np.int64), kept.astype(np.int64).tobytes(), hashes[kept].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], HITS.names)

    return run


def _tiled(min_match: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            out = []
            for doc, mark, item_id, n, at, hashes, item in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row_mark", "item_id", "item_words", "at", "hashes", "item_hashes")], strict=True):
                place, held = np.frombuffer(at, np.int64), np.frombuffer(hashes, np.uint64)
                # A zero stands wherever words are left out.
                gaps = np.flatnonzero(np.diff(place) > 1) + 1
                found = tiles(np.insert(held, gaps, 0), np.frombuffer(item, np.uint64), min(min_match, n))
                covered, place = sum(t[2] for t in found), np.insert(place, gaps, -1)
                if covered >= least * n:
                    out.append((doc, mark, item_id, n, covered, covered / n, [{"doc_start": int(place[a]), "item_start": b, "length": m} for a, b, m in found]))
            if out:
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.struct([(f, pa.int64()) for f in TILE.names]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], FOUND.names)

    return run


def telling_seeds(items: DataFrame, min_match: int, least: float) -> DataFrame:
    """(seed, item) without each item's commonest seeds, as many as leave one of every pair to be found.

    Tiles that cover c words lie over c / min_match seed positions at least. A seed may
    stand at several positions, so all of an item's positions that it leaves out are counted."""
    rows = items.select("item", "item_words", "item_hashes", F.explode("seeds").alias("seed"))
    uses = rows.groupBy("seed").agg(F.count("*").alias("items"))
    size = F.least("item_words", F.lit(min_match))
    need = F.ceil(F.ceil(F.col("item_words") * F.lit(least)) / size)
    positions = F.col("item_words") - size + 1
    # Distinct seeds that may be left out; where seeds repeat within an item, only what one each would leave.
    spare = F.greatest(need - 1 - (positions - F.count("*").over(W.partitionBy("item"))), F.lit(0))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("items"), "seed"))
    return rows.join(uses, "seed").withColumn("rank", rank).withColumn("spare", spare).where(F.col("rank") > F.col("spare")).select("seed", "item")


def _contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int, least: float) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tiling")
    texts = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.write(texts.mapInArrow(_read_items(min_match), ITEMS).where("item_words > 0"), "items")
    sizes = sorted(r.size for r in items.select(F.least("item_words", F.lit(min_match)).cast("int").alias("size")).distinct().collect())
    pieces = items.select(F.explode("seeds").alias("seed")).mapInArrow(_filter_pieces, PIECES).groupBy("piece").applyInArrow(_united, PIECES)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pieces.collect():  # at most FILTER_BITS / PIECE_BITS rows
        bits[r.piece * PIECE_BITS // 8 : (r.piece + 1) * PIECE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    telling = scratch.write(telling_seeds(items, min_match, least), "telling")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_mark(F.col("text")).alias("row_mark"), F.col("text").cast("string").alias("text"))
    hits = rows.mapInArrow(_hits(spark.sparkContext.broadcast(bits), sizes), HITS)
    hits = scratch.write(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("row", F.explode("seeds").alias("seed")).join(telling, "seed").select("row", "item").distinct()
    met = pairs.join(hits.drop("seeds"), "row").join(items.drop("seeds"), "item")
    return met.drop("row", "item").mapInArrow(_tiled(min_match, least), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, least: float = COVERAGE) -> DataFrame:
    """One row for each document and test item whose coverage reaches ``least``."""
    return _contaminated(docs, benchmark, min_match, least).drop("row_mark")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, least: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all columns, that cover no test item.

    The rows that go, which are few, are looked up by doc_id and a hash of the text."""
    gone = _contaminated(docs, benchmark, min_match, least).select("doc_id", "row_mark").distinct()
    return without(docs, Scratch(docs.sparkSession, "contaminated").write(gone, "gone"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
