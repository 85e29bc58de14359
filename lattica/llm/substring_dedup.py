"""Substring dedup: repeated passages, located by automata of their phrases.

A window is 13 consecutive words. Each window is represented by the smallest hash of
its seven-word runs (its anchor), so equal windows have equal anchors, and a text has
far fewer anchors than windows. Documents whose anchors recur give their stretches
of such windows, and the windows' hashes confirm which passages recur, and in which
document first. Both searches range-partition (hash, document), so that a hash that
fills a third of all rows is split over tasks, and stream the sorted rows.

Equal stretches are collapsed first: a copy meets the first of its kind, and only that one
is searched. Every other stretch meets earlier stretches that it shares windows with.
Those earlier stretches, each once, are the confirmed passages. They are dealt to shards of
bounded size, and each shard's phrases (aligned runs of seven words, of which every window
holds one whole) are compiled into one Aho-Corasick automaton. Stretches are streamed through
the automata of the few shards that hold a passage they meet, which leaves no occurrence
out, and each hit is extended word by word. A shard that many stretches meet is compiled
in several tasks, among which they are dealt. What is removed has thus been compared as
text, not as hashes.

Defined results: a null text has no words; repeated rows have one doc_id, so neither
is earlier, and they lose the same words; rows with a null doc_id lose nothing and
take nothing; texts under 13 words lose nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, gram_hashes, lookup, text_bytes, word_hashes

WINDOW, ANCHOR, PHRASE = 13, 7, 7
#: Windows of a stretch; a longer one is cut into stretches that overlap by 12 words.
STRETCH = 400
#: Characters of passages in an automaton, and stretches that one task streams through it.
SHARD_CHARS, STREAM_ROWS = 1_000_000, 20_000

BASE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType()))])
STRETCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("words", T.StringType())])
SEEN = T.StructType([T.StructField(n, T.LongType()) for n in ("hash", "doc_id", "stretch")])
RECURS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("row", T.LongType())])
PAIRS = T.StructType([T.StructField(n, T.LongType()) for n in ("hash", "doc_id", "later", "earlier")])
RANGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ROUTED = ("shard", "part", "is_stretch", "stretch", "text", "met", "doc_id", "text_hash", "start")
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of the seven seven-word runs of each window."""
    low = gram_hashes(hashes, ANCHOR)
    for step in (1, 2, 3):
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
    return low


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, anchors = [], [], []
        ids = batch.column("doc_id")
        for text, known in zip(text_bytes(batch.column("text")), ids.is_valid().to_pylist(), strict=True):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            long_enough = known and len(words) >= WINDOW
            anchors.append(np.unique(window_anchors(word_hashes(words))).view(np.int64) if long_enough else np.empty(0, np.int64))
        ends = np.concatenate(([0], np.cumsum([len(a) for a in anchors])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(anchors) if anchors else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), lists], BASE.names)


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (anchor, row), those whose anchor another row has too. The first and the
    last anchor of a stretch of rows may go on elsewhere, so they always pass."""
    held = None  # the open run: its anchor and first row, until it is known to recur
    passed = True
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, row = batch.column("anchor").to_numpy(), batch.column("row").to_numpy()
        if held is not None and not passed:
            anchor, row = np.concatenate(([held[0]], anchor)), np.concatenate(([held[1]], row))
        same_before = np.concatenate(([held is not None and passed and anchor[0] == held[0]], anchor[1:] == anchor[:-1]))
        if held is None:
            same_before |= anchor == anchor[0]  # the head of this stretch
        same_after = np.concatenate((anchor[1:] == anchor[:-1], [False]))
        out = same_before | same_after
        # The last run stays open: if it is a single row, it waits for the next batch.
        passed = bool(out[-1])
        held = (int(anchor[-1]), int(row[-1]))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(anchor[out]), pa.array(row[out])], RECURS.names)
    if held is not None and not passed:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], RECURS.names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows whose anchors recur. The first stretch of a document carries
    all its words."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some, out = batch.slice(k, 256), []
            columns = [some.column(c).to_pylist() for c in ("doc_id", "text_hash")]
            for doc, mark, text, found in zip(*columns, text_bytes(some.column("text")), some.column("anchors"), strict=True):
                words = text.split()
                wanted = np.sort(np.asarray(found.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
                anchors = window_anchors(word_hashes(words))
                hit = wanted[np.minimum(np.searchsorted(wanted, anchors), len(wanted) - 1)] == anchors
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                whole: str | None = b" ".join(words).decode()
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    for s in range(a, b, STRETCH):
                        e = min(b, s + STRETCH)
                        part = b" ".join(words[s : e + WINDOW - 1])
                        out.append((doc, mark, s, part.decode(), xxhash.xxh3_128_digest(part), whole))
                        whole = None
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], STRETCHES.names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [gram_hashes(word_hashes(x.split()), WINDOW).view(np.int64) for x in text_bytes(batch.column("text"))]
        lengths = [len(x) for x in held]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), lengths)), pa.array(np.repeat(batch.column("stretch").to_numpy(), lengths))], SEEN.names)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (later, earlier) of stretches from sorted (hash, doc_id, stretch): earlier is
    where these rows meet the hash first, in a document with a smaller doc_id.

    The first document of the first run may not be its hash's first of all; its rows
    have earlier null, and so has the first row of the last run, which may go on
    elsewhere. They keep hash and doc_id, with later = their own stretch.
    """
    first = None  # the run that is open: hash, doc_id and stretch of its first row
    head: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hash_, doc, at = (batch.column(c).to_numpy() for c in SEEN.names)
        if head is None:
            head = (int(hash_[0]), int(doc[0]))
        new = np.concatenate(([first is None or hash_[0] != first[0]], hash_[1:] != hash_[:-1]))
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
        first_doc = np.where(place >= 0, doc[place], first[1] if first else 0)
        first_at = np.where(place >= 0, at[place], first[2] if first else 0)
        sure, unsure = first_doc < doc, (hash_ == head[0]) & (doc == head[1])
        if sure.any():
            pairs = np.unique(np.column_stack((at[sure], first_at[sure])), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], PAIRS.names)
        if unsure.any():
            yield pa.RecordBatch.from_arrays([pa.array(hash_[unsure]), pa.array(doc[unsure]), pa.array(at[unsure]), pa.nulls(int(unsure.sum()), pa.int64())], PAIRS.names)
        first = (int(hash_[-1]), int(first_doc[-1]), int(first_at[-1]))
    if first is not None and first[0] != head[0]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in first] + [pa.nulls(1, pa.int64())], PAIRS.names)


def earlier_stretches(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs (later, earlier) of stretches: for each window of a stretch that a
    document with a smaller doc_id has, one such stretch."""
    kinds = stretches.groupBy("digest").agg(F.min(F.struct("doc_id", "stretch")).alias("one"), F.count("*").alias("copies"))
    told = lookup(stretches.select("stretch", "doc_id", "digest", "text"), kinds, ["digest"], "copies", stretches.count(), ["stretch"])
    told = told.withColumn("copy", F.col("doc_id") > F.col("one.doc_id"))
    copies = scratch.write(told.where("copy").select(F.col("stretch").alias("later"), F.col("one.stretch").alias("earlier")), "copies")

    seen = told.where("not copy").select("text", "doc_id", "stretch").mapInArrow(_windows, SEEN)
    order = list(SEEN.names)
    found = scratch.write(seen.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_confirmed, PAIRS), "pairs")
    sure = found.where("earlier is not null").select("later", "earlier")
    # The ends of the runs at the ends of the stretches of rows: a few for each task.
    unsure = found.where("earlier is null").select("hash", "doc_id", "later")
    first = unsure.groupBy("hash").agg(F.min(F.struct("doc_id", "later")).alias("first"), F.count("*").alias("uses"))
    over = lookup(unsure, first, ["hash"], "uses", unsure.count(), ["doc_id", "later"]).where(F.col("doc_id") > F.col("first.doc_id"))
    return sure.unionByName(over.select("later", F.col("first.later").alias("earlier"))).distinct().unionByName(copies)


class Phrases:
    """An automaton of the phrases of some passages."""

    def __init__(self, texts: dict[int, str]):
        import ahocorasick

        self.words = {k: text.split(" ") for k, text in texts.items()}
        where: dict[str, dict[int, list[int]]] = defaultdict(dict)
        for k, words in self.words.items():
            for at in range(0, len(words) - PHRASE + 1, PHRASE):
                where[" " + " ".join(words[at : at + PHRASE]) + " "].setdefault(k, []).append(at)
        self.automaton = ahocorasick.Automaton()
        for phrase, places in where.items():
            self.automaton.add_word(phrase, (len(phrase), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def shared(self, text: str, sources: set[int]) -> list[tuple[int, int]]:
        """[start, end) word ranges of a text, 13 words or more, that one of the sources has."""
        if self.empty:
            return []
        words, out = text.split(" "), []
        done: dict[tuple[int, int], int] = {}
        for end, (length, places) in self.automaton.iter(f" {text} "):
            p = text.count(" ", 0, end - length + 1)  # words before the phrase
            # A phrase may stand in many passages, of which a text meets few, or the other way round.
            both = sources.intersection(places) if len(sources) < len(places) else [k for k in places if k in sources]
            for source in both:
                other = self.words[source]
                for q in places[source]:
                    if done.get((source, p - q), -1) > p:
                        continue
                    a = 0
                    while a < p and a < q and words[p - a - 1] == other[q - a - 1]:
                        a += 1
                    b = PHRASE
                    while p + b < len(words) and q + b < len(other) and words[p + b] == other[q + b]:
                        b += 1
                    done[(source, p - q)] = p + b
                    if a + b >= WINDOW:
                        out.append((p - a, p + b))
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges without those that touch: few rows for each stretch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges of stretches that the passages they meet have. Rows are sorted by shard and
    part, passages first: they are compiled, and the stretches after them streamed through."""
    at, sources, phrases = None, {}, None
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            some, out = batch.slice(k, 2000), []
            for shard, part, is_stretch, ident, text, met, doc, mark, start in zip(*[some.column(c).to_pylist() for c in ROUTED], strict=True):
                if (shard, part) != at:
                    at, sources, phrases = (shard, part), {}, None
                if not is_stretch:
                    sources[ident] = text
                    continue
                if len(met) == 1 and sources[met[0]] == text:  # a copy: all its words
                    out.append((doc, mark, start, start + text.count(" ") + 1))
                    continue
                phrases = phrases or Phrases(sources)
                out += [(doc, mark, start + a, start + b) for a, b in merged(phrases.shared(text, set(met)))]
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], RANGES.names)


def routed(pairs: DataFrame, stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages and the stretches that meet them, side by side in the parts of their shards."""
    passages = stretches.join(pairs.select(F.col("earlier").alias("stretch")).distinct(), "stretch", "left_semi").select("stretch", "text")
    size = passages.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-size // SHARD_CHARS)))).alias("shard")
    met = scratch.write(pairs.groupBy(F.col("later").alias("stretch"), shard("earlier")).agg(F.collect_set("earlier").alias("met")), "met")
    loads = met.groupBy("shard").agg(F.count("*").alias("rows"))
    loads = scratch.write(loads.select("shard", "rows", F.ceil(F.col("rows") / F.lit(STREAM_ROWS)).cast("long").alias("parts")), "loads")
    streams = lookup(met, loads, ["shard"], "rows", max(1, met.count()), ["stretch"]).join(stretches, "stretch")
    streams = streams.select("shard", F.pmod(F.xxhash64("stretch"), F.col("parts")).alias("part"), F.lit(True).alias("is_stretch"), "stretch", "text", "met", "doc_id", "text_hash", "start")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held = passages.select(shard("stretch"), "stretch", "text").join(loads, "shard")
    held = held.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_stretch"), "stretch", "text", none("met", "array<bigint>"), none("doc_id", "bigint"), none("text_hash", "bigint"), none("start", "int"))
    return held.unionByName(streams).repartition("shard", "part").sortWithinPartitions("shard", "part", "is_stretch")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some, counts, kept = batch.slice(k, 256), [], []
            for text, ranges in zip(some.column("words").to_pylist(), some.column("ranges").to_pylist(), strict=True):
                words = text.split(" ")
                gone = np.zeros(len(words), bool)
                for r in ranges:
                    gone[r["start"] : r["end"]] = True
                counts.append(int(gone.sum()))
                kept.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], KEPT.names)


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row: doc_id, text_hash, n_words, sha256 of all its words;
    rows that lose words: doc_id, text_hash, n_removed, kept text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = body.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_base, BASE)
    full = scratch.write(base.withColumn("row", F.monotonically_increasing_id()), "anchors")

    anchors = full.select(F.explode("anchors").alias("anchor"), "row")
    recurring = anchors.repartitionByRange("anchor", "row").sortWithinPartitions("anchor", "row").mapInArrow(_recurring, RECURS)
    by_row = recurring.groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    chosen = full.select("row", "doc_id", "text_hash").join(by_row, "row").dropDuplicates(["doc_id", "text_hash"])
    chosen = scratch.write(chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "anchors"), "chosen")
    base = scratch.write(full.drop("anchors", "row"), "base")
    scratch.drop("anchors")

    # The chosen rows grow with the input, so they are shuffled at every size.
    texts = body.join(chosen.hint("merge"), (body["doc_id"] == F.col("_id")) & (F.xxhash64(body["text"]) == F.col("_hash")))
    stretches = texts.select("doc_id", F.col("_hash").alias("text_hash"), "text", "anchors").mapInArrow(_stretches, STRETCHES)
    stretches = scratch.write(stretches.withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    scratch.drop("chosen")
    pairs = scratch.write(earlier_stretches(stretches, scratch), "paired")
    for done in ("pairs", "copies"):
        scratch.drop(done)

    ranges = routed(pairs, stretches, scratch).mapInArrow(_located, RANGES)
    ranges = scratch.write(ranges.distinct(), "ranges")
    for done in ("paired", "met", "loads"):
        scratch.drop(done)
    gathered = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    whole = stretches.where("words is not null").select("doc_id", "text_hash", "words")
    lost = whole.join(gathered, ["doc_id", "text_hash"]).mapInArrow(_removed, KEPT)
    # Rows that repeat doc_id and text have one answer.
    return base, lost.dropDuplicates(["doc_id", "text_hash"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, lost = repeated_passages(documents(spark, sf_dir))
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    out = base.join(lost, (base["doc_id"] == F.col("_id")) & (base["text_hash"] == F.col("_hash")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), x AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)
), f AS (SELECT passage, min(doc_id) AS first_doc FROM x GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM x JOIN f USING (passage) WHERE first_doc < doc_id
), k AS (SELECT w.doc_id, u.pos, u.word, g.pos IS NOT NULL AS gone FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w) u JOIN w USING (doc_id) LEFT JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos
), a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)
"""
