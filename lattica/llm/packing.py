"""Packing: concatenate and cut.

The documents of a partition are one run of tokens. A first pass writes the tokens
with their offset in the partition's run; the partitions' totals, one row each, get
prefix sums, so that every document has a global offset. A second pass cuts the
global run at multiples of the window. Pieces that meet a window's edge inside a
document are boundary pieces. Only the very last sequence can be short.

The tokenizer works on text between blanks, and blanks end its pieces, so each
task keeps the ids of chunks it has met in a table of bounded size. Table and
tokenizer go when the task ends, as a worker outlives it.

Defined results: a null text is empty and consists of the end token; a null doc_id
and repeated rows are packed like any row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents

WINDOW, END_ID = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: Chunks of text whose ids a task keeps, in each of two generations, and the longest that is kept: a text
#: without blanks is one chunk of any length.
CACHE, LONGEST_KEPT = 200_000, 64

TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("boundary", T.BooleanType()), T.StructField("ids", T.BinaryType())])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable ones stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Text -> ids as little-endian unsigned 32-bit bytes; a table of chunks met lately.

    A word of letters, in lower case and composed form, is one piece to the
    tokenizer, so its ids come from the tokenizer's model alone; every other chunk
    goes through the whole tokenizer. A letter word with a stop or comma is two
    pieces, and the tokenizer lowers case, so those forms share one entry's work.
    A special token in a text gets its own id, as the tokenizer gives it; special tokens
    hold no blank, so they lie within chunks that are no words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.older = self.tokenizer.model, byte_letters(), {}
        self.tails = {mark: self._whole(mark) for mark in ".,"} | {"": b""}

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters in lower case."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            tail = chunk[-1] if chunk[-1] in ".," else ""
            word = chunk[:-1] if tail else chunk
            # Lowering the dotted I and sigma depends on what is around them.
            if word.isalpha() and (word.isascii() or (is_normalized("NFC", word) and "\u0130" not in word and "\u03a3" not in word)):
                word = word.lower()
                ids = (self._word(word) if word == chunk else self[word]) + self.tails[tail]
            else:
                ids = self._whole(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        look_up = self.__getitem__
        return [b"".join(map(look_up, text.replace("\n", " ").split(" "))) for text in texts]


def _tokenised(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        from pyspark import TaskContext

        encode, part, at, end = Encoder(path).encode_batch, TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # A few documents at a time, so that ids of one output batch stay small.
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids = [x + end for x in encode([text or "" for text in some.column("text").to_pylist()])]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.concatenate(([0], np.cumsum(counts)[:-1]))
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), some.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(ids, pa.binary())], TOKENS.names)

    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                out: list[tuple] = []
                for doc, offset, n, ids in zip(some.column("doc_id").to_pylist(), some.column("offset").to_pylist(), some.column("n").to_pylist(), some.column("ids"), strict=True):
                    view, start = memoryview(ids.as_buffer()), 0
                    while start < n:
                        sequence, inside = divmod(offset + start, window)
                        length = min(n - start, window - inside)
                        out.append((doc, start, length, n, sequence, inside, length < n, view[4 * start : 4 * (start + length)]))
                        start += length
                columns = list(zip(*out, strict=True)) or [()] * len(PIECES.names)
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in c] if t == pa.binary() else c, t) for c, t in zip(columns, kinds, strict=True)], PIECES.names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset,
    boundary (the document goes on in another sequence) and ids (uint32 bytes)."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.write(rows.mapInArrow(_tokenised(path or vocabulary_path(), end_id), TOKENS), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    # One row for each input partition: a prefix sum over the totals.
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = scratch.write(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("offset"), "n", "ids")
    return placed.mapInArrow(_cut(window), PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")
