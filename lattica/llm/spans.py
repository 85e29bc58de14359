"""Words of the texts of an Arrow batch, located on the batch's bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are looked at together; a longer text is taken in pieces of so many.
PIECE = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true in the given ranges of bytes, ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, where each text begins and the last ends); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


@dataclass
class Piece:
    """Some whole texts, or a part of one long text: bytes, texts [first, last) and their ends in the bytes."""

    data: np.ndarray
    first: int
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1


def pieces(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, size: int = PIECE) -> Iterator[Piece]:
    """The batch in pieces of about ``size`` bytes that cut no word: whole texts together, and a
    longer text by itself, cut after the last byte outside a word, counted from its own begin."""
    k, n = 0, len(offsets) - 1
    while k < n:
        last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
        begin, end = int(offsets[k]), int(offsets[last])
        if end - begin <= size:
            yield Piece(data[begin:end], k, offsets[k : last + 1] - begin)
            begin = end
        while begin < end:  # one long text
            stop = min(end, begin + size)
            gaps = np.flatnonzero(~word[data[begin:stop]]) if stop < end else ()
            if len(gaps):
                stop = begin + int(gaps[-1]) + 1
            while stop < end and word[data[stop - 1]]:  # a word longer than a piece stays whole
                outside = np.flatnonzero(~word[data[stop : min(end, stop + size)]])
                stop = stop + int(outside[0]) + 1 if len(outside) else min(end, stop + size)
            yield Piece(data[begin:stop], k, np.array([0, stop - begin]))
            begin = stop
        k = last


def words(piece: Piece, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words before each text's begin and the end, each word's place among the
    distinct ones, the distinct words as bytes)."""
    inside = word[piece.data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = piece.offsets[:-1][piece.offsets[:-1] < len(inside)]
    start[heads] = inside[heads]
    begins = np.flatnonzero(start)
    before = np.cumsum(inside, dtype=np.int64)
    ends = np.concatenate((before[begins] - 1, before[-1:])) if len(begins) else np.zeros(1, np.int64)
    packed = piece.data[inside]
    column = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
    return np.searchsorted(begins, piece.offsets), column.indices.to_numpy(zero_copy_only=False), column.dictionary
