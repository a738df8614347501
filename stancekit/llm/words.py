"""Words of whole texts as Arrow strings and dense numbers, a slice at a time.

A class table says which bytes belong to words, which part words and which end
a piece of text; words never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stancekit.llm.common import by_bytes, text_buffers

WORD, GAP, STOP = 0, 1, 2


def byte_classes(gap: str, stop: str = "") -> np.ndarray:
    """Bytes between words, bytes that end a piece; all others are of words."""
    out = np.full(256, WORD, np.uint8)
    out[[ord(c) for c in gap]] = GAP
    out[[ord(c) for c in stop]] = STOP
    return out


class Words:
    """The words of a slice of texts: ``strings`` end to end, ``first`` word of
    each text (one more than texts), and the ``piece`` number of each word."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, classes: np.ndarray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # One byte after each text parts its last word from the next text's first.
        none, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        data, offsets = text_buffers(pc.binary_join_element_wise(pc.fill_null(pc.cast(texts, pa.large_string()), none), none, line))
        kind = classes[data]
        kind[offsets[1:] - 1] = STOP
        inside = kind == WORD
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(starts, offsets)
        self.piece = np.cumsum(kind == STOP, dtype=np.int32)[starts]
        raw = data[inside]
        if lower:
            raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
        off = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=off[1:])
        self.strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(raw))

    def __len__(self) -> int:
        return len(self.strings)

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        """Each word as its place in the list of distinct words."""
        found = self.strings.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Whole rows gathered until their texts are about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in by_bytes(batches, column, limit):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit // 2:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
