"""Best-two-fit packing of tokenised documents into equal sequences.

Documents become ids (with an end id), longer ones are cut into full pieces
and a rest. The pieces are dealt by hash into shards of a bounded size; a shard
holds lengths only and is packed in one task, so packing scales with the number
of shards. At tens of thousands of pieces a shard, what sharding costs is a
few sequences a shard.

Within a shard, longest first: a bin is filled greedily with the longest piece
that still fits; when none fits, its smallest piece may give way to two
unpacked pieces that fill the widened gap more tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.llm.common import by_bytes, materialize, released
from stancekit.llm.token_chunks import chunk_tokenizer

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
PIECES_PER_SHARD = 32_768


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, seq_len: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PIECES`` of every document: whole if it fits, else cut every
    ``seq_len`` ids. Null text counts as empty and is one piece, the end id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.lit(1), F.col(text_col)).alias("row_key"))
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("piece", pa.int32()),
                        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(tokenizer_path)
        for batch in by_bytes(batches, "text", 8 << 20):
            ids, per = tok.ids(batch.column("text"))
            ids = np.insert(ids, np.cumsum(per), end_id).astype("<u4")
            per = per + 1
            first = np.cumsum(per) - per
            n = -(-per // seq_len)
            doc = np.repeat(np.arange(len(per)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * seq_len
            length = np.minimum(per[doc] - start, seq_len)
            at = first[doc] + start
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), batch.column("row_key").take(pa.array(doc)),
                                   pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                                   pa.array(crc, pa.int64())], schema=schema)

    return rows.mapInArrow(released(cut), PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece (lengths from 1 to ``capacity``)."""
    order = np.argsort(-lengths, kind="stable")
    size = np.bincount(lengths, minlength=capacity + 1)
    stack_end = np.cumsum(size[::-1])[::-1]  # one past each length's last place in ``order``
    used_of = np.zeros(capacity + 1, np.int64)  # pieces taken of each length
    returned: dict[int, list[int]] = {}
    left = size.copy()
    # Longest length with pieces left that is at most x; kept up to date when a
    # length runs out or comes back.
    every = np.arange(capacity + 1)
    upto = np.maximum.accumulate(np.where(left > 0, every, 0))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def refresh():
        nonlocal upto
        upto = np.maximum.accumulate(np.where(left > 0, every, 0))

    def take(n: int) -> int:
        left[n] -= 1
        if left[n] == 0:
            refresh()
        if returned.get(n):
            return returned[n].pop()
        i = order[stack_end[n] - size[n] + used_of[n]]
        used_of[n] += 1
        return int(i)

    def give_back(n: int, i: int) -> None:
        returned.setdefault(n, []).append(i)
        left[n] += 1
        if left[n] == 1:
            refresh()

    b, todo = 0, len(lengths)
    while todo:
        members, gap = [], capacity
        while gap and (n := int(upto[gap])):
            members.append((n, take(n)))
            gap -= n
        if gap and len(members) > 1:
            n0, i0 = members[-1]  # the smallest: lengths are taken in falling order
            room = gap + n0
            a = np.flatnonzero(left[:room + 1] > 0)
            if len(a):
                second = upto[room - a]
                same = (second == a) & (left[a] < 2)
                if same.any():  # the piece cannot be its own partner
                    second[same] = upto[np.maximum(a[same] - 1, 0)]
                total = np.where(second > 0, a + second, 0)
                k = int(total.argmax())
                if total[k] > n0:
                    members.pop()
                    members += [(n, take(n)) for n in (int(a[k]), int(second[k]))]
                    give_back(n0, i0)
        at = 0
        for n, i in members:
            bins[i], offsets[i] = b, at
            at += n
        todo -= len(members)
        b += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, seq_len: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` should be a written table:
    it is counted, then packed."""
    shards = max(1, -(-pieces.count() // PIECES_PER_SHARD))
    schema = f"{PIECES}, sequence_id long, offset long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="shard").sort_values(["length", "doc_id", "row_key", "piece"],
                                                      ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(), seq_len)
        return rows.assign(sequence_id=(int(key[0]) << 36) + bins, offset=offsets)

    return (pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(shards)))
            .groupBy("shard").applyInPandas(pack, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, seq_len: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``seq_len`` ids.

    One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Null text counts as empty; null ids are kept; repeated rows are
    packed as often as they occur; an empty table gives no rows. Other columns
    are not read.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, end_id, seq_len, id_col, text_col), "pieces")
    return pack_pieces(pieces, seq_len).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                               "offset")
