"""J4 for large lexicons: which of very many trigger phrases a text contains.

A generated ``CASE`` chain (``rules.rule_label``) tests every text against every
trigger, which ends at some hundred triggers. Here the lexicon is a table. A
text that contains a trigger also contains each of its grams (runs of bytes of
one of a few sizes), so triggers are looked up by one gram each, the one counted
least in the texts, and only texts that hold it are searched for the trigger.

Grams are 64-bit hashes. The count that chooses among a trigger's grams is kept
in hashed cells of bounded size. The lexicon goes to the tasks in rounds of
bounded size, and each text is searched where it lies: at every place that holds
a gram of some trigger the trigger is compared in full. So neither the grams nor
the pairs of text and trigger, of which there can be very many more than texts,
are ever written or shuffled; what a round leaves of a text is a count and the
first trigger. Equal hashes, cells or bits of different grams cost a search
more, never a result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

GRAMS = (1, 2, 4, 8, 12)  # bytes; a trigger is looked up by one of the largest size that it has
HOT_SHARE = 1000  # pairs of a place and a trigger are compared in portions of 2 ** 28 over this, however hot a gram is
SLICE = 1 << 20  # text bytes looked at together
COUNT_BITS = (18, 22)  # cells of the gram counts: 256 a trigger, within these powers of two
MARK_BITS = (18, 25)  # bits of the bitmap of a round's grams, likewise
CHUNK = 1 << 14  # cells that travel in one row
ROUND_BYTES = 96 << 20  # of the lexicon sent to the tasks together
WORD = 8  # bytes compared at once

Write = Callable[[DataFrame, str], DataFrame]


def _texts(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with the UTF-8 bytes of their texts, one after the
    other, and where each text begins. Null counts as empty."""
    for batch in batches:
        raw = pc.fill_null(pc.cast(batch.column(column), pa.large_binary()), b"")
        _, offsets, data = raw.buffers()
        ends = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        cuts = np.flatnonzero(np.diff((ends[1:] - ends[0] - 1) // limit)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a)), data[ends[a]:ends[b]], ends[a:b + 1] - ends[a]


def _places(points: np.ndarray, first: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the place, the row and the hash of every gram of so many bytes (or other ``points``)."""
    size = np.diff(first)
    row, room = np.repeat(np.arange(len(size)), size), np.repeat(first[1:], size) - np.arange(len(points))
    values, h = points.astype(np.uint64) + np.uint64(1), np.zeros(len(points), np.uint64)
    for k in range(1, min(max(sizes), len(points)) + 1):
        n = len(points) - k + 1
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + values[k - 1:]
        if k in sizes:
            at = np.flatnonzero(room[:n] >= k)
            x = h[at] + np.uint64(k)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
            yield k, at, row[at], x ^ (x >> np.uint64(33))


def _grams(points: np.ndarray, first: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Likewise, without the place."""
    return ((k, row, grams) for k, _, row, grams in _places(points, first, sizes))


def _gram_size(size: np.ndarray) -> np.ndarray:
    """Of triggers of so many bytes."""
    return np.array(GRAMS)[np.searchsorted(GRAMS, size, side="right") - 1]


def _bits(n: int, bounds: tuple[int, int]) -> int:
    return min(max(int(256 * n).bit_length(), bounds[0]), bounds[1])


def _cell(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(texts: DataFrame, sizes: Sequence[int], bits: int) -> np.ndarray:
    """How often the grams of each hashed cell occur: one pass over the texts, a
    table of fixed size from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for _, points, first in _texts(batches, "__text"):
            for _, _, grams in _grams(points, first, sizes):
                np.add.at(total, _cell(grams, bits), 1)
        chunks = [c for c in range(-(-len(total) // CHUNK)) if total[c * CHUNK:(c + 1) * CHUNK].any()]
        if chunks:
            total = np.minimum(total, 2**31 - 1).astype(np.int32)
            # Bytes of equal place lie together, which packs better.
            parts = [zlib.compress(total[c * CHUNK:(c + 1) * CHUNK].view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for c in chunks]
            yield pa.record_batch([pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel().astype(np.int64) for x in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1].to_numpy(), "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    schema = "chunk int, counts binary"
    table = np.zeros(1 << bits, np.int32)
    for r in texts.select("__text").mapInArrow(count, schema).groupBy("chunk").applyInPandas(add, schema).collect():  # 2 ** bits numbers
        table[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int32)
    return table


def rarest_gram(entries: DataFrame, counts: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """``entries`` with ``gram``, of each trigger the gram that is counted least, and ``at``,
    its place. A trigger with a gram that is counted nowhere occurs nowhere and is left out."""
    bits = len(counts).bit_length() - 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, first in _texts(batches, "trigger"):
            own = _gram_size(np.diff(first))
            found = [(at[fit], row[fit], grams[fit]) for k, at, row, grams in _places(points, first, sizes) for fit in [own[row] == k]]
            if not found:
                continue
            at, row, grams = (np.concatenate(x) for x in zip(*found, strict=True))
            often = counts[_cell(grams, bits)]
            order = np.lexsort((grams, often, row))
            order = order[np.diff(row[order], prepend=-1) > 0]
            order = order[often[order] > 0]
            kept = batch.take(pa.array(row[order]))
            place = (at[order] - first[row[order]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(grams[order].view(np.int64)), pa.array(place)], names=[*kept.schema.names, "gram", "at"])

    return entries.mapInArrow(choose, StructType([*entries.schema.fields, StructField("gram", LongType()), StructField("at", IntegerType())]))


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    text = np.concatenate((text, np.zeros(WORD, np.uint8)))
    return np.ndarray(len(text) - WORD + 1, np.dtype("<u8"), text, strides=(1,))


class Round:
    """Part of the lexicon in the order of the triggers' rank, to be searched for in texts."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        _, self.text, first = next(_texts(rows.select(["trigger"]).to_batches(), "trigger", 1 << 62), (None, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.size, self.first = np.diff(first).astype(np.int32), first[:-1].astype(np.int32)
        self.at = rows.column("at").to_numpy()
        self.ranked = pa.table({"priority": rows.column("priority"), "label": rows.column("label").combine_chunks().dictionary_encode()})
        self.sizes = np.unique(_gram_size(self.size)).tolist()
        grams = rows.column("gram").to_numpy().view(np.uint64)
        self.order = np.argsort(grams, kind="stable").astype(np.int32)
        self.grams, start, count = np.unique(grams[self.order], return_index=True, return_counts=True)
        self.start, self.count = start.astype(np.int32), count.astype(np.int32)
        self.bits = _bits(len(rows), MARK_BITS)
        marks = np.zeros(1 << self.bits, np.uint8)
        marks[_cell(self.grams, self.bits)] = 1
        self.marks = np.packbits(marks)

    def held(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, row and number of each gram in the texts that some trigger is looked up by."""
        found = []
        for _, at, row, grams in _places(points, first, self.sizes) if self.sizes else ():
            cell = _cell(grams, self.bits)
            some = np.flatnonzero(self.marks[cell >> 3] & (np.uint8(128) >> (cell & 7).astype(np.uint8)))
            number = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
            same = self.grams[number] == grams[some]
            found.append((at[some[same]], row[some[same]], number[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def pairs(self, points: np.ndarray, first: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and rank of each trigger that a text contains, once each."""
        at, row, number = held
        words, end, found = _words(points), np.cumsum(self.count[number], dtype=np.int64), [np.zeros(0, np.int64)]
        portion, total = max(1, (1 << 28) // HOT_SHARE), int(end[-1]) if len(end) else 0
        for a in range(0, total, portion):
            pair = np.arange(a, min(a + portion, total))
            of = np.searchsorted(end, pair, side="right")
            trigger = self.order[self.start[number[of]] + pair - (end[of] - self.count[number[of]])]
            begin, line = at[of] - self.at[trigger], row[of]
            some = np.flatnonzero((begin >= first[line]) & (begin + self.size[trigger] <= first[line + 1]))
            some = some[self.alike(words, begin[some], trigger[some])]
            found.append(np.unique(line[some] * len(self.size) + trigger[some]))
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.size)))

    def alike(self, words: np.ndarray, begin: np.ndarray, trigger: np.ndarray) -> np.ndarray:
        """Which of these places hold their trigger, by every byte."""
        alike, size, done = np.ones(len(begin), bool), self.size[trigger], 0
        left = np.arange(len(begin))
        while len(left):
            # The last number overlaps with the one before it; of a trigger shorter than one only its own bytes count.
            here = np.clip(size[left] - WORD, 0, done)
            differ = words[begin[left] + here] ^ self.words[self.first[trigger[left]] + here]
            same = differ << (8 * np.maximum(WORD - size[left], 0)).astype(np.uint64) == 0
            alike[left[~same]] = False
            done += WORD
            left = left[same & (size[left] > done)]
        return alike

    @functools.cached_property
    def words(self) -> np.ndarray:
        return _words(self.text)

    @functools.cached_property
    def gram_of(self) -> np.ndarray:
        number = np.empty(len(self.size), np.int64)
        number[self.order] = np.repeat(np.arange(len(self.grams)), self.count)
        return number

    def found(self, ids: pa.Array, owner: np.ndarray, points: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """``__id, priority, trigger, label, n`` of the owners of texts with a trigger: the first of these and how many.
        Of texts with one owner each that contains a trigger counts once for each that holds its gram."""
        held = self.held(points, first)
        row, rank = self.pairs(points, first, held)
        own, times = owner[row], np.ones(len(row), np.int64)
        if len(ids) < len(owner):
            line, number = np.divmod(np.unique(held[1] * len(self.grams) + held[2]), len(self.grams))
            holds, lines = np.unique(owner[line] * len(self.grams) + number, return_counts=True)
            times = lines[np.searchsorted(holds, own * len(self.grams) + self.gram_of[rank])]
        order = np.lexsort((rank, own))
        new = np.flatnonzero(np.diff(own[order], prepend=-1))
        n = np.add.reduceat(times[order], new) if len(new) else new
        rank = rank[order][new]
        best = self.ranked.take(pa.array(rank)).combine_chunks()
        trigger = [self.text[a:a + n].tobytes().decode() for a, n in zip(self.first[rank], self.size[rank], strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own[order][new])), _array(best.column("priority")), pa.array(trigger, pa.string()),
                                           pc.cast(_array(best.column("label")), pa.string()), pa.array(n, pa.int64())],
                                          names=["__id", "priority", "trigger", "label", "n"])


def _array(x: pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if x.num_chunks != 1 else x.chunk(0)


def _sent(part: DataFrame) -> Broadcast:
    rows = part.orderBy(F.col("priority").asc_nulls_first(), "trigger").toArrow()  # ROUND_BYTES
    return part.sparkSession.sparkContext.broadcast(Round(rows))


def _search(sent: Broadcast) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, first in _texts(batches, "__text"):
            yield sent.value.found(batch.column("__id"), np.arange(batch.num_rows), points, first)

    return search


def _search_group(sent: Broadcast) -> Callable:
    """Texts of one id."""

    def search(rows: pa.Table) -> pa.Table:
        batch, points, first = next(_texts(rows.combine_chunks().to_batches(), "__text", 1 << 62))
        return pa.Table.from_batches([sent.value.found(batch.column("__id")[:1], np.zeros(batch.num_rows, np.int64), points, first)])

    return search


def match_lexicon(texts: DataFrame, lexicon: DataFrame, write: Write, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id_col, label, trigger, n_triggers`` for each row of ``texts``: the first of the
    triggers that its text contains, by ``priority`` (ties: the trigger in
    byte order), its label, and how many it contains; ``neutral``, null and 0 if
    none.

    ``lexicon`` has ``label, priority, trigger``. Text is lower-cased, triggers are taken
    as they are, as in ``rule_label``; null and empty triggers are left out, and of
    a trigger given twice the entry of lowest priority (then label) counts. Ids
    must be unique and not null. ``write(df, name)`` stores a table in the shared
    folder and reads it back.
    """
    own = texts.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col)).alias("__text"))
    entries = (lexicon.where("trigger <> ''").groupBy("trigger").agg(F.min(F.struct("priority", "label")).alias("best"))
               .select("trigger", "best.priority", "best.label"))
    entries = write(entries, "lexicon")
    largest = F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda x: x <= F.octet_length("trigger")))
    sizes = sorted(r.size for r in entries.select(largest.alias("size")).distinct().collect())  # as many as ``GRAMS`` at most
    if not sizes:
        return texts.select(F.col(id_col), F.lit("neutral").alias("label"), F.lit(None).cast("string").alias("trigger"),
                            F.lit(0).cast("long").alias("n_triggers"))
    n = entries.count()
    index = write(rarest_gram(entries, gram_counts(own, sizes, _bits(n, COUNT_BITS)), sizes), "trigger-index")
    size = index.agg(F.sum(F.octet_length("trigger") + 48).alias("bytes")).first()["bytes"] or 0
    rounds = -(-size // ROUND_BYTES)
    own = own.where(F.col("__id").isNotNull())
    repeated = own.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id")
    several = None if repeated.isEmpty() else write(repeated, "repeated-ids")
    once, several = (own, None) if several is None else (own.join(several, "__id", "left_anti"), own.join(several, "__id", "left_semi"))
    fields = {x.name: x for x in entries.schema.fields}
    schema = StructType([own.schema["__id"], fields["priority"], fields["trigger"], fields["label"], StructField("n", LongType())])
    found = texts.sparkSession.createDataFrame([], schema)
    for k in range(rounds):
        sent = _sent(index.where(F.pmod(F.xxhash64("trigger"), F.lit(rounds)) == k))
        found = found.union(write(once.mapInArrow(_search(sent), schema), "text-grams"))
        if several is not None:
            found = found.union(write(several.groupBy("__id").applyInArrow(_search_group(sent), schema), "text-grams"))
        sent.destroy()
    found = found.groupBy("__id").agg(F.min(F.struct("priority", "trigger", "label")).alias("first"), F.sum("n").alias("n"))
    return texts.select(F.col(id_col)).join(found, F.col(id_col) == F.col("__id"), "left").select(
        F.col(id_col), F.coalesce("first.label", F.lit("neutral")).alias("label"), F.col("first.trigger").alias("trigger"),
        F.coalesce("n", F.lit(0)).alias("n_triggers"))
