"""Removal of long byte strings that occur earlier in the corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or further left in the same document).

A suffix array of every position would take an integer a byte, many times the
compressed input on disk. The arrays here are sparse: of each ``LENGTH``-byte
string only the suffix at its anchor is indexed, the leftmost position of its
smallest ``GRAM``-byte hash. Equal strings have equal anchors, so none is
missed, and about one position in 32 is an anchor. Neighbouring strings with
the same anchor form one entry: a range of starts and the text they span.

Entries are dealt by anchor into shards. Each shard keeps a logarithmic family
of sorted arrays: a batch is sorted, merge-scanned against the levels, and
levels of like size are merged. Entries that equal an earlier entry are
repeats throughout. Anchors left with several different entries (where a match
begins or ends) are resolved string by string, in a second family dealt by the
hash of the strings themselves.

Entries and strings are compared by 96 bits of hashes, anchors by 32 bits
within a shard (where two meet, strings are compared in vain).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.llm.common import by_bytes, materialize, mix64, text_buffers
from stancekit.llm.shingles import run_hashes

LENGTH, GRAM = 100, 37
REACH = LENGTH - GRAM + 1  # starts of grams in a string
SEGMENT = 8 << 20  # longer texts are indexed in overlapping segments
SHARD_BYTES = 16 << 20  # text a shard
# An anchor with so many different entries in one slice is hot: its entries go
# to the second step at once, and a mark goes to the anchor's shard.
HOT = 64
SLICE = 2 << 20
REPEAT, OPEN, ENTRY, MARK = 0, 1, 2, 3


class LevelFamily:
    """Sorted arrays of distinct keys with their first place, in levels of
    geometrically growing size. Batches may come in any order of place."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Index a batch (``key, tag, doc, start, count``). Returns the
        ``doc, start, count`` of all rows now known to repeat an earlier one."""
        order = np.lexsort((rows["start"], rows["doc"], rows["tag"], rows["key"]))
        rows = {k: v[order] for k, v in rows.items()}
        same = np.zeros(len(order), bool)
        same[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["tag"][1:] == rows["tag"][:-1])
        repeats = [_places(rows, same & _moved(rows))]
        rows = {k: v[~same] for k, v in rows.items()}
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], rows["key"]), len(level["key"]) - 1)
            met = (level["key"][at] == rows["key"]) & (level["tag"][at] == rows["tag"])
            later = (rows["doc"] > level["doc"][at]) | ((rows["doc"] == level["doc"][at]) & (rows["start"] > level["start"][at]))
            earlier = (rows["doc"] < level["doc"][at]) | ((rows["doc"] == level["doc"][at]) & (rows["start"] < level["start"][at]))
            repeats.append(_places(rows, met & later))
            owner = at[met & earlier]
            repeats.append(_places(level, owner))
            for k in ("doc", "start", "count"):
                level[k][owner] = rows[k][met & earlier]
            rows = {k: v[~met] for k, v in rows.items()}
        if len(rows["key"]):
            self.levels.append(rows)
            while len(self.levels) > 1 and len(self.levels[-1]["key"]) * 2 > len(self.levels[-2]["key"]):
                b, a = self.levels.pop(), self.levels.pop()
                both = {k: np.concatenate((a[k], b[k])) for k in a}
                order = np.argsort(both["key"], kind="stable")  # two sorted runs: a merge
                self.levels.append({k: v[order] for k, v in both.items()})
        return [x for x in repeats if x.shape[1]]

    def rows(self) -> dict[str, np.ndarray]:
        if not self.levels:
            return {k: np.zeros(0, {"key": np.uint64, "tag": np.uint32}.get(k, np.int64)) for k in FIELDS}
        return {k: np.concatenate([x[k] for x in self.levels]) for k in FIELDS}


FIELDS = ("key", "tag", "doc", "start", "count")


def _places(rows: dict[str, np.ndarray], where: np.ndarray) -> np.ndarray:
    return np.stack([rows[k][where] for k in ("doc", "start", "count")])


def _moved(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Not the very place of the row before (rows of a repeated document)."""
    out = np.ones(len(rows["key"]), bool)
    out[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["start"][1:] != rows["start"][:-1])
    return out


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, ids and first positions of texts or their segments, in
    ascending order of id, a few megabytes at a time."""
    order = pa.compute.sort_indices(batch.column("doc_id"))
    batch = batch.take(order)
    data, offsets = text_buffers(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    long = np.flatnonzero(size > SEGMENT)
    short = np.flatnonzero((size <= SEGMENT) & (size >= LENGTH))
    if len(long) == 0:
        yield data, offsets, ids, np.zeros(len(ids), np.int64)
        return
    if len(short):
        parts = [data[offsets[i]:offsets[i + 1]] for i in short]
        yield np.concatenate(parts), np.concatenate(([0], np.cumsum(size[short]))), ids[short], np.zeros(len(short), np.int64)
    for i in long:
        for a in range(0, int(size[i]) - LENGTH + 1, SEGMENT):
            part = data[offsets[i] + a:min(offsets[i + 1], offsets[i] + a + SEGMENT + LENGTH - 1)]
            yield part, np.array([0, len(part)]), ids[i:i + 1], np.array([a])


def anchored_entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of texts: text number, first start (in its text), number of
    starts, hash of the anchor's gram, hash of the entry's text and anchor."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    gram = run_hashes(data, at, at + GRAM)
    low, place = gram, at.astype(np.int32)
    span = 1
    while span < REACH:  # minimum over 2, 4, ... REACH grams; the leftmost of equals
        right = low[span:] < low[:-span]
        low, place = np.where(right, low[span:], low[:-span]), np.where(right, place[span:], place[:-span])
        span *= 2
    anchor = place[:n]
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    ok = (np.arange(n) + LENGTH) <= offsets[doc[:n] + 1]
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[:n - 1])
    first = np.flatnonzero(begins)
    total = np.concatenate(([0], np.cumsum(ok)))
    count = np.diff(np.append(total[first], total[-1]))
    whole = run_hashes(data, first, first + count + LENGTH - 1)
    entry = mix64(whole + (anchor[first] - first).astype(np.uint64))
    return doc[first], first - offsets[doc[first]], count, gram[anchor[first]], entry


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers as differences, compressed; sorted columns take little room."""
    return pa.compress(b"".join(np.diff(x.astype(np.int64), prepend=0).tobytes() for x in arrays), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, columns: int) -> np.ndarray:
    raw = pa.decompress(blob, n * columns * 8, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64).reshape(columns, n), axis=1)


BLOBS = "shard long, kind int, n int, hashes binary, places binary"


def _blobs(shard: np.ndarray, kind: int, hashes: list[np.ndarray], places: list[np.ndarray], shards: int) -> list[dict]:
    """A row for each shard: its hashes as they are, its places packed."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    out = []
    for s in range(shards):
        at = order[ends[s - 1] if s else 0:ends[s]]
        if len(at):
            out.append({"shard": s, "kind": kind, "n": len(at), "hashes": b"".join(h[at].tobytes() for h in hashes),
                        "places": _pack(*(p[at] for p in places)) if places else b""})
    return out


def _to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("shard", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())]))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _aside(places: np.ndarray, kind: int, shards: int) -> list[dict]:
    """What needs no shard, given to any one."""
    if not places.shape[1]:
        return []
    return [{"shard": int(mix64(places[:2, :1].sum(0).astype(np.uint64))[0] % np.uint64(shards)), "kind": kind,
             "n": places.shape[1], "hashes": b"", "places": _pack(*places)}]


def _index_entries(shards: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            for data, offsets, ids, base in _segments(batch):
                doc, start, count, gram, entry = anchored_entries(data, offsets)
                if not len(doc):
                    continue
                places = np.stack((ids[doc], start + base[doc], count))
                order = np.lexsort((places[1], places[0], entry))
                same = np.zeros(len(doc), bool)
                same[1:] = entry[order[1:]] == entry[order[:-1]]
                new = np.ones(len(doc), bool)
                new[order[same]] = False
                again = np.sort(order[same & ~_same_place(places[0, order], places[1, order])])
                rows = _aside(places[:, again], REPEAT, shards)
                grams, of, n = np.unique(gram[new], return_inverse=True, return_counts=True)
                hot = n[of] >= HOT
                at = np.flatnonzero(new)
                rows += _aside(places[:, at[hot]], OPEN, shards)
                if (n >= HOT).any():
                    marks = grams[n >= HOT]
                    rows += _blobs(_shard_of(marks, shards), MARK, [marks.astype(np.uint32)], [], shards)
                at = at[~hot]
                rows += _blobs(_shard_of(gram[at], shards), ENTRY, [entry[at], gram[at].astype(np.uint32)], list(places[:, at]), shards)
                yield _to_batch(rows)

    return index


PLACES = "kind int, doc_id long, start long, count long"


def _as_rows(kind: int, places: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate(places, axis=1) if places else np.zeros((3, 0), np.int64)
    return pd.DataFrame({"kind": np.full(both.shape[1], kind, np.int32), "doc_id": both[0], "start": both[1], "count": both[2]})


def _scan(rows: pd.DataFrame, by_entry: bool) -> pd.DataFrame:
    """One shard: repeats, and with ``by_entry`` the entries left open."""
    family, repeats, open_, marks = LevelFamily(), [], [], []
    for kind, n, hashes, places in zip(rows["kind"], rows["n"], rows["hashes"], rows["places"], strict=True):
        if kind == MARK:
            marks.append(np.frombuffer(hashes, np.uint32))
        elif kind == ENTRY:
            key, tag = np.frombuffer(hashes, np.uint64, n), np.frombuffer(hashes, np.uint32, n, 8 * n)
            doc, start, count = _unpack(places, n, 3)
            repeats += family.add({"key": key, "tag": tag, "doc": doc, "start": start, "count": count})
        else:
            (open_ if kind == OPEN else repeats).append(_unpack(places, n, 3))
    if by_entry:
        left = family.rows()
        grams, of, n = np.unique(left["tag"], return_inverse=True, return_counts=True)
        many = n > 1
        if marks:
            many |= np.isin(grams, np.concatenate(marks))
        open_.append(_places(left, many[of]) if len(of) else np.zeros((3, 0), np.int64))
    return pd.concat([_as_rows(REPEAT, repeats), _as_rows(OPEN, open_)])


def _index_strings(shards: int):
    """Every string of the open entries of a document, by its hash."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            batch = batch.take(pa.compute.sort_indices(batch.column("doc_id")))
            data, offsets = text_buffers(batch.column("text"))
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column("starts")).to_numpy())
            start = batch.column("starts").flatten().to_numpy()
            count = batch.column("counts").flatten().to_numpy()
            fits = offsets[of] + start + count + LENGTH - 1 <= offsets[of + 1]  # else of another row of this id
            of, start, count = of[fits], start[fits], count[fits]
            if not len(of):
                continue
            row = np.repeat(np.arange(len(of)), count)
            q = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            doc = of[row]
            at = offsets[doc] + q
            key = run_hashes(data, at, at + LENGTH)
            # A second polynomial: of bytes in another coding.
            tag = run_hashes(_OTHER_CODE[data], at, at + LENGTH).astype(np.uint32)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((q, ids, tag, key))
            same = np.zeros(len(order), bool)
            same[1:] = (key[order[1:]] == key[order[:-1]]) & (tag[order[1:]] == tag[order[:-1]])
            new = order[~same]
            again = order[same & ~_same_place(ids[order], q[order])]
            new.sort()
            again.sort()
            rows = _aside(_runs(ids[again], q[again]), REPEAT, shards)
            places = [ids[new], q[new], np.ones(len(new), np.int64)]
            rows += _blobs(_shard_of(key[new], shards), ENTRY, [key[new], tag[new]], places, shards)
            yield _to_batch(rows)

    return index


_OTHER_CODE = (np.arange(256, dtype=np.uint32) * 167 + 13).astype(np.uint8)


def _same_place(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), bool)
    out[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    return out


def _runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Consecutive starts as ``doc, start, count``."""
    if not len(doc):
        return np.zeros((3, 0), np.int64)
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(cut)
    return np.stack((doc[first], start[first], np.diff(np.append(first, len(doc)))))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``doc_id, start, count``: starts of strings that also start earlier.
    ``docs`` has ``doc_id`` and ``text``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(1, -(-size // SHARD_BYTES)))
    found = (docs.mapInArrow(_index_entries(shards), BLOBS).groupBy("shard")
             .applyInPandas(lambda rows: _scan(rows, True), PLACES))
    found = materialize(found, "entries")
    by_doc = found.where(F.col("kind") == OPEN).groupBy("doc_id").agg(
        F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    strings = (docs.join(by_doc, "doc_id").mapInArrow(_index_strings(shards), BLOBS).groupBy("shard")
               .applyInPandas(lambda rows: _merged(_scan(rows, False)), PLACES))
    strings = materialize(strings, "strings")
    return found.where(F.col("kind") == REPEAT).union(strings).select("doc_id", "start", "count")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    one = rows["count"] == 1
    runs = _runs(rows["doc_id"][one].to_numpy(), rows["start"][one].to_numpy())
    return pd.concat([rows[~one], _as_rows(REPEAT, [runs])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans`` (maximal removed runs of
    bytes: start, length) and ``kept`` (the remaining bytes).

    A null text counts as empty. Texts below the length lose nothing. A row
    without id is indexed nowhere and loses nothing. Rows that share an id are
    one document: what one of them loses at a place, all lose there. Other
    columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = repeated_starts(docs.where("doc_id is not null")).groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    rows = docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left").drop("gone_id")
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            data, offsets = text_buffers(batch.column("text"))
            spans, kept = [], []
            starts, counts = batch.column("starts"), batch.column("counts")
            for i in range(batch.num_rows):
                own = data[offsets[i]:offsets[i + 1]]
                found = []
                if starts[i].is_valid:
                    edge = np.zeros(len(own) + 1, np.int32)
                    a = np.minimum(starts[i].values.to_numpy(), len(own))
                    b = np.minimum(a + counts[i].values.to_numpy() + LENGTH - 1, len(own))
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], out, [False]))))
                    found = [{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                    own = own[~out]
                spans.append(found)
                kept.append(own.tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, span),
                                   pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(cut, schema)
