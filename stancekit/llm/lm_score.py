"""Language-model scores of whole documents.

One pass turns the documents into slices: a few megabytes of texts each, as
codes into the slice's own dictionary of word hashes. The dictionaries go,
split by hash range, to shards that add up every word's exact count over all
training documents and send each slice its counts back; so no table of the
whole vocabulary exists anywhere. The most frequent words, a fixed number, are
the vocabulary of the recurrent model (``gru``); the model spells a rarer word
as "rare" times the word's smoothed share of all rare training words.

The model is fitted on the driver on a bounded sample of training documents
(whole ones, ``SAMPLE_SLICES`` slices, ``SAMPLE_TOKENS`` tokens), then improved
in one round over the whole corpus: every slice trains its own copy on all its
training documents, and the copies are averaged by their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm import gru
from stancekit.llm.common import by_bytes, materialize, released, text_buffers
from stancekit.llm.shingles import word_hashes

VOCABULARY = gru.SIDE * gru.SIDE - 2
SLICE = 4 << 20
SHARD_BYTES = 32 << 20
SAMPLE_SLICES, SAMPLE_TOKENS = 64, 300_000
SCORED = 8 << 20  # bytes of codes scored at a time, at least
PARTS = 16
SALTS = 64  # groups in which the tasks' changes are added up first
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

SLICES = "slice long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, codes binary, keys binary, counts binary"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True) if len(x) else b""


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd"), kind) if n else np.zeros(0, kind)


def _slices(docs: DataFrame) -> DataFrame:
    """Code 0 ends a document, code i + 1 is word i of the slice's ascending
    keys; ``counts`` are those of the slice's training documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in by_bytes(batches, "text", SLICE):
            words, first = word_hashes(*text_buffers(batch.column("text")), _IS_WORD)
            keys, code = np.unique(words, return_inverse=True)
            codes = np.insert(code.astype(np.uint32) + 1, first[1:], 0)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learned = np.repeat(~held, np.diff(first))
            counts = np.bincount(code[learned], minlength=len(keys)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{
                "slice": number, "doc_id": batch.column("doc_id").to_pylist(), "held_out": held.tolist(),
                "n_tokens": (np.diff(first) + 1).tolist(), "codes": _pack(codes), "keys": keys.tobytes(),
                "counts": _pack(counts)}], schema=pa.schema([
                    ("slice", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                    ("n_tokens", pa.list_(pa.int64())), ("codes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]))
            number += 1

    return docs.mapInArrow(released(cut), SLICES)


def _count_words(slices: DataFrame, shards: int) -> DataFrame:
    """Rows of kind ``reply`` (a slice's counts of the words of one shard),
    ``sum`` (a shard's tokens and distinct words) and ``top`` (its most
    frequent words)."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint64)
                counts = _unpack(row["counts"], len(keys), np.uint32)
                ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                yield pa.RecordBatch.from_pylist([
                    {"shard": s, "slice": row["slice"], "n": b - a, "keys": keys[a:b].tobytes(), "counts": _pack(counts[a:b])}
                    for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))], schema=pa.schema([
                        ("shard", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]])
        own = np.concatenate([_unpack(c, n, np.uint32) for c, n in zip(rows["counts"], rows["n"], strict=True)])
        words, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, own, minlength=len(words)).astype(np.int64)
        back = np.split(total[of].astype(np.uint64), np.cumsum(rows["n"].to_numpy())[:-1])
        replies = pd.DataFrame({"kind": "reply", "shard": rows["shard"], "slice": rows["slice"], "word": 0, "n": rows["n"],
                                "counts": [_pack(c) for c in back]})
        known = total > 0
        sums = pd.DataFrame({"kind": ["sum"], "shard": rows["shard"].iloc[:1], "slice": 0, "word": int(known.sum()),
                             "n": int(total.sum()), "counts": b""})
        best = np.lexsort((words, -total))[:VOCABULARY]
        best = best[known[best]]
        top = pd.DataFrame({"kind": "top", "shard": rows["shard"].iloc[0], "slice": 0, "word": words[best].view(np.int64),
                            "n": total[best], "counts": b""})
        return pd.concat([replies, sums, top], ignore_index=True)

    asked = slices.select("slice", "keys", "counts").mapInArrow(ask, "shard int, slice long, n long, keys binary, counts binary")
    return asked.groupBy("shard").applyInPandas(answer, "kind string, shard int, slice long, word long, n long, counts binary")


class Vocabulary:
    """Model ids of the frequent words: by key, without strings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32) + 2
        self.counts = counts

    def codes_to_ids(self, keys: np.ndarray) -> np.ndarray:
        """Model id of each code of a slice."""
        ids = np.full(len(keys) + 1, gru.RARE, np.int32)
        ids[0] = gru.END
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            ids[1:][hit] = self.ids[at[hit]]
        return ids


def _documents(row: dict, words: Vocabulary) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Model ids of each document of a slice; its codes; its keys."""
    keys = np.frombuffer(row["keys"], np.uint64)
    sizes = np.asarray(row["n_tokens"], np.int64)
    codes = _unpack(row["codes"], int(sizes.sum()), np.uint32)
    return np.split(words.codes_to_ids(keys)[codes], np.cumsum(sizes)[:-1]), codes, keys


def sample(docs: list[np.ndarray], seed: int, quota: int) -> list[np.ndarray]:
    """Whole documents of at most ``quota`` tokens together, in a drawn order;
    if none is so short, the shortest one."""
    out, left = [], quota
    for i in np.random.default_rng(seed & 0xFFFFFFFF).permutation(len(docs)):
        if len(docs[i]) <= left:
            out.append(docs[i])
            left -= len(docs[i])
    return out or [d for d in sorted(docs, key=len)[:1] if len(d) <= SAMPLE_TOKENS]


def fit(slices: DataFrame, words: Vocabulary, start: np.ndarray) -> dict[str, np.ndarray]:
    """The sampled fit and the round of averaging."""
    chosen = [r[0] for r in slices.select("slice").orderBy(F.xxhash64("slice"), "slice").limit(SAMPLE_SLICES).collect()]
    quota = SAMPLE_TOKENS // max(1, len(chosen))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, _, _ = _documents(row, words)
                out = [d.tobytes() for d in sample([d for d, held in zip(docs, row["held_out"], strict=True) if not held],
                                                   row["slice"], quota)]
                yield pa.record_batch([pa.array([row["slice"]] * len(out), pa.int64()), pa.array(out, pa.binary())],
                                      names=["slice", "ids"])

    got = slices.where(F.col("slice").isin(chosen)).mapInArrow(draw, "slice long, ids binary").collect()
    docs, left = [], SAMPLE_TOKENS
    for d in (np.frombuffer(r["ids"], np.int32) for r in sorted(got)):
        if len(d) <= left:
            docs.append(d)
            left -= len(d)
    params = gru.train(gru.initial(start), docs, epochs=3, rate=0.01)
    names = sorted(params)
    flat = np.concatenate([params[k].ravel() for k in names])
    step = -(-len(flat) // PARTS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(flat)), 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs, _, _ = _documents(row, words)
                docs = [d for d, held in zip(docs, row["held_out"], strict=True) if not held]
                if docs:
                    own = gru.train(params, docs, epochs=1, rate=0.002, lanes=128)
                    own = np.concatenate([own[k].ravel() for k in names]) - flat
                    tokens = float(sum(map(len, docs)))
                    total += tokens * own
                    weight += tokens
        if weight:
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()),
                                   pa.array([weight] * PARTS),
                                   pa.array([total[i * step:(i + 1) * step].tobytes() for i in range(PARTS)], pa.binary())],
                                  names=["part", "task", "weight", "change"])

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        total = sum(np.frombuffer(c, np.float64) for c in rows["change"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "task": rows["task"].iloc[:1], "weight": [rows["weight"].sum()],
                             "change": [total.tobytes()]})

    kind = "part int, task int, weight double, change binary"
    # One sum a task; the sums meet in SALTS groups of each part first, then in one.
    moved = (slices.select("slice", "held_out", "n_tokens", "codes", "keys").mapInArrow(released(local), kind)
             .groupBy("part", F.col("task") % SALTS).applyInPandas(add_up, kind)
             .groupBy("part").applyInPandas(add_up, kind).collect())
    for r in moved:
        change = (np.frombuffer(r["change"], np.float64) / r["weight"]).astype(np.float32)
        flat[r["part"] * step:r["part"] * step + len(change)] += change
    ends = np.cumsum([params[k].size for k in names])
    return {k: x.reshape(params[k].shape) for k, x in zip(names, np.split(flat, ends[:-1]), strict=True)}


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score`` (add-one unigram) and ``score`` (the model), both
    log10 of the whole text's probability, its end included.

    Words are maximal runs of anything but ASCII white space, A-Z in lower case.
    A null text counts as empty (its end alone). A null in ``held_out`` counts
    as held out. Repeated rows are counted and returned as often as they occur;
    with no training rows every word is unseen. Other columns are not read; an
    empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(held_out, F.lit(True)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    shards = int(max(1, -(-(size["bytes"] or 0) // SHARD_BYTES)))
    slices = materialize(_slices(docs), "slices")
    counted = materialize(_count_words(slices, shards), "counts")
    sums = counted.where("kind = 'sum'").agg(F.sum("n").alias("n"), F.sum("word").alias("v")).first()
    n, v = (sums["n"] or 0) + size["train"], (sums["v"] or 0) + (size["train"] > 0)
    top = counted.where("kind = 'top'").orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word", "n").collect()
    keys = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in top], np.int64)
    words = Vocabulary(keys, counts)
    rare = int(n - size["train"] - counts.sum())
    params = fit(slices, words, np.concatenate(([size["train"], rare], counts)))
    per_rare = rare + int(v - (size["train"] > 0) - len(counts)) + 1
    per_base, ends = float(n + v + 1), size["train"]

    replies = counted.where("kind = 'reply'").groupBy(F.col("slice").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("shard", "n", "counts"))).alias("replies"))
    rows = slices.drop("counts").join(replies, F.col("slice") == F.col("of")).drop("of")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, texts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs, codes, _ = _documents(row, words)
                c = np.concatenate([np.array([ends], np.uint64)] + [_unpack(r["counts"], r["n"], np.uint64) for r in row["replies"]])
                of = np.repeat(np.arange(len(docs)), row["n_tokens"])
                seen = c[codes]
                base = np.bincount(of, np.log10((seen + 1.0) / per_base), minlength=len(docs))
                known = np.bincount(of[seen > 0], minlength=len(docs))
                is_rare = np.concatenate(docs) == gru.RARE
                spelled = np.bincount(of[is_rare], np.log10((seen[is_rare] + 1.0) / per_rare), minlength=len(docs))
                done.append(pa.record_batch([
                    pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(row["n_tokens"], pa.int64()),
                    pa.array(known, pa.int64()), pa.array([n] * len(docs), pa.int64()), pa.array(base), pa.array(spelled)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
                texts += docs
                size += codes.nbytes
                if size >= SCORED:
                    yield modelled(done, texts)
                    done, texts, size = [], [], 0
        if done:
            yield modelled(done, texts)

    def modelled(done: list[pa.RecordBatch], texts: list[np.ndarray]) -> pa.RecordBatch:
        """Slices are scored together, so that the steps in which only their longest
        documents are left are taken once."""
        rows = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        full = gru.log_probs(params, texts) / np.log(10) + rows.column("score").to_numpy()
        return rows.set_column(rows.num_columns - 1, "score", pa.array(full))

    return rows.mapInArrow(released(score), schema)
