"""Near-duplicate classes by consistent weighted sampling (ICWS).

Documents are weighted sets of five-word shingles. A shingle's weight is its
frequency in the document times the mean inverse document frequency of its
words. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples a
document; two documents agree in a sample with a probability equal to their
weighted Jaccard similarity. Samples are banded, documents that share a band
are candidates, and candidates are verified by exact weighted Jaccard.

Word frequencies are counted over all documents in ``2 ** DF_BITS`` hashed
cells, so the table that every task gets has a fixed size whatever the corpus.
(A shingle's own document frequency would need a shuffle of every shingle of
the corpus, and would let a large group of copies make its own text worthless.
For the same reason the frequencies are scaled to lie between 1 and 2: unscaled,
the few words that near copies of a large group differ in would outweigh all
that they share.)

Exact copies are collapsed first. In each of ``LEADERS`` rounds a bucket's members
are compared with one of them, drawn anew, if they are not in its class yet;
members of a bucket that then still lie in different classes are compared with
each other if they meet in one of the rarest shingles that they share with any
such text, where all pairs of the threshold do. No pair is compared whose sketches (some bits of every sample)
agree too seldom for the threshold, by ``SLACK`` standard errors. So a group of near copies costs work in proportion to its size, and
no link between classes is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.llm.common import by_bytes, components, materialize, mix64, released, row_key, text_buffers
from stancekit.llm.shingles import shingle_hashes, word_hashes

BANDS, ROWS = 16, 4
LEADERS = 2
DF_BITS = 18
DF_CHUNK = 1 << 14
SLOTS = 1 << 15  # rows of the tables of random variates
SHINGLES_AT_ONCE = 4096
PLANES = 8  # bits kept of each sample; different samples agree in all of them once in 256
SLACK = 4.5  # standard errors below the threshold at which a pair's agreement still counts


def count_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which the words of each hashed cell occur, and the number
    of documents: one pass, a bounded table from each task."""
    cells = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(cells, np.int64), 0
        for batch in by_bytes(batches, "text"):
            words, first = word_hashes(*text_buffers(batch.column("text")))
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(first))
            seen = np.unique((doc << np.uint64(DF_BITS)) | (words >> np.uint64(64 - DF_BITS)))
            total += np.bincount((seen & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
            n += batch.num_rows
        if n:
            parts = [zlib.compress(total[a:a + DF_CHUNK].tobytes(), 1) for a in range(0, cells, DF_CHUNK)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()),
                                   pa.array([n] + [0] * (len(parts) - 1), pa.int64())], names=["chunk", "counts", "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DF_CHUNK, np.int64)
        for part in rows["counts"]:
            total += np.frombuffer(zlib.decompress(part), np.int64)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1].to_numpy(), "counts": [total.tobytes()], "n": [rows["n"].sum()]})

    schema = "chunk int, counts binary, n long"
    rows = docs.select("text").mapInArrow(released(count), schema).groupBy("chunk").applyInPandas(add, schema).collect()
    table = np.zeros(cells, np.int64)
    for r in rows:
        table[r["chunk"] * DF_CHUNK:(r["chunk"] + 1) * DF_CHUNK] = np.frombuffer(r["counts"], np.int64)
    return table, sum(r["n"] for r in rows)


def idf_table(counts: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency, scaled to lie between 1 (in every
    document) and 2 (in none)."""
    return (1 + np.log((1 + n) / (1 + np.minimum(counts, n))) / np.log(2 + n)).astype(np.float32)


def weighted_shingles(words: np.ndarray, idf: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, ascending, and their weights."""
    keys, first, tf = np.unique(shingle_hashes(words, n), return_index=True, return_counts=True)
    if not len(keys):
        return keys, np.zeros(0)
    n = min(n, len(words))
    run = np.concatenate(([0.0], np.cumsum(idf[(words >> np.uint64(64 - DF_BITS)).astype(np.int64)], dtype=np.float64)))
    # Rounded, so that equal shingles weigh the same wherever the sum began.
    mean = np.round((run[first + n] - run[first]) / n, 6)
    return keys, tf * mean


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


class Icws:
    """Improved consistent weighted sampling with tabulated variates: a
    shingle's variates are those of one of ``SLOTS`` rows; a sample is the
    shingle itself with its level, so rows that meet make no false match."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        r = rng.gamma(2, 1, (SLOTS, samples))
        c = rng.gamma(2, 1, (SLOTS, samples))
        self.beta = rng.random((SLOTS, samples)).astype(np.float32)
        self.r, self.per_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = (np.log(c) - r).astype(np.float32)
        self.samples = samples

    def sample(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One hash for each sample of a non-empty weighted set."""
        best, out = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        cols = np.arange(self.samples)
        for a in range(0, len(keys), SHINGLES_AT_ONCE):
            k = keys[a:a + SHINGLES_AT_ONCE]
            slot = (k & np.uint64(SLOTS - 1)).astype(np.int64)
            level = np.floor(np.log(weights[a:a + len(k), None]).astype(np.float32) * self.per_r[slot] + self.beta[slot])
            value = self.log_c[slot] - self.r[slot] * (level - self.beta[slot])
            at = value.argmin(0)
            low = value[at, cols]
            new = low < best
            best = np.where(new, low, best)
            drawn = mix64(k[at] + level[at, cols].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out = np.where(new, drawn, out)
        return out


def _signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    schema = "doc_id long, h1 long, h2 long, bands array<long>, sketch array<long>"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        icws, base = Icws(BANDS * ROWS), np.uint64(0x9E3779B97F4A7C15)
        for batch in by_bytes(batches, "text"):
            words, first = word_hashes(*text_buffers(batch.column("text")))
            bands, has = np.zeros((batch.num_rows, BANDS), np.uint64), np.diff(first) > 0
            planes = np.zeros((batch.num_rows, PLANES), np.uint64)
            for i in np.flatnonzero(has):
                keys, weights = weighted_shingles(words[first[i]:first[i + 1]], idf)
                drawn = icws.sample(keys, weights)
                planes[i] = _bit_planes(drawn)
                drawn = drawn.reshape(BANDS, ROWS)
                for j in range(ROWS):
                    bands[i] = mix64(bands[i] * base + drawn[:, j])
            size = np.where(has, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()),
                                             pa.array(bands[has].view(np.int64).ravel()))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * PLANES, pa.int32()), pa.array(planes.view(np.int64).ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), lists, sketch],
                                  names=["doc_id", "h1", "h2", "bands", "sketch"])

    return rows.mapInArrow(released(sign), schema)


def _bit_planes(drawn: np.ndarray) -> np.ndarray:
    """The low bits of all samples: plane ``b`` has bit ``b`` of each, so that equal
    samples are told by a few operations on whole words."""
    bits = (drawn >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.bitwise_or.reduce(bits << np.arange(len(drawn), dtype=np.uint64), axis=1)


def _may_agree(one: str, two: str, threshold: float) -> Column:
    """Whether two sketches agree in as many samples as a pair of this
    similarity has, less ``SLACK`` standard errors (fewer than 3 of 100,000 such
    pairs have less)."""
    n = BANDS * ROWS
    least = n * threshold - SLACK * (n * threshold * (1 - threshold)) ** 0.5
    differ = reduce(Column.bitwiseOR, [F.get(one, F.lit(i)).bitwiseXOR(F.get(two, F.lit(i))) for i in range(PLANES)])
    return n - F.bit_count(differ) >= least


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of at least ``threshold``, with ``similarity``."""
    rows = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in by_bytes(batches, "tb"):
            words, first = word_hashes(*text_buffers(batch.column("tb")))
            ids, left = batch.column("a").to_pylist(), batch.column("ta")
            keep, score = [], []
            for i, a in enumerate(ids):
                if a != last:  # the join leaves a document's pairs together
                    own, _ = word_hashes(*text_buffers(left.slice(i, 1)))
                    last, held = a, weighted_shingles(own, idf)
                j = weighted_jaccard(held, weighted_shingles(words[first[i]:first[i + 1]], idf))
                if j >= threshold:
                    keep.append(i)
                    score.append(j)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at), pa.array(score, pa.float64())],
                                  names=["a", "b", "similarity"])

    return rows.mapInArrow(released(check), "a long, b long, similarity double")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _led_pairs(placed: DataFrame, r: int, threshold: float) -> DataFrame:
    """Each bucket's members with one of them, first the smallest, then one drawn
    at random, as far as they are of another class: as many pairs as members."""
    drawn = F.struct((F.xxhash64(F.lit(r), "band", "id") if r else F.col("id")).alias("h"), F.col("id").alias("lead"),
                     F.col("part").alias("lead_part"), F.col("sketch").alias("lead_sketch"))
    led = placed.groupBy("band", "key").agg(F.min(drawn).alias("m")).select("band", "key", "m.lead", "m.lead_part", "m.lead_sketch")
    near = (F.col("part") != F.col("lead_part")) & _may_agree("sketch", "lead_sketch", threshold)
    return placed.join(led, ["band", "key"]).where(near).select(*_pair("id", "lead")).distinct()


def _split_buckets(placed: DataFrame) -> DataFrame:
    split = placed.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return placed.join(split.select("band", "key"), ["band", "key"], "left_semi")


def _shingle_rows(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``id, shingle, weight``: the weighted shingles of every text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            words, first = word_hashes(*text_buffers(batch.column("text")))
            parts = [weighted_shingles(words[a:b], idf) for a, b in zip(first[:-1], first[1:], strict=True)]
            of = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
            yield pa.record_batch([batch.column("doc_id").take(pa.array(of)), pa.array(np.concatenate([k for k, _ in parts]).view(np.int64)),
                                   pa.array(np.concatenate([w for _, w in parts]).astype(np.float64))], names=["id", "shingle", "weight"])

    return texts.select("doc_id", "text").mapInArrow(released(explode), "id long, shingle long, weight double")


def _rare_shingles(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``id, shingle, rest, total``: the rarest shingles of each text that others of
    the texts have too, as far as a partner may be found by them.

    All texts' shingles are put in one order, rare ones first. Two sets share no more
    than what either weighs from their first common shingle on (``rest``), so that one
    lies where ``rest`` is still ``threshold`` of the set's weight (``total``)."""
    rows = _shingle_rows(texts, idf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    ordered = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"rest": F.sum("weight").over(ordered) + 1e-6, "total": F.sum("weight").over(Window.partitionBy("id"))})
    return rows.where((F.col("n") > 1) & (F.col("rest") >= threshold * F.col("total"))).select("id", "shingle", "rest", "total")


def _open_pairs(placed: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs of different classes of the buckets that still hold several, but
    for those that cannot reach the threshold: they meet in the rarest shingles that
    they share, not in the buckets, where copies of a template that differ too much
    from each other would be compared pair by pair."""
    left = materialize(_split_buckets(placed), "split-buckets")
    own = left.groupBy("id").agg(F.first("part").alias("part"), F.first("sketch").alias("sketch"),
                                 F.collect_set(F.struct("band", "key")).alias("buckets"))
    own = materialize(own, "open")
    rare = _rare_shingles(texts.join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), idf, threshold)
    rare = materialize(rare.join(own, "id"), "rare-shingles")
    other = rare.select("shingle", *[F.col(c).alias(f"other_{c}") for c in rare.columns if c != "shingle"])
    least = threshold / (1 + threshold) * (F.col("total") + F.col("other_total"))
    return (rare.join(other, "shingle")
            .where((F.col("id") < F.col("other_id")) & (F.col("part") != F.col("other_part"))
                   & (F.least("rest", "other_rest") >= least) & _may_agree("sketch", "other_sketch", threshold)
                   & F.arrays_overlap("buckets", "other_buckets"))
            .select(*_pair("id", "other_id")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, class_id, kept``; ``class_id`` is the
    smallest id of the documents linked to it, directly or through others, by
    a similarity of at least ``threshold`` over five-word shingles.

    Texts of one to four words are one shingle. A null text counts as empty;
    empty texts are copies of each other, texts without words are linked with
    exact copies only. Rows that share an id are one document and share their
    fate. A row without id is kept, whatever its text. Other columns are not
    read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf = idf_table(*count_words(docs))
    signed = materialize(_signatures(docs, idf), "signatures")
    reps = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
                                             F.first("sketch").alias("sketch"))
    reps = materialize(reps.where("rep is not null"), "representatives")

    members = reps.select(F.col("rep").alias("id"), "sketch", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    buckets = materialize(members.join(shared, ["band", "key"], "left_semi"), "buckets")
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")
    texts = materialize(texts.dropDuplicates(["doc_id"]), "candidate-texts")

    links = tested = label = None
    for r in range(LEADERS + 1):
        placed = buckets if label is None else buckets.join(label, "id", "left")
        part = F.col("id") if label is None else F.coalesce("component_id", "id")
        placed = placed.select("band", "key", "id", "sketch", part.alias("part"))
        pairs = _led_pairs(placed, r, threshold) if r < LEADERS else _open_pairs(placed, texts, idf, threshold)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(_verify(pairs, texts, idf, threshold).select("a", "b"), "links")
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        label = materialize(components(links), "classes")

    rep_of = reps.select("h1", "h2", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component_id", "rep").alias("class_id"))
    return signed.select("doc_id", "h1", "h2").join(rep_of, ["h1", "h2"], "left").select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest-id document of each class; all columns. Rows
    of different texts that share an id are documents of their own here, after
    those of ids below 2**62."""
    row = row_key(id_col, text_col)
    shared = docs.where(F.col(id_col).isNotNull()).select(row["id"].alias("id"), row["a"].alias("a"), row["b"].alias("b")).groupBy("id").agg(
        F.min("a").alias("a"), F.max("a").alias("c"), F.min("b").alias("b"), F.max("b").alias("d")).where("a <> c or b <> d")
    shared = materialize(shared.select(F.col("id").alias("__shared")), "shared-ids")
    own = docs
    if not shared.isEmpty():
        number = F.shiftrightunsigned(F.xxhash64(row), 2).bitwiseOR(F.lit(1 << 62))
        own = docs.join(shared, docs[id_col] == F.col("__shared"), "left").withColumn(
            "__own", F.when(F.col("__shared").isNull(), F.col(id_col).cast("long")).otherwise(number)).drop("__shared")
    key = "__own" if "__own" in own.columns else id_col
    gone = near_duplicates(own, threshold, key, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return own.join(gone, own[key] == F.col("__gone"), "left_anti").drop("__own")
