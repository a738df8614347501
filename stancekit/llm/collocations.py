"""Phrases whose words keep together, by exact counts of n-grams.

Frequent n-grams are found level by level: an n-gram can be frequent only if
its first and its last n-1 words are. Each block of text packs an n-gram as the
number of its first n-1 words (given out at the level before) and the number
of its last word, counts it in a counting quotient filter, and sends the parts
of the filter to shards of the permuted integers. A shard merges the sorted
filters of all blocks, numbers the entries that are frequent over all, and
tells each block which of its own those are.

Counts are exact: the packing is lossless, and filters are merged whole. What
a block keeps from level to level are only positions that may still begin a
frequent n-gram. No table of words or n-grams is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancekit.llm import quotient_filter as Q
from stancekit.llm.common import materialize, released, text_buffers
from stancekit.llm.shingles import run_hashes
from stancekit.llm.words import Words, byte_classes, slices

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20  # text whose words go to one shard
SHARD_ENTRIES = 1 << 20
_PIECES = byte_classes(" \t", ".,;:!?\n\x0b\x0c\r")

STATE, ENTRIES, HIT, FREQUENT, TOTAL = range(5)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integers of 0 and up, each array in as few bytes a number as it needs."""
    parts = []
    for x in arrays:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or int(x.max()) <= np.iinfo(k).max)
        parts.append(bytes([np.dtype(kind).itemsize]) + len(x).to_bytes(8, "little") + x.astype(kind).tobytes())
    body = b"".join(parts)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _expand(blob: bytes) -> list[np.ndarray]:
    body, at, out = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), 0, []
    while at < len(body):
        width, n = body[at], int.from_bytes(body[at + 1:at + 9], "little")
        out.append(np.frombuffer(body, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


SENT = "kind int, block long, shard long, first int, blob binary, words binary"
_SENT = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("first", pa.int32()), ("blob", pa.binary()), ("words", pa.binary())])
COUNTED = "kind int, block long, blob binary, id long, first long, last long, n long, lang string, word string"


def _sent(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SENT)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shards that occur, each with the range of its entries; ascending."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(shard[a]), a, b


def _count_words(block_bytes: int, shards: int):
    """For each block, its word occurrences (a position that leaps between
    pieces, and the word as a number of the block), and for each shard of the
    words' hashes those of its words that go there, with their counts. A word
    is told apart by its language: ``language, tab, word``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, rows in enumerate(slices(batches, "text", block_bytes)):
            words = Words(rows.column("text"), _PIECES, lower=True)
            if not len(words):
                continue
            langs = rows.column("lang").combine_chunks().dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(words.first))
            number, distinct = words.numbers()
            number += of.astype(np.int64) * len(distinct)
            n = np.bincount(number, minlength=len(distinct) * len(langs.dictionary))
            used = np.flatnonzero(n)
            names = pc.binary_join_element_wise(langs.dictionary.take(pa.array(used // len(distinct))).cast(pa.large_string()),
                                                distinct.take(pa.array(used % len(distinct))), pa.scalar("\t", pa.large_string()))
            data, offsets = text_buffers(names)
            shard = (run_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((pc.rank(names).to_numpy(), shard))
            index = np.zeros(len(n), np.int64)
            index[used[order]] = np.arange(len(order))
            out = [(STATE, task + i, None, 0, _squeeze(np.diff(np.arange(len(words)) + words.piece, prepend=0), index[number]), None)]
            names, total, shard = names.take(pa.array(order)), n[used[order]], shard[order]
            for s, a, b in _by_shard(shard):
                data, offsets = text_buffers(names.slice(a, b - a))
                out.append((ENTRIES, task + i, s, a, _squeeze(np.diff(offsets), total[a:b]), pa.compress(data, "zstd", asbytes=True)))
            yield from _sent(out).to_batches()

    return released(count)


def _merge_words(shards: int, min_count: int):
    """One shard of words: the frequent ones over all blocks with their numbers,
    all occurrences by language, and for each block which words are frequent."""

    def merge(rows: pa.Table) -> pa.Table:
        names, counts = [], []
        for blob, words in zip(rows.column("blob"), rows.column("words"), strict=True):
            size, total = _expand(blob.as_py())
            offsets = np.concatenate(([0], np.cumsum(size)))
            data = pa.decompress(words.as_py(), int(offsets[-1]), "zstd")
            names.append(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), data))
            counts.append(total)
        coded = pa.concat_arrays(names).dictionary_encode()
        place, total = coded.indices.to_numpy().astype(np.int64), np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        langs = pc.replace_substring_regex(coded.dictionary, "\t[^\t]*$", "").dictionary_encode()
        by_lang = np.zeros(len(langs.dictionary), np.int64)
        np.add.at(by_lang, langs.indices.to_numpy(), total)
        good = np.flatnonzero(total >= min_count)
        split = [x.rpartition("\t") for x in coded.dictionary.take(pa.array(good)).to_pylist()]
        shard = rows.column("shard")[0].as_py()
        number = np.full(len(total), -1)
        number[good] = np.arange(len(good)) * shards + shard
        frequent = [(FREQUENT, -1, None, int(number[k]), 0, 0, int(total[k]), lang, word)
                    for k, (lang, _, word) in zip(good.tolist(), split, strict=True)]
        sums = [(TOTAL, -1, None, 0, 0, 0, n, lang, "") for lang, n in zip(langs.dictionary.to_pylist(), by_lang.tolist(), strict=True)]
        return _counted(frequent + sums + _hits(rows, [len(x) for x in counts], number[place]))

    return released(merge)


def _counted(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in COUNTED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def _hits(rows: pa.Table, sizes: list[int], number: np.ndarray) -> list[tuple]:
    """For each block: which of its entries are frequent, and their numbers."""
    out, at = [], 0
    for block, first, n in zip(rows.column("block").to_pylist(), rows.column("first").to_pylist(), sizes, strict=True):
        own = number[at:at + n]
        hit = np.flatnonzero(own >= 0)
        if len(hit):
            out.append((HIT, block, _squeeze(np.diff(hit + first, prepend=0), own[hit]), 0, 0, 0, 0, None, None))
        at += n
    return out


def _candidates(place: np.ndarray, gram: np.ndarray, last: np.ndarray, word_bits: int, bits: int):
    """Where an n-gram and the one a word later are both frequent: together they
    make the next longer one, packed and permuted."""
    at = np.flatnonzero(place[1:] == place[:-1] + 1)
    packed = (gram[at].astype(np.uint64) << np.uint64(word_bits)) | last[at + 1].astype(np.uint64)
    return at, Q.Permutation(bits).forward(packed)


def _count_ngrams(level: int, word_bits: int, before: int, bits: int, shards: int):
    """The n-grams of ``level`` words of a block. Its state are the positions of
    frequent n-grams two words shorter (for level 2, all words); the hits say
    which of those one word shorter are frequent. ``before`` and ``bits`` are the
    packed sizes of the last level and this one."""

    def count(state: pa.Table, hits: pa.Table) -> pa.Table:
        if not state.num_rows or not hits.num_rows:
            return _sent([])
        steps, *parts = _expand(state.column("blob")[0].as_py())
        place = np.cumsum(steps)
        if level == 2:
            index = parts[0]
        else:
            gram, last = parts[0], parts[-1]
            at, permuted = _candidates(place, gram, last, word_bits, before)
            index = np.unique(permuted, return_inverse=True)[1]
            place, last = place[at], last[at + 1]
            del gram, permuted
        ids = np.full(int(index.max(initial=-1)) + 1, -1)
        for blob in hits.column("blob"):
            steps, number = _expand(blob.as_py())
            ids[np.cumsum(steps)] = number
        gram = ids[index]
        stays = gram >= 0
        place, gram = place[stays], gram[stays]
        last = gram if level == 2 else last[stays]
        at, permuted = _candidates(place, gram, last, word_bits, bits)
        if not len(at):
            return _sent([])
        block = state.column("block")[0].as_py()
        kept = np.zeros(len(place), bool)  # what takes part in no candidate is of no more use
        kept[at] = kept[at + 1] = True
        steps = np.diff(place[kept], prepend=0)
        blob = _squeeze(steps, gram[kept]) if level == 2 else _squeeze(steps, gram[kept], last[kept])
        rows = [(STATE, block, None, 0, blob, None)]
        entries, counts = np.unique(permuted, return_counts=True)
        for s, a, b in _by_shard(Q.shard_of(entries, bits, shards)):
            rows.append((ENTRIES, block, s, a, Q.pack(entries[a:b], counts[a:b]), None))
        return _sent(rows)

    return released(count)


def _merge_shard(word_bits: int, bits: int, shards: int, min_count: int):
    """One shard: the frequent n-grams over all blocks (their two parts, a new
    number and the count), and for each block which of its entries they are."""

    def merge(rows: pa.Table) -> pa.Table:
        filters = [Q.unpack(blob.as_py()) for blob in rows.column("blob")]
        permuted, counts, place = Q.merge(filters)
        sizes = [len(p) for p, _ in filters]
        del filters
        good = np.flatnonzero(counts >= min_count)
        number = np.full(len(permuted), -1)
        number[good] = np.arange(len(good)) * shards + rows.column("shard")[0].as_py()
        packed = Q.Permutation(bits).back(permuted[good])
        first, last = packed >> np.uint64(word_bits), packed & np.uint64((1 << word_bits) - 1)
        frequent = [(FREQUENT, -1, None, i, a, b, n, None, None) for i, a, b, n in
                    zip(number[good].tolist(), first.tolist(), last.tolist(), counts[good].tolist(), strict=True)]
        return _counted(frequent + _hits(rows, sizes, number[place]))

    return released(merge)


def frequent_ngrams(docs: DataFrame, min_count: int, max_words: int, text_col: str = "text", lang_col: str = "lang",
                    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
                    shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``(lang, words array<string>, n)`` of all n-grams of 1 to ``max_words``
    words with ``n >= min_count``, and ``(lang, total)``: all words."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    sent = materialize(rows.mapInArrow(_count_words(block_bytes, shards), SENT), "phrase-words")
    entries = lambda: sent.where(F.col("kind") == ENTRIES).drop("kind").groupBy("shard")
    counted = materialize(entries().applyInArrow(_merge_words(shards, min_count), COUNTED), "phrase-vocabulary")
    totals = counted.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = counted.where(F.col("kind") == FREQUENT).select("id", "lang", "word", "n")
    grams = vocabulary.select("id", "lang", F.array("word").alias("words"), "n")
    found = [grams]
    top, occurrences = vocabulary.agg(F.max("id"), F.sum("n")).first()
    word_bits, before = max(1, int(top or 0).bit_length()), 0
    for level in range(2, max_words + 1):
        if top is None:
            break
        bits = max(1, int(top).bit_length()) + word_bits
        shards = max(1, -(-int(occurrences) // shard_entries))
        # A block's state and its frequent entries: both bounded by the block.
        state = sent.where(F.col("kind") == STATE).select("block", "blob")
        hits = counted.where(F.col("kind") == HIT).select(F.col("block").alias("of"), "blob")
        sent = (state.groupBy("block").cogroup(hits.groupBy("of"))
                .applyInArrow(_count_ngrams(level, word_bits, before, bits, shards), SENT))
        sent = materialize(sent, f"phrase-filters-{level}")
        counted = materialize(entries().applyInArrow(_merge_shard(word_bits, bits, shards, min_count), COUNTED), f"phrase-counts-{level}")
        end = vocabulary.select(F.col("id").alias("last"), "word")
        begin = grams.select(F.col("id").alias("first"), "lang", "words")
        frequent = counted.where(F.col("kind") == FREQUENT).select("id", "first", "last", "n")
        grams = frequent.join(begin, "first").join(end, "last").select("id", "lang", F.concat("words", F.array("word")).alias("words"), "n")
        grams = materialize(grams, f"phrases-{level}")
        found.append(grams)
        before = bits
        top, occurrences = grams.agg(F.max("id"), F.sum("n")).first()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("lang", "words", "n"), totals


def _exact(*factors: Column) -> Column:
    """A product of counts, as a decimal of 38 places."""
    out = factors[0].cast("decimal(38,0)")
    for x in factors[1:]:
        out = (out * x.cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def mine_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, absorbed_percent: int = 100, limit: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """The first ``limit`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is 2 to ``max_words`` words within a piece (between ``.,;:!?`` or
    line ends; A-Z in lower case) that occur ``a >= min_count`` times. ``score`` is the
    least of ``floor(1000 a n / (l r))`` over its cuts in two, ``l`` and ``r`` being the
    counts of the parts and ``n`` that of all words of the language. A phrase
    goes if a longer one of at least ``absorbed_percent`` of its count contains
    it. Order: score, count (both falling), phrase in byte order.

    Null text counts as empty, a null language is ``und``. Repeated rows count
    again. Ties are broken by the phrase, so the order is total. An empty table
    gives no rows; other columns are not read. Products of counts are exact to
    38 digits. The numbers of frequent (n-1)-grams and of frequent words, in
    bits, must not sum to more than 64 (ValueError).
    """
    grams, totals = frequent_ngrams(docs, min_count, max_words, text_col, lang_col, **sizes)
    grams = materialize(grams, "phrases")
    phrases = grams.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    part = lambda words, n: grams.select("lang", F.col("words").alias(words), F.col("n").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals.withColumnRenamed("total", "n"), "lang")
    score = F.call_function("div", _exact(F.col("a"), F.col("n"), F.lit(1000)), _exact(F.col("l"), F.col("r")))
    cuts = cuts.withColumn("score", score.cast("long"))
    scored = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.size("words")
    inner = phrases.where(size > 2).select("lang", F.col("a").alias("outer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("words", s, m))))).alias("words"))
    inner = inner.groupBy("lang", "words").agg(F.max("outer").alias("outer"))
    kept = scored.join(inner, ["lang", "words"], "left").where(
        F.col("outer").isNull() | (F.col("outer") * 100 < F.lit(absorbed_percent) * F.col("a")))
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                       F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
