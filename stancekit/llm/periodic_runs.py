"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period ``q`` that no neighbouring
word extends. The suffixes of a text (as word numbers) are sorted, and suffix
classes are united from the longest common prefix down: at level ``l`` a class
holds the positions that share their first ``l`` words, in order. When two
classes meet, positions ``i < j`` that become neighbours have a common prefix
of exactly ``l`` words; if their distance ``j - i`` is at most ``l``, the words
from ``i`` to ``j + l`` have that period and end a run at ``j + l``.

The first repeat of a run's first period is always such a pair: a position of
the class between the two would give the run a smaller period. So the smallest
``i`` of each (end, distance) is where the run begins, and multiples of a
period come out with the same ends and are left out.

Classes are intervals of the sorted suffixes, so the union-find needs only the
two ends of each. Runs have a least length and exponent; a pair below the
common prefix these imply cannot begin one, which ends the descent early, and
texts that repeat no window of that many words are not sorted at all.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.llm.common import mix64
from stancekit.llm.words import Words, byte_classes, slices

SLICE = 4 << 20
_SPLIT = byte_classes(" \t\n\x0b\x0c\r")


def sort_suffixes(word: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Suffix order of all texts of a slice, one text after the other. ``end`` is
    where each word's text ends. Prefix doubling; only suffixes not yet told
    apart are sorted again."""
    n = len(word)
    key = text * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    rank[order], shared = _heads(key[order], slots)
    k = 1
    while shared.any():
        slots = slots[shared]
        active = order[slots]
        after = active + k
        inside = after < end[active]
        key = rank[active] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        again = np.argsort(key, kind="stable")
        order[slots] = active = active[again]
        rank[active], shared = _heads(key[again], slots)
        k *= 2
    return order


def _heads(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the slot of the first of each one's group, and whether
    the group has more than one."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    return slots[np.flatnonzero(new)][np.cumsum(new) - 1], ~(new & last)


def common_prefixes(word: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it (0 where that
    is of another text). Words are compared only where the value does not
    follow from the position to the left."""
    n = len(word)
    before = np.full(n, -1)
    own = begin[order[1:]] == begin[order[:-1]]
    before[order[1:][own]] = order[:-1][own]
    at = np.arange(n)
    follows = (before > begin) & (at > begin)
    follows[follows] = word[at[follows] - 1] == word[before[follows] - 1]
    found = np.zeros(n, np.int64)
    open_ = np.flatnonzero(~follows & (before >= 0))
    for step in range(32):
        a, b = open_ + step, before[open_] + step
        ok = np.maximum(a, b) < end[open_]
        ok[ok] = word[a[ok]] == word[b[ok]]
        open_ = open_[ok]
        found[open_] = step + 1
    for i in open_.tolist():
        found[i] = 32 + _equal_words(word, i + 32, int(before[i]) + 32, int(end[i]))
    base = np.maximum.accumulate(np.where(follows, 0, at))
    found = found[base] - (at - base)
    out = found[order]
    out[0] = 0
    out[1:][~own] = 0
    return out


def _equal_words(word: np.ndarray, a: int, b: int, end: int) -> int:
    """Number of equal words from two places on."""
    got, step, room = 0, 64, end - max(a, b)
    while got < room:
        size = min(step, room - got)
        differ = np.flatnonzero(word[a + got:a + got + size] != word[b + got:b + got + size])
        if len(differ):
            return got + int(differ[0])
        got, step = got + size, step * 4
    return got


def _run_start(word: np.ndarray, begin: int, i: int, period: int) -> int:
    """How far to the left a run with this period goes on."""
    step = 64
    while i > begin:
        a = max(begin, i - step)
        differ = np.flatnonzero(word[a:i] != word[a + period:i + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        i, step = a, step * 4
    return i


def least_prefix(min_length: int, min_exponent: int) -> int:
    """Smallest common prefix of a run's first two periods."""
    return next(k for k in range(1, min_length + 1) if k + k // (min_exponent - 1) >= min_length)


def seeds(order: np.ndarray, prefix: np.ndarray, least: int, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """``(end, distance): smallest first position`` of pairs that become
    neighbours while classes are united by descending common prefix."""
    at = np.flatnonzero(prefix >= least)
    at = at[np.argsort(-prefix[at], kind="stable")]
    left: dict[int, int] = {}  # last suffix of a class: its first
    right: dict[int, int] = {}  # first suffix of a class: its last
    members: dict[int, list[int]] = {}  # first suffix of a class: its positions in order, if several
    found: dict[tuple[int, int], int] = {}
    share = min_exponent - 1

    def meet(i: int, j: int, level: int) -> None:
        distance = j - i
        if distance * share <= level and distance + level >= min_length:
            key = (j + level, distance)
            if found.get(key, j) > i:
                found[key] = i

    for r, level, one, two in zip(at.tolist(), prefix[at].tolist(), order[at - 1].tolist(), order[at].tolist(), strict=True):
        low, high = left.pop(r - 1, r - 1), right.pop(r, r)
        large, small = members.pop(low, None) or [one], members.pop(r, None) or [two]
        if len(small) > len(large):
            large, small = small, large
        last = -1
        for n, x in enumerate(small):
            k = bisect(large, x)
            if k and large[k - 1] > last:
                meet(large[k - 1], x, level)
            if k < len(large) and (n + 1 == len(small) or large[k] < small[n + 1]):
                meet(x, large[k], level)
            last = x
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large = sorted(large + small)
        right[low], left[high], members[low] = high, low, large
    return found


def _repeating(word: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Words in texts that hold some window of ``size`` words twice (by hash,
    which may name a text too many)."""
    whole = np.flatnonzero(np.arange(len(word)) + size <= end)
    value = mix64(begin[whole].astype(np.uint64))
    for i in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + mix64(word[whole + i].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value)
    same = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    texts = np.zeros(len(word) + 1, bool)
    texts[begin[whole[order[same]]]] = True
    return texts[begin]


def runs_of(word: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs of all texts of a slice, as rows ``text, start, length, period``
    (starts within the slice), in the order of text, start and period.
    ``first`` is where each text's words begin."""
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    begin, end = first[text], first[text + 1]
    least = least_prefix(min_length, min_exponent)
    part = np.flatnonzero(_repeating(word, begin, end, least))
    if not len(part):
        return np.zeros((0, 4), np.int64)
    # From here on only the texts that repeat something, moved together.
    own_word, own_text = word[part], text[part]
    own_first = np.flatnonzero(np.diff(own_text, prepend=-1))
    of = np.cumsum(np.diff(own_text, prepend=-1) != 0) - 1
    own_begin, own_end = own_first[of], np.append(own_first[1:], len(part))[of]
    order = sort_suffixes(own_word, own_end, of)
    prefix = common_prefixes(own_word, own_begin, own_end, order)
    found: dict[tuple[int, int], int] = {}
    for (stop, period), i in seeds(order, prefix, least, min_length, min_exponent).items():
        start = _run_start(own_word, int(own_begin[i]), i, period)
        if stop - start >= max(min_length, min_exponent * period):
            found[start, stop] = min(period, found.get((start, stop), period))
    if not found:
        return np.zeros((0, 4), np.int64)
    out = np.array([(own_text[a], part[a], b - a, q) for (a, b), q in found.items()], np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id (as ``id_col``), ``n_words``, ``runs`` (start, length and
    smallest period in words, numbered from 0, by start, then period) and
    ``collapsed``: the text without the words that a run holds after its first
    period, words joined by one blank.

    Words are what stands between blanks, tabs and line ends. A run has at least
    ``min_length`` words and ``min_exponent`` (2 or more) periods. Null and
    empty texts have no words, no runs and an empty ``collapsed``. Rows are
    judged one by one, so repeated rows give equal rows, and rows without id
    count; other columns are not read; an empty table gives no rows. A text is
    held in one task with some 100 bytes a word while its runs are searched.
    """
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run has at least two periods")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "__text", SLICE):
            words = Words(rows.column("__text"), _SPLIT)
            first, n = words.first, rows.num_rows
            number, _ = words.numbers()
            found = runs_of(number, first, min_length, min_exponent)
            count = np.bincount(found[:, 0], minlength=n)
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, found[:, 1] + found[:, 3], 1)
            np.add.at(edge, found[:, 1] + found[:, 2], -1)
            stays = np.cumsum(edge[:-1]) == 0
            kept = np.concatenate(([0], np.cumsum(stays)))[first]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pc.cast(words.strings.filter(pa.array(stays)), pa.string()))
            parts = [pa.array(found[:, 1] - first[found[:, 0]]), pa.array(found[:, 2]), pa.array(found[:, 3])]
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()),
                                            pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            out = pa.table([rows.column("__id").combine_chunks(), pa.array(np.diff(first).astype(np.int64)), runs,
                            pc.binary_join(lists, " ")], names=[id_col, "n_words", "runs", "collapsed"])
            yield from out.to_batches()

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(search, schema)
