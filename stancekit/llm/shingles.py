"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z in lower
case. Word hashes are polynomials of the word's bytes, taken as differences of
one running sum over the buffer, so no string is built.
"""

from __future__ import annotations

import numpy as np

from stancekit.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """The first powers of a base, kept per process and grown as needed."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(-(-n // (1 << 20)) << 20, base)
        have[0] = 1
        have = _POWERS[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have


def forget_powers() -> None:
    _POWERS.clear()


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``data[start:end]``; equal runs have equal hashes."""
    n = len(data) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(n, _BASE)[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _powers(n, _INVERSE)[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, end to end, and for each text the first of its words
    (``n + 1`` places). ``is_word`` tells the bytes of words from others."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = inside[1:] != inside[:-1]
    cut = offsets[1:-1]  # a word ends with its text
    both = cut[(cut > 0) & (cut < len(data))]
    both = both[inside[both] & inside[both + 1]]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate((starts, both))), np.sort(np.concatenate((ends, both)))
    return run_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the runs of ``n`` words of one text; a shorter text that has
    words is one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i:len(words) - n + 1 + i]
    return mix64(out + np.uint64(n))
