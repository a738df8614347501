"""Counting quotient filters: lossless, compact counters of integers.

Integers of ``bits`` bits are permuted invertibly; the high bits of the result
are the quotient, all others the remainder, kept in full. Entries lie in the
order of (quotient, remainder), so the quotient needs no room but the length
of its run, filters merge like sorted lists, and each entry gives its integer
back. Counts take a byte each; those that need more stand apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LOAD = 8  # entries a quotient, about


class Permutation:
    """An invertible mapping of the integers below ``2 ** bits`` onto themselves."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 64:
            raise ValueError(f"packed n-grams of {bits} bits; 64 at most")
        self.bits = bits
        self._mask = np.uint64((1 << bits) - 1)
        self._half = np.uint64((bits + 1) // 2)  # a shift by half or more undoes itself
        self._odd = [np.uint64(x & ((1 << bits) - 1)) for x in _ODD]
        self._inverse = [np.uint64(pow(x, -1, 1 << bits)) for x in _ODD]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for odd in self._odd:
            x = (x * odd) & self._mask
            x = x ^ (x >> self._half)
        return x

    def back(self, x: np.ndarray) -> np.ndarray:
        for inverse in self._inverse[::-1]:
            x = x ^ (x >> self._half)
            x = (x * inverse) & self._mask
        return x


def shard_of(permuted: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Equal ranges of the permuted integers; ascending with them."""
    top = permuted >> np.uint64(max(0, bits - 32))
    return (top * np.uint64(shards) >> np.uint64(min(bits, 32))).astype(np.int64)


def pack(permuted: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter of distinct permuted integers (one or more) in ascending order."""
    # All integers of a shard lie in one range: the quotient counts from its start.
    span = int(permuted[-1]) - int(permuted[0])
    low = max(0, span.bit_length() - (len(permuted) // LOAD).bit_length())
    quotient = permuted >> np.uint64(low)
    base = quotient[0]
    runs = np.bincount((quotient - base).astype(np.int64)).astype(np.uint32)
    width = (low + 7) // 8
    remainder = (permuted & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    small = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(permuted), low, base, len(runs)], np.uint64)
    body = b"".join((head.tobytes(), runs.tobytes(), np.ascontiguousarray(remainder.T).tobytes(), small.tobytes(),
                     counts[small == 255].astype(np.int64).tobytes()))
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The permuted integers, ascending, and their counts."""
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, low, base, quotients = (int(x) for x in np.frombuffer(body, np.uint64, 4))
    runs = np.frombuffer(body, np.uint32, quotients, 32)
    at, width = 32 + 4 * quotients, (low + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
    at += n * width
    quotient = np.repeat(np.arange(quotients, dtype=np.uint64), runs) + np.uint64(base)
    permuted = (quotient << np.uint64(low)) | wide.view("<u8").ravel()
    counts = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, np.int64, -1, at + n)
    return permuted, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted integers and counts of all filters together, and the place of
    each entry (filter after filter) among them."""
    permuted = np.concatenate([p for p, _ in filters])
    order = np.argsort(permuted, kind="stable")  # sorted runs: a merge
    ordered = permuted[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(ordered), np.int64)
    place[order] = np.cumsum(new) - 1
    counts = np.concatenate([c for _, c in filters])[order]
    return ordered[first], np.add.reduceat(counts, first) if len(first) else counts, place
