"""Vectorised word hashes over Arrow string columns, shared by several operators.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased.
Everything works on slices of about ``SLICE`` bytes, so that memory stays bounded however
many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 500_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """Words of consecutive documents: byte bounds, 64-bit hashes, and how many each document has."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The index of each document's first word."""
        return np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64) if len(self.counts) else self.counts

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Find and hash the words of the rows that ``offsets`` bound."""
    base = offsets[0]
    b = data[base : offsets[-1]]
    off = (offsets - base).astype(np.int64)
    n = len(b)
    rows = len(off) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(b, off, z, z, np.zeros(rows, np.int64), np.zeros(0, np.uint64))
    sep = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = ~sep
    begin = word.copy()
    begin[1:] &= sep[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= sep[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, off))
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _pow(_P, n, "p"), out=total[1:])
    h = (total[ends] - total[starts]) * _pow(_PINV, n, "q")[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return Words(b, off, starts, ends, counts, h)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in document order, and how many each document has.

    A document of fewer than k words has one, its whole sequence; one without words has none.
    """
    n = w.counts
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first, out_first = w.first, np.concatenate(([0], np.cumsum(out_n)[:-1])).astype(np.int64)
    out = np.zeros(int(out_n.sum()), np.uint64)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    whole = n >= k
    if whole.any():
        m = len(w.hashes) - k + 1
        acc = np.zeros(m, np.uint64)
        for i in range(k):
            acc += w.hashes[i : i + m] * odd[i]
        take = out_n[whole]
        within = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        out[np.repeat(out_first[whole], take) + within] = mix(acc[np.repeat(first[whole], take) + within])
    for size in range(1, k):
        some = np.flatnonzero(n == size)
        if len(some):
            acc = np.full(len(some), np.uint64(size * 0x1000193), np.uint64)
            for i in range(size):
                acc += w.hashes[first[some] + i] * odd[i]
            out[out_first[some]] = mix(acc + np.uint64(0x5851F42D4C957F2D))
    return out, out_n
