"""Words and rolling hashes of whole texts, computed on the bytes of Arrow string columns.

All of it works on UTF-8 bytes: every separator used here is ASCII, and the bytes of other characters are 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenised at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Bytes of words: everything but ASCII white space; or letters (lower-cased before), digits and what isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ _U(salt * 0x632BE59BD9B4E019 % (1 << 64)) if salt else h.copy()
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(32)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offset of each text and of the end; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


@dataclass
class Words:
    """Words of a run of documents: bytes, first and last byte of each word, and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        p, inv = powers(len(self.data))
        c = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * p[: len(self.data)], out=c[1:])
        return mix((c[self.ends] - c[self.starts]) * inv[self.starts], 1)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tokenise(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, case: np.ndarray = SAME) -> Words:
    """Maximal runs of bytes of a kind within each document, after mapping the bytes by case."""
    n = len(data)
    if case is not SAME:
        data = case[data]
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = kind[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, documents not regarded; empty if there are fewer."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    p, inv = powers(n + 1)
    c = np.zeros(n + 1, _U)
    np.cumsum(hashes * p[:n], out=c[1:])
    return mix((c[k:] - c[: n - k + 1]) * inv[: n - k + 1], k)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words, as grams() has them, whether one document holds them all."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):  # a gram that starts j words before a document's first word reaches into it
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of documents of about that many bytes."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def join_words(w: Words, keep: np.ndarray, doc: int) -> bytes:
    """Kept words of one document, joined by one space."""
    a, b = int(w.first[doc]), int(w.first[doc + 1])
    at = np.flatnonzero(keep[a:b]) + a
    raw = w.data[w.starts[a] : w.ends[b - 1]].tobytes() if b > a else b""
    o = int(w.starts[a]) if b > a else 0
    return b" ".join([raw[s:e] for s, e in zip((w.starts[at] - o).tolist(), (w.ends[at] - o).tolist(), strict=True)])
