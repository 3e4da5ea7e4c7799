"""Words and word windows of an Arrow column of texts, hashed with numpy.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes other than space and \\x09-\\x0D; no byte
of a multi-byte character is one of those. Work runs over slices of about a megabyte, so memory follows the
slice, the longest document and eight bytes a word.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M64 = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; sizes are rounded up so that few tables are made."""
    size = 1 << max(20, int(n).bit_length())
    return (_powers(base, size) if size <= 1 << 21 else _powers.__wrapped__(base, size))[:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end], wherever it stands."""
    inverse = pow(base, -1, 1 << 64)
    out = prefix[ends] - prefix[starts]
    out *= powers(inverse, len(prefix))[starts]
    return out


@functools.lru_cache(maxsize=2)
def byte_values(fold_ascii: bool = False) -> np.ndarray:
    """A fixed random number for each byte; upper-case ASCII letters as lower-case ones if asked for."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
    if fold_ascii:
        v[65:91] = v[97:123]
    return v


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 16):
    """Consecutive ranges of rows of about ``limit`` bytes and ``rows`` at most; a longer row is its own slice."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + rows, n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a slice; words never reach over the end of a row."""
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Words:
    """Words of a column: bytes, spans in them, a hash each, and how many each row has."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(column: pa.Array | pa.ChunkedArray) -> Words:
    data, offsets = text_buffers(column)
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    values = byte_values()
    for lo, hi in row_slices(offsets):
        a, b = offsets[lo], offsets[hi]
        piece = data[a:b]
        s, e = word_spans(piece, offsets[lo:hi + 1] - a)
        h = mix(range_hash(prefix_hash(values[piece], _BYTE_BASE), s, e, _BYTE_BASE))
        bounds = np.searchsorted(s, offsets[lo:hi + 1] - a)
        counts[lo:hi] = np.diff(bounds)
        parts.append((s + a, e + a, h))
    if not parts:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, z, z, np.zeros(0, np.uint64), counts)
    s, e, h = (np.concatenate(x) for x in zip(*parts))
    return Words(data, offsets, s, e, h, counts)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``width`` words that lies in one row, and its first word."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rank = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - rank
    start = np.flatnonzero(left >= width)
    out = np.empty(len(start), np.uint64)
    step = SLICE_BYTES
    for lo in range(0, len(start), step):  # the tables of powers stay small
        s = start[lo:lo + step]
        base = s[0]
        p = prefix_hash(hashes[base:s[-1] + width], _WORD_BASE)
        out[lo:lo + step] = mix(range_hash(p, s - base, s - base + width, _WORD_BASE))
    return out, start


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return data[:0]
    at = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - at, lengths)]


def binary_column(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow column of the byte ranges between the offsets."""
    return pa.Array.from_buffers(
        kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )
