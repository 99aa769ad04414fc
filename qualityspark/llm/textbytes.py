"""Vectorised text primitives on Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow batch at once: word
boundaries come from a byte class table, word hashes from one prefix sum of a
polynomial modulo 2**64, so no Python runs per word.  Byte classes are enough
for the word patterns used here because all their non-ASCII code points are
word characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: byte arrays are processed in pieces of about this many bytes
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of bytes inside any of the inclusive ``ranges``."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


#: digits, a-z and everything beyond ASCII (after lower-casing A-Z)
ALNUM_WORDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: everything but ASCII white space
SPACE_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """A different pseudo-random order of the same hashes for each ``salt``."""
    return mix(x ^ mix(np.array([salt + 1], U) * U(0x9E3779B97F4A7C15))[0])


class WordHash:
    """Polynomial word hash with a random value per byte; ``seed`` gives
    independent functions."""

    def __init__(self, seed: int = 0):
        self.base = int(mix(np.array([2 * seed + 11], U))[0]) | 1
        self.table = mix(np.arange(1, 257, dtype=U) + U(1000 * (seed + 1)))
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            n = max(n, PIECE + 1)
            up = np.full(n, self.base, U)
            up[0] = 1
            down = np.full(n, pow(self.base, -1, 1 << 64), U)
            down[0] = 1
            self.up, self.down, self.size = np.multiply.accumulate(up), np.multiply.accumulate(down), n

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), U)
        i = 0
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
            n = int(ends[j - 1] - at)
            self._powers(n + 1)
            sums = np.empty(n + 1, U)
            sums[0] = 0
            np.cumsum(self.table[data[at:at + n]] * self.up[:n], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * self.down[s])
            i = j
        return out


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` with about ``limit`` bytes of ``column`` each
    (one long text is one slice)."""
    _, off = string_buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, end) of every maximal run of word bytes; runs
    never cross a document boundary."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    word = table[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    h = words[:n] + U(k)
    for j in range(1, k):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[j:j + n])
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def ragged(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """A list array from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False)))
