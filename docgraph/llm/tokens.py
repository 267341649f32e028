"""Vectorised tokenising and hashing of whole Arrow batches.

All texts of a slice are handled as one byte array: words are found by a byte mask and hashed eight bytes at a time,
and windows of words are hashed with a polynomial prefix sum modulo 2**64. No per-word Python code runs.

Null texts count as empty. Words never cross from one document into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Bytes of text handled at once; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUES = mix(np.arange(256, dtype=U), 7)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept for the worker's next batches."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, U(b))
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        kept = _powers[base] = (made[0], made[1])
        if n > 64 * SLICE_BYTES:
            del _powers[base]
    return kept


def window_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair: equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, U)
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


#: The lowest i bytes of a word of eight.
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
#: Longer spans are hashed by the polynomial.
_LONG = 64


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[s:e] of each pair: equal spans have equal hashes, in whatever array they stand."""
    size = end - start
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view(U)

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        q, shift = at >> 3, ((at & 7) << 3).astype(U)
        return (eights[q] >> shift | (eights[q + 1] << U(1)) << (U(63) - shift)) & _LOW[np.minimum(left, 8)]

    out = mix(load(start, size) ^ size.astype(U) * U(0x9E3779B97F4A7C15), 1)
    todo, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(todo):
        out[todo] = mix(out[todo] ^ load(start[todo] + done, size[todo] - done), 2)
        done += 8
        todo = todo[size[todo] > done]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        n = size[long]
        ends = np.cumsum(n)
        at = np.repeat(start[long] - (ends - n), n) + np.arange(int(ends[-1]))
        out[long] = window_hash(_VALUES[data[at]], BYTE_BASE, ends - n, ends)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass
class Words:
    """Words of several texts. ``bounds[d]:bounds[d + 1]`` are the words of text d; start and end are byte places."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and len + 1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters, byte for byte."""
    low = _FOLD[data]
    if len(low) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][up] += 0x20
    return low


def words(column: pa.Array, folded: bool) -> Words:
    """folded: lower-case runs of letters, digits and non-ASCII characters; else runs of anything but ASCII space."""
    data, offsets = text_bytes(column)
    data = fold(data) if folded else data
    inside = WORD[data] if folded else ~SPACE[data]
    n = len(data)
    change = np.zeros(n + 1, bool)
    if n:
        change[1:n] = inside[1:] != inside[:-1]
        change[0], change[n] = inside[0], inside[-1]
    at = np.flatnonzero(change)
    edge = distinct(offsets[(offsets > 0) & (offsets < n)])
    cut = edge[inside[edge] & inside[edge - 1]]  # a text's end inside a run: one word ends, another begins
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    start, end = at[::2], at[1::2]
    return Words(data, offsets, start, end, span_hash(data, start, end), np.searchsorted(start, offsets))


def count_words(column: pa.Array) -> np.ndarray:
    """The number of words of each text, unfolded: as words() has them, without their hashes."""
    data, offsets = text_bytes(column)
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets] = inside[offsets]
    return np.diff(np.concatenate([[0], np.cumsum(begins[:-1])])[offsets])


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie within one text, and the word at which each starts."""
    if len(w.hash) < k:
        return np.empty(0, U), np.empty(0, np.int64)
    at = np.arange(len(w.hash) - k + 1)
    at = at[w.doc[at] == w.doc[at + k - 1]]
    return window_hash(w.hash, WORD_BASE, at, at + k), at


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row where that has more."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
