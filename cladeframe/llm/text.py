"""Vectorised words, shingles and hashes over Arrow string batches.

Texts are UTF-8 bytes in one buffer with offsets, so a batch of documents costs a
few numpy passes instead of a Python loop over words. A word's hash is a polynomial
over its bytes modulo 2**64 (random table, odd base), finished by an avalanche mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20  # texts are handled in slices of about this many bytes
_rng = np.random.default_rng(20260101)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but digits and letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = -(-n // (1 << 18)) << 18
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, U64)
        steps[0] = U64(1)
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = B**-i times the polynomial of data[i:j]."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * _power("down", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of data[start:end] for arrays of starts and ends."""
    up = _power("up", len(sums))
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))


def string_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``limit`` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(wide) == 0:
        return
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


class Words:
    """The words of a slice of documents.

    start, end: byte spans; doc: row within the slice; first: per document the index
    of its first word, one more than the documents; hash: per word. A word also ends
    at each of ``cuts``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = SPACE, cuts: np.ndarray | None = None):
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        word = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cuts is not None:
            edge[cuts] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word
        now = np.zeros(n + 1, bool)
        now[:n] = word
        self.start = np.flatnonzero(now & (~before | edge))
        self.end = np.flatnonzero(before & (~now | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    _hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(prefix_sums(self.data), self.start, self.end)
        return self._hash


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k consecutive words; a document of 1 to k-1 words has one, of all its words."""
    h, n = words.hash, len(words.hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = max(n - k + 1, 0)
    whole = np.zeros(total, U64)
    for j in range(k):
        whole = whole * U64(_BASE) + h[j : j + total]
    inside = words.doc[:total] == words.doc[k - 1 :] if total else np.zeros(0, bool)
    doc, out = words.doc[:total][inside], mix(whole[inside] + U64(k))
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        left = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = words.count[short] > j
            left[has] = left[has] * U64(_BASE) + h[words.first[short[has]] + j]
        doc = np.concatenate([doc, short])
        out = np.concatenate([out, mix(left + words.count[short].astype(U64) + U64(977))])
    return doc, out


def distinct_per_document(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values ascending and distinct within each document, and n + 1 bounds."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(n + 1))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind) if kind else pa.array(values))


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which lives on, gives back the memory that it freed."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then_release
