"""Words and shingles of whole Arrow batches as NumPy arrays.

A word is a run of bytes other than ASCII white space; since UTF-8 never uses
those bytes inside a character, splitting bytes equals splitting characters. A
word's hash is a polynomial over its bytes, taken from prefix sums of the whole
batch, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Text handled at once; a longer document is a chunk of its own."""

CHUNK_ROWS = 30_000

SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLAIN = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] = _PLAIN[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the common chunk size."""
    size = max(n, CHUNK_BYTES + 1)
    if "up" not in _powers or len(_powers["up"]) < n:
        up = np.full(size, _U(_BASE))
        down = np.full(size, _U(_INVERSE))
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > CHUNK_BYTES + 1:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most CHUNK_BYTES of text, whole documents only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
            stop = min(stop, start + CHUNK_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


class Words(NamedTuple):
    """The words of a chunk: document index, byte range and hash; bounds has each document's first word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """All words of a chunk, in order."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~space[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(doc, start, end, range_hash(data, start, end, lower), bounds)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _PLAIN)[data] * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_ORDER = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | _U(1)


def shingle_hashes(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of each run of ``size`` words, in order; a shorter document is one shingle."""
    n = len(w.hash)
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if n >= size:
        total = w.hash[: n - size + 1] * _ORDER[0]
        for k in range(1, size):
            total += w.hash[k : n - size + 1 + k] * _ORDER[k]
        whole = w.doc[: n - size + 1] == w.doc[size - 1 :]
        doc, value = w.doc[: n - size + 1][whole], mix(total[whole])
    else:
        doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += w.hash[w.bounds[short[has]] + k] * _ORDER[k]
        extra = mix(extra + counts[short].astype(np.uint64) * _ORDER[size + 1])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles, sorted by hash within each document, and the bounds."""
    doc, value = shingle_hashes(w, size)
    n = len(w.bounds) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        doc, value = doc[keep], value[keep]
        bounds = np.searchsorted(doc, np.arange(n + 1))
    return doc, value, bounds
