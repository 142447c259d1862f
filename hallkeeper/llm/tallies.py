"""Counts of the byte strings a task meets, most repetitions added up before they leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD = 1_000_000
"""Distinct strings per chunk that a task holds before it adds them up and sends them on."""


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and size: the number of each one's range, and its places, laid end to end."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges as a binary array."""
    size = end - start
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    raw = data[ranges(start, size)[1]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


class Tally:
    """Adds up counts per string; strings are told apart by their 64-bit hash while a task holds them."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, n: np.ndarray | None = None) -> None:
        if not len(key):
            return
        key, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(inverse, n, len(key)).astype(np.int64)
        self.parts.append((key, n, cut_out(data, start[at], end[at])))
        self.held += len(key)

    def full(self) -> bool:
        return self.held > HELD

    def take(self, name: str = "word") -> Iterator[pa.RecordBatch]:
        """Rows (string, n), after which nothing is held."""
        if self.parts:
            key, n, words = zip(*self.parts, strict=True)
            self.parts, self.held = [], 0
            key, at, inverse = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate(n), len(key)).astype(np.int64)
            words = pa.concat_arrays(words).take(pa.array(at))
            for a in range(0, len(key), 50_000):
                some = words[a : a + 50_000].cast(pa.large_string())
                yield pa.record_batch({name: some.cast(pa.string()), "n": n[a : a + 50_000]})


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SECOND = np.random.default_rng(13).permutation(256).astype(np.uint8)
"""Bytes dealt anew: the hash of a string's bytes and that of these together have 128 bits."""
