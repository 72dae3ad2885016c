"""Vectorised words and shingle hashes over Arrow string columns.

A word is a maximal run of bytes outside space and \\t..\\r, so that byte work
equals ``[^\\x20\\x09-\\x0D]+`` on the text.  All hashes are 64-bit and the same
on every machine and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in pieces of about this many bytes; one text is never cut.
CHUNK_BYTES = 2 << 20

_MASK = (1 << 64) - 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    step = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64((seed * 0xD1342543DE82EF95) & _MASK)
    return mix(step)


_BYTE_VALUE = stream(11, 256)
_BYTE_VALUE[_IS_SPACE] = 0
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[65:91] = _BYTE_VALUE[97:123]
_PLACES = 1 << 16
_POWERS = stream(12, _PLACES) | np.uint64(1)
#: A second family of hashes, independent of the first.
_BYTE_VALUE_2 = stream(14, 256)
_BYTE_VALUE_2[_IS_SPACE] = 0
_POWERS_2 = stream(15, _PLACES) | np.uint64(1)
_SALT = 0xA0761D6478BD642F
_LENGTH_SALT = np.uint64(_SALT)
_WINDOW_FACTOR = np.uint64(0xE7037ED1A0B428DB)


class Words:
    """The words of some texts: their hashes, spans, and each text's range of words."""

    __slots__ = ("bounds", "ends", "hashes", "second", "starts")

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: np.ndarray | None = None):
        self.hashes, self.bounds, self.starts, self.ends, self.second = hashes, bounds, starts, ends, second

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int64), self.counts)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]] if len(offsets) else every[:0], offsets - (offsets[0] if len(offsets) else 0)


def words(column: pa.Array, lower: bool = False, second: bool = False) -> Words:
    """Split every text of a column; ``lower`` treats A-Z as a-z, ``second`` adds hashes of the other family."""
    data, offsets = raw(column)
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty, np.zeros(0, np.uint64))
    space = _IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:n]
    finishes = ~space
    finishes[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), bounds, starts, ends, np.zeros(0, np.uint64))
    value = (_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data]
    lengths = ends - starts
    place = np.arange(n, dtype=np.int64)
    gap = np.empty(len(starts), np.int64)
    gap[:-1] = starts[1:] - starts[:-1]
    gap[-1] = n - starts[-1]
    place[starts[0] :] -= np.repeat(starts, gap)
    far = None
    if lengths.max() > _PLACES:  # places beyond the table get a factor for their stretch of it, too
        far = stream(13, int(max(gap.max(), starts[0])) // _PLACES + 1) | np.uint64(1)
        far[0] = 1
        far = far[place // _PLACES]
    place &= _PLACES - 1

    def summed(value: np.ndarray, powers: np.ndarray) -> np.ndarray:
        value *= powers[place]
        if far is not None:
            value *= far
        out = np.add.reduceat(value, starts)
        out ^= lengths.astype(np.uint64) * _LENGTH_SALT
        return mix(out)

    return Words(summed(value, _POWERS), bounds, starts, ends, summed(_BYTE_VALUE_2[data], _POWERS_2) if second else None)


def windows(hashes: np.ndarray, k: int, factor: np.uint64 = _WINDOW_FACTOR) -> np.ndarray:
    """Hashes of all runs of k consecutive words, whatever texts they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= factor
        acc += hashes[j : j + n]
    acc += np.uint64(k * _SALT & _MASK)
    return mix(acc)


def long_windows(w: Words, k: int) -> np.ndarray:
    """128 bits of each run of k consecutive words: two columns of independent hashes."""
    return np.stack([windows(w.hashes, k), windows(w.second, k, np.uint64(0x8EBC6AF09C88C6E3))], axis=1)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows and their bounds.

    A text with fewer words gives its whole sequence as one; without words, none.
    """
    counts = w.counts
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    sizes = full + short
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    out = np.empty(bounds[-1], np.uint64)
    every = windows(w.hashes, k)
    first = np.repeat(w.bounds[:-1] - bounds[:-1], full)
    at = np.repeat(full > 0, sizes)
    if len(first):
        target = np.flatnonzero(at)
        out[target] = every[target + first]
    for i in np.flatnonzero(short):
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
        out[bounds[i]] = windows(own, len(own))[0]
    return out, bounds


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        total, start, n = np.concatenate([[0], np.cumsum(size)]), 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def tidy(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run``, after which a worker gives back the memory of its task.

    Workers are used again by later tasks; what they keep counts for every one of them.
    """

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return done
