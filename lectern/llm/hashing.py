"""Whole-batch hashing of words and shingles with numpy.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return, after A-Z became a-z. All work happens on the
Arrow buffers of a batch, in blocks of about BLOCK bytes cut between words, so
memory follows the block and not the longest text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RANDOM = np.random.default_rng(20260105)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """The batch in slices of about `most` bytes of text, a row at least, so that working arrays stay small."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    trimmed()


def trimmed() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per) of all words; per[i]: words before document i, with the total last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _SOLID[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word, the same for the same lower-cased bytes; `lower` says what becomes of each byte."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if j == i + 1 and hi - lo > BLOCK:  # one very long word, by pieces
            total = np.uint64(0)
            for at in range(lo, hi, BLOCK):
                part = lower[data[at : min(hi, at + BLOCK)]]
                place = _PLACE[np.arange(at - lo, at - lo + len(part)) % len(_PLACE)]
                with np.errstate(over="ignore"):
                    total += (_BYTE[part] * place * (np.uint64(2 * ((at - lo) // BLOCK)) + np.uint64(1))).sum(dtype=np.uint64)
            out[i] = total + np.uint64(hi - lo) * _MIX[0]
        else:
            block = data[lo:hi]
            begin = starts[i:j] - lo
            length = ends[i:j] - starts[i:j]
            gap = np.diff(np.append(begin, hi - lo))
            place = np.arange(hi - lo) - np.repeat(begin, gap)
            v = _BYTE[lower[block]] * _PLACE[place % len(_PLACE) if length.max() >= len(_PLACE) else np.minimum(place, len(_PLACE) - 1)]
            v[~_SOLID[block]] = 0
            out[i:j] = np.add.reduceat(v, begin) + length.astype(np.uint64) * _MIX[0]
        i = j
    return mixed(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one document; a shorter document is one run."""
    if not len(words):
        return words
    if len(words) < size:
        total = np.uint64(len(words)) * _MIX[7:8]  # arrays of one: they wrap around without a warning
        for k in range(len(words)):
            total = total + words[k : k + 1] * _MIX[1 + k % 6] + np.uint64(k // 6)
        return mixed(total)
    n = len(words) - size + 1
    total = np.full(n, 1, np.uint64) * np.uint64(size) * _MIX[7]
    for k in range(size):
        total += words[k : k + n] * _MIX[1 + k % 6] + np.uint64(k // 6)
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) > 1:
        keep = np.empty(len(values), dtype=bool)
        keep[0] = True
        np.not_equal(values[1:], values[:-1], out=keep[1:])
        values = values[keep]
    return values


def lists(values: np.ndarray, sizes, kind=pa.int64()) -> pa.Array:
    """A list array of `values`, cut by `sizes`."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
