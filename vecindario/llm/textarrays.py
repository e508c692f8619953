"""Words and their hashes of whole Arrow batches, without a Python object per word.

A word is a run of bytes other than blanks (0x20, 0x09-0x0D); ASCII letters count as lower case. Texts
are taken in groups of about ``CHUNK`` bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

with np.errstate(over="ignore"):
    _STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, bits well spread."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
BETWEEN = _BLANK.copy()  # blanks and all ASCII marks
BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_BYTE = mixed(_FOLDED)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64))), dtype=np.uint64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(batch: pa.RecordBatch, column: str, limit: int = CHUNK, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` and at most ``rows`` rows, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1), start + rows)
        yield batch.slice(start, end - start)
        start = end
    release()


def release() -> None:
    """Give freed memory back to the system: worker processes live on from stage to stage, and so would their largest batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with the capital letters U+00C0..U+00DE as small ones; ASCII ones are folded by the hash."""
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    if len(after):
        data = data.copy()
        data[after] += 0x20
    return data


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the n + 1 offsets of the texts in that list."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~blank[data]
    cut = offsets[1:-1]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    touching = cut[(cut > 0) & (cut < len(data))]
    first[touching] |= inside[1:-1][touching]
    last[touching - 1] |= inside[1:-1][touching - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the n + 1 offsets of the texts in that list. ``blank`` marks the bytes between words."""
    starts, ends, at = word_bounds(data, offsets, blank)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), at
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values = _BYTE[data[~blank[data]]]
    place = np.arange(len(values)) - np.repeat(begin, sizes)
    values *= powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, begin) ^ (sizes.astype(np.uint64) << np.uint64(48))), at


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words within a text; a shorter text with a word gives one shingle of all its words."""
    sizes = np.diff(at)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(sizes.dtype))
    out_at = np.concatenate(([0], np.cumsum(counts)))
    if not out_at[-1]:
        return np.zeros(0, dtype=np.uint64), out_at
    padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    start = np.repeat(at[:-1], counts) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], counts)
    room = np.repeat(at[1:], counts) - start
    total = np.zeros(len(start), dtype=np.uint64)
    for j in range(width):
        word = padded[start + j]
        if (sizes < width).any():
            word = np.where(room > j, word, np.uint64(0))
        total = total * _BASE + word
    return mixed(total), out_at
