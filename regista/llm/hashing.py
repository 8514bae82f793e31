"""Vectorised word hashes of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at a time; a word is never cut.
CHUNK = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; sums and products wrap."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(salt))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; a null is an empty row."""
    column = pa.array(column, pa.large_string()) if not isinstance(column, pa.Array) else column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and where each row's words start.

    A word is a run of bytes that aren't in space; bytes go through lower first.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    is_space = space[raw]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, is_space[:-1]
    before[filled] = True
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, is_space[1:]
    after[filled[filled > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~is_space), np.flatnonzero(after & ~is_space) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        high = ends[last - 1]
        powers = np.ones(high - low + 1, dtype=np.uint64)
        powers[1:] = BASE
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((lower[raw[low:high]].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        inverse = np.full(high - low + 1, BASE_INVERSE, dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        s, e = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mix(hashes), np.searchsorted(starts, offsets)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
