"""Words and shingles of an Arrow string column as numpy arrays, many documents at once.

Small helpers for code that runs inside tasks: a batch is handled in slices of a few megabytes, so memory is
bounded whatever the number and length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte, and an odd base with its inverse: hashes of spans from prefix sums.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``most`` bytes; null counts as empty.

    A single text over the limit comes as a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that are not ``between`` (white space); runs end with their row."""
    word = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, word[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span that depends on its bytes only."""
    return span_hashes_of(_BYTE[data], starts, ends)


def span_hashes_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same over any 64-bit values, such as hashed characters."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(values), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=sums[1:])
    back = np.full(int(starts[-1]) + 1, _BASE_INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width`` consecutive words of a row; a row with fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    sums = np.zeros(len(words), np.uint64)
    used = np.zeros(len(words), np.uint64)
    for k in range(width):
        here = slice(0, max(len(words) - k, 0))
        same = rows[here] == rows[k:]
        sums[here] += np.where(same, mix64(words[k:] + np.uint64(k * 0x51ED27)), np.uint64(0))
        used[here] += same
    first = np.ones(len(words), bool)
    first[1:] = rows[1:] != rows[:-1]
    full = used == width
    keep = full | (first & (counts[rows] < width)) if len(words) else full
    return mix64(sums[keep] + used[keep]), rows[keep]
