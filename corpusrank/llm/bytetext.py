"""Vectorised text kernels over the UTF-8 bytes of an Arrow string column.

Words, lines and n-grams are found and hashed with numpy on the column's own buffer; no Python
string is made per word.  A span's hash is a polynomial in a random 64-bit value per byte, read off
one prefix sum, so every span costs the same whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = ~_SPACE
"""Bytes of words ``[^\\x20\\x09-\\x0D]+``."""

_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[0x80:] = False
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _NOT_ALNUM[_low : _high + 1] = False
ALNUM = ~_NOT_ALNUM


def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=U64, endpoint=True)
    if fold_case:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, _BASE, U64)
        step[0] = 1
        _powers = np.cumprod(step)
        step[1:] = pow(_BASE, -1, 2**64)
        _inverses = np.cumprod(step)
    return _powers[:n], _inverses


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system, so that idle workers of an executor don't hold what a running one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def kept_memory() -> Iterator[None]:
    """Keep freed memory in the process while numpy makes and drops arrays of the same sizes again and again; it is given back at the end."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is None:
        yield
        return
    option(-3, 1 << 30)  # M_MMAP_THRESHOLD
    option(-1, 1 << 30)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        option(-3, 128 << 10)
        option(-1, 128 << 10)
        give_back()


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``max_bytes`` of text, so that numpy's temporaries stay small.

    A single longer text is a piece of its own; texts are never cut.
    """
    data, offsets = column_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which the table ``inside`` holds: starts, ends and row of each."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = inside[data]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    heads = offsets[:-1]
    heads = heads[heads < n]
    begins[heads] |= member[heads]
    stops = member.copy()
    stops[:-1] &= ~member[1:]
    tails = offsets[1:]
    tails = tails[tails > 0] - 1
    stops[tails] |= member[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, split at every newline: starts, ends (without it) and row of each.

    An empty text has one empty line.
    """
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    if len(starts):
        last = np.ones(len(rows), bool)
        last[:-1] = rows[1:] != rows[:-1]
        ends[last] = offsets[rows[last] + 1]
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of spans; equal bytes (A-Z as a-z where ``fold_case``) have equal hashes."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = _VALUES[fold_case][data]
    sums *= powers[: len(data)]
    np.cumsum(sums, out=sums)
    up_to = lambda at: np.where(at > 0, sums[at - 1], U64(0)) if len(sums) else np.zeros(len(at), U64)
    hashed = (up_to(ends) - up_to(starts)) * inverses[starts]
    return mix(hashed + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` consecutive words within a row, and the index of each one's first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:count] == rows[size - 1 :])
    hashed = np.full(len(first), size, U64)
    for k in range(size):
        hashed = mix(hashed * U64(0x9FB21C651E98DF25) + words[first + k])
    return hashed, first


def in_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same row."""
    return mix(hashes + mix(rows.astype(U64) + U64(0x632BE59BD9B4E019)))


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
