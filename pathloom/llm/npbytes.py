"""Vectorised work on the UTF-8 buffers of Arrow string columns (numpy, inside tasks)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xBF58476D1CE4E5B9)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def byte_class(chars: str | bytes, keep: bool = True) -> np.ndarray:
    """A table of 256 booleans: True for the bytes given (or for the others, if not keep)."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars if isinstance(chars, bytes) else chars.encode(), np.uint8)] = True
    return out if keep else ~out


#: Bytes of words: anything but ASCII white space.
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r", keep=False)
#: Bytes of the words that contamination is judged on: ASCII letters and digits, and all that is not ASCII.
ALNUM = np.array([b >= 0x80 or bytes([b]).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = np.cumprod(np.full(4096, _MULT, U64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << int(n).bit_length(), _MULT, U64))
    return _POWERS


def lower_az(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _MIX
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (n+1); a word never crosses rows."""
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    if len(data):
        stops[:-1] &= ~inside[1:]
        cut = edges[edges > 0] - 1
        stops[cut] = inside[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of ``data``; spans are in order and apart."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    total = np.cumsum(sizes)
    first = total - sizes
    at = np.arange(total[-1]) - np.repeat(first, sizes)
    values = _SEED[data[at + np.repeat(starts, sizes)]] * _powers(int(sizes.max()))[at]
    return mix(np.add.reduceat(values, first) + sizes.astype(U64))


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of ``h`` (length len(h)-k+1); the caller drops those that cross rows."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U64)
    for i in range(k if n > 0 else 0):
        out = out * _MULT + h[i : i + n]
    return mix(out + U64(k))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
