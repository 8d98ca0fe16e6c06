"""Vectorised work on Arrow text columns: words, lines and 64-bit hashes computed over whole batches of bytes.

A batch is cut into runs of rows of about ``CHUNK`` bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BYTE_KEY = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: their bytes and their offsets, from 0."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(size: int, base: int) -> np.ndarray:
    return _powers(max(2 * CHUNK, 1 << int(size).bit_length()), base)[:size]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums; equal bytes have equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEY[data] * powers(len(data), _BASE), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(len(data) + 1, _BASE_INV)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in ``apart``, and the first word of each row (rows + 1)."""
    inside = ~apart[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the hashes of all words with A-Z in lower case, and the first word of each row (rows + 1)."""
    for data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        yield span_hash(data, starts, ends), first


def owner(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fold(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash for an ordered tuple of hashes."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + p)
    return out


def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the first value of each row."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
