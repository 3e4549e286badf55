"""Array kernels over the byte buffers of Arrow string columns.

Every kernel works on a slice of rows at a time, so that a task holds a few megabytes of text
however large its partition is; only a single text longer than a slice makes a slice grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes of a word in the sense of [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    _, offsets, data = binary.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), ends


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of rows of about ``limit`` bytes."""
    data, ends = buffers(column)
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of kept bytes; a run never crosses rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kept[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[:-1], starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BASE_INVERSE, np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    return powers, inverse


_KEPT: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base up to n and their inverses; those that a slice needs are kept."""
    if n > 2 * SLICE_BYTES:
        return _powers(n)
    if not _KEPT:
        _KEPT.append(_powers(2 * SLICE_BYTES))
    return _KEPT[0]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial modulo 2**64 and the inverse powers that align its differences."""
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), power[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return sums, inverse


def span_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte span; equal spans have equal hashes wherever they start."""
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and its row."""
    starts, ends, row = words(data, offsets, kept)
    sums, inverse = prefix_hashes(FOLD[data])
    return span_hashes(sums, inverse, starts, ends), row


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a row, and its row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : i + m]
    whole = row[:m] == row[n - 1 :]
    return mix(out[whole]), row[:m][whole]
