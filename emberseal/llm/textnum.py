"""Numpy helpers over Arrow text columns: byte buffers, words and rolling fingerprints.

Every fingerprint is a polynomial hash modulo 2**64 with an odd base, finished
by a bit mixer. Prefix sums give the hash of any byte range in O(1).
Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial and of the mixer (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

#: Words are runs of bytes other than space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at a time, so that tables of powers don't grow with a text (but for a longer word or line).
SPAN = 1 << 21

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(MIX_1)
    x ^= x >> U64(33)
    x *= U64(MIX_2)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept for the life of the worker."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        up, down = np.full(size, BASE, U64), np.full(size, pow(BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes end to end, and the offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of data[start:end], the same wherever the bytes stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of data[start:end] of ordered ranges that don't overlap, some SPAN bytes at a time."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, side="right")))
        base = start[i]
        out[i:j] = range_hash(prefix_hash(data[base : end[j - 1]]), start[i:j] - base, end[i:j] - base)
        i = j
    return out


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each row."""
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() with the fingerprint of each word in front."""
    s, e, first = words(data, offs)
    return mix(hash_ranges(data, s, e)), s, e, first


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp fingerprints of every n consecutive values (rows not regarded)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= U64(BASE)
        out += hashes[j : j + count]
    return mix(out)


def starts_within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window of n words fits its row, and those rows."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return np.arange(counts.sum()) - before[rows] + first[:-1][rows], rows


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask over `size` positions of all that lie in [start, start + width)."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1) if len(starts) < 64 else steps.__iadd__(np.bincount(starts, minlength=size + 1).astype(np.int32))
    ends = np.minimum(starts + width, size)
    steps -= np.bincount(ends, minlength=size + 1).astype(np.int32)
    return np.cumsum(steps[:-1]) > 0
