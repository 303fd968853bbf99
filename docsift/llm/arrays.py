"""Vectorised work on the bytes of Arrow string columns: words and their hashes, without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def releasing(run):
    """A function over batches that gives the memory it took back to the system when it ends: workers live on, idle."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = np.cumprod(steps)
        if n > 1 << 22:  # for one very long text only
            return have
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about max_bytes; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words [^\\x20\\x09-\\x0D]+, and the text that each is of."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    space = SPACE[data]
    first, last = np.empty_like(space), np.empty_like(space)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = last[cut - 1] = True
    starts = np.flatnonzero(~space & first)
    return starts, np.flatnonzero(~space & last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each word's bytes; those of two bases are independent."""
    inverse = INVERSE if base == BASE else U(pow(int(base), -1, 2**64))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(inverse, len(data)), out=sums[1:])
    return mix(((sums[ends] - sums[starts]) * powers(base, len(data) + 1)[starts]) ^ mix((ends - starts).astype(U) + (base - BASE)))


def windows(hashes: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hashes of every window of so many consecutive hashes, by prefix sums modulo 2**64."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    inverse = INVERSE if base == BASE else U(pow(int(base), -1, 2**64))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * powers(inverse, len(hashes)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(base, len(hashes) + 1)[:n])
