"""Words and shingles of many texts at once: numpy over the bytes of Arrow string columns.

A word is a run of bytes without ASCII white space. Its 64-bit hash is a
polynomial over a random byte table, taken from prefix sums modulo 2**64 (the
base is odd, so its powers can be divided out), then mixed; equal words have
equal hashes wherever they stand. Work is cut into slices of whole texts of
about SLICE bytes, so memory follows the slice or the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For terms: everything in ASCII but letters and digits parts words.
TERM_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept up to two slices."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, SLICE + (1 << 18))
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if size <= 2 * SLICE:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of texts lo to hi - 1 of a batch: hash, text number from 0, place in the slice's bytes."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Word k of text i is at bounds[i] + k."""
        return np.searchsorted(self.doc, np.arange(self.hi - self.lo + 1))


def trim() -> None:
    """Gives freed memory back to the system: a worker stays for the stages after its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: What drops the caches that a worker keeps for tasks of its own kind; called when it begins work of another.
other_work: list[Callable[[], None]] = []


def words(column: pa.Array, lower: bool = True, breaks: np.ndarray = _SPACE) -> Iterator[Words]:
    for drop in other_work:
        drop()
    data, offsets = raw(column)
    for lo, hi in slices(offsets):
        a, b = offsets[lo], offsets[hi]
        d, o = data[a:b], offsets[lo : hi + 1] - a
        n = len(d)
        inside = ~breaks[d]
        edge = np.zeros(n + 1, bool)
        edge[o] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~inside[:-1]
            after[:-1] = ~inside[1:]
            before |= edge[:-1]
            after |= edge[1:]
        start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[d] * up[:n], out=sums[1:], dtype=np.uint64)
        h = mix((sums[end] - sums[start]) * down[start])
        doc = np.searchsorted(o, start, side="right") - 1
        del inside, edge, before, after, up, down, sums  # else they wait here while the words are used
        yield Words(lo, hi, d, o, h, doc, start, end)
    trim()


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct words of each text, sorted."""
    b = w.bounds
    sets = [np.unique(w.hash[b[i] : b[i + 1]]) for i in range(w.hi - w.lo)]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def shingles(w: Words, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct ``size``-word shingles of each text, sorted; a shorter text's whole sequence is one."""
    h, bounds = w.hash, w.bounds
    n = len(h)
    acc = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        acc += h[k : n - size + 1 + k] * np.uint64((2 * k + 3) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    acc = mix(acc)
    sets = []
    for i in range(w.hi - w.lo):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            sets.append(np.unique(acc[a : b - size + 1]))
        elif b > a:
            short = int(b - a)
            for x in h[a:b]:
                short = int(mix(np.array([short * 31 + int(x) & (1 << 64) - 1], np.uint64))[0])
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
