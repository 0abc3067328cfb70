"""Vectorised words, word hashes and shingles of Arrow text columns.

Words are runs of bytes other than the six ASCII white-space characters;
hashes fold A-Z to a-z. All hashes are fixed functions of the bytes, so any
task on any machine computes the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_Q = U(0xD6E8FEB86659FD93)
_INV = U(pow(int(_P), -1, 1 << 64))
_NONWS = np.ones(256, bool)
_NONWS[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint64) + U(1)
_LOWER[65:91] += U(32)
_EXACT = np.arange(256, dtype=np.uint64) + U(1)
_WINDOW = 1 << 20
_powers: dict[str, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """run, a mapInArrow function, and then give the memory it no longer needs back to the system: workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own; other libraries have none
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        a = np.full(max(n, _WINDOW * 2), base, np.uint64)
        a[0] = 1
        have = _powers[name] = np.cumprod(a, dtype=np.uint64)
    return have


def slices(column: pa.Array, size: int = 2 << 20, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of pieces of about size bytes; a longer text is a piece of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buf = column.buffers()
    offs = np.frombuffer(buf[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = max(i + 1, min(j, i + rows, n))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    ok = _NONWS[b]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ok[:-1]
    cut = o[1:-1]
    before[cut[cut < n]] = False
    start = np.flatnonzero(ok & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ok[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(ok & ~after) + 1
    return start, end, np.searchsorted(start, o)


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, from polynomial prefix sums over windows of bytes."""
    out = np.empty(len(start), np.uint64)
    codes = _LOWER if fold else _EXACT
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _WINDOW)))
        lo, hi = int(start[i]), int(end[j - 1])
        power, back = _power("p", _P, hi - lo + 1), _power("i", _INV, hi - lo + 1)
        acc = np.empty(hi - lo + 1, np.uint64)
        acc[0] = 0
        np.cumsum(codes[b[lo:hi]] * power[: hi - lo], out=acc[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (acc[e] - acc[s]) * back[s] + (e - s).astype(np.uint64) * _Q
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (over text ends too; the caller masks those)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _Q
        out += h[i : i + n]
    return mix(out + U(k))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text as (row << 52 | 52-bit hash), and their row offsets.

    A text with 1 to k-1 words has its whole word sequence as its one shingle;
    a text without words has none. At most 4096 texts.
    """
    n = len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(n, dtype=np.uint64), count)
    parts = []
    if len(h) >= k:
        g = grams(h, k)
        whole = row[: len(g)] == row[k - 1 :]
        parts.append((row[: len(g)][whole] << U(52)) | (g[whole] >> U(12)))
    for size in range(1, k):
        rows = np.flatnonzero(count == size)
        if len(rows):
            g = np.zeros(len(rows), np.uint64)
            for i in range(size):
                g = g * _Q + h[first[rows] + i]
            parts.append((rows.astype(np.uint64) << U(52)) | (mix(g + U(size)) >> U(12)))
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    keys.sort()
    if len(keys):
        keep = np.empty(len(keys), bool)
        keep[0] = True
        np.not_equal(keys[1:], keys[:-1], out=keep[1:])
        keys = keys[keep]
    return keys, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << U(52))


def text_shingles(column: pa.Array, k: int, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, b, o in slices(column):
        start, end, first = spans(b, o)
        keys, offs = shingles(hashes(b, start, end, fold), first, k)
        yield i, j, keys, offs
