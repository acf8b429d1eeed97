"""Words of many texts at once, as numpy arrays over the UTF-8 buffer of an Arrow column.

A word is a maximal run of bytes other than space and tab to carriage return. Those are
single bytes in UTF-8, so words of bytes are words of characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone and whole.
PIECE = 1 << 20

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64), 77)
_STEP = 0xD6E8FEB86659FD93


_STEP_BACK = pow(_STEP, -1, 2**64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 of the hash's factor, and of its inverse; kept while they are few."""
    if _tables and len(_tables[0]) >= n:
        return _tables
    n = max(n, PIECE + 2)
    with np.errstate(over="ignore"):
        made = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, U64(x)))]) for x in (_STEP, _STEP_BACK)]
    if n <= PIECE + 2:
        _tables[:] = made
    return made


class Texts:
    """Rows ``lo`` to ``hi`` of a string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        kind = np.int64 if wide else np.int32
        if len(column):
            offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        else:
            offs = np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[offs[0] : offs[-1]]
        self.offsets = offs - offs[0]
        self.n = len(column)


class Words:
    """Bounds of the words of ``texts``: ``start`` and ``end`` in bytes, ``row`` of each
    word, and ``first``: where each row's words begin (one more than rows)."""

    def __init__(self, texts: Texts):
        b, offs = texts.bytes, texts.offsets
        solid = ~_SPACE[b]
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        ends = np.zeros(len(b) + 1, bool)
        ends[1:] = solid
        ends[:-1] &= ~solid
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(b))]
        starts[edge] = solid[edge]
        ends[edge] = solid[edge - 1]
        self.texts = texts
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(texts.n), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return segment_hashes(_LOWER[self.texts.bytes] if lower else self.texts.bytes, self.start, self.end)


def segment_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint, non-empty byte ranges."""
    if not len(start):
        return np.zeros(0, U64)
    forth, back = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, U64)
        np.cumsum(_BYTE[b] * forth[: len(b)], out=total[1:])
        # the sum of byte * factor ** (place in its range)
        sums = (total[end] - total[start]) * back[start]
        return mix(sums ^ mix((end - start).astype(U64), 5))


def windows(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words within a row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = mix(h[:n], 11)
        for j in range(1, k):
            out = mix(out * U64(0x9FB21C651E98DF25) + h[j : n + j], 11 + j)
    inside = words.row[:n] == words.row[k - 1 :]
    return words.row[:n][inside], out[inside]


def per_row(texts: Texts, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in ``mask``."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[texts.offsets])


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the lines that have a word."""
    texts = words.texts
    newline = texts.bytes == 10
    breaks = np.flatnonzero(newline)
    start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, texts.offsets[1:]]))
    row = np.repeat(np.arange(texts.n), per_row(texts, newline) + 1)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    return row[has], start[has], end[has]


def repeated(words: Words, h: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a run of ``k`` words that is twice or more in their row."""
    out = np.zeros(len(h), bool)
    if len(h) < k:
        return out
    inside = np.flatnonzero(words.row[: 1 - k] == words.row[k - 1 :])
    row, run = windows(words, h, k)
    order = np.lexsort((run, row))
    same = equal_to_last(row[order], run[order])
    again = same.copy()
    again[:-1] |= same[1:]
    at = inside[order[again]]
    for j in range(k):
        out[at + j] = True
    return out


def equal_to_last(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether an element equals the one before it in all keys."""
    out = np.zeros(len(sorted_keys[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in sorted_keys])
    return out


def distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of ``n`` rows has."""
    order = np.lexsort((value, row))
    return np.bincount(row[order][~equal_to_last(row[order], value[order])], minlength=n)


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``PIECE`` bytes of ``column``."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + PIECE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def of(batch: pa.RecordBatch, column: str) -> Texts:
    return Texts(batch.column(batch.schema.get_field_index(column)))
