"""Spans in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np

from sievemill.llm import textbuf

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of ``more`` that overlap none of ``base`` and none before them in ``more``.

    Spans of ``base`` may overlap each other; those of ``more`` that are taken don't, so a
    span is held against its neighbours alone."""
    covered: list[tuple[int, int]] = []  # what base covers, in order
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if covered and a < covered[-1][1]:
            covered[-1] = covered[-1][0], max(b, covered[-1][1])
        else:
            covered.append((a, b))
    starts = [a for a, _ in covered]
    ascending = all(x[1] <= y[1] for x, y in zip(more, more[1:], strict=False))
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for s in more:
        k = bisect.bisect_left(starts, s[2]) - 1  # the last that begins before its end
        if k >= 0 and covered[k][1] > s[1]:
            continue
        if ascending:
            if out and out[-1][2] > s[1]:
                continue
        else:
            k = bisect.bisect_left(taken, (s[2], -1)) - 1
            if k >= 0 and taken[k][1] > s[1]:
                continue
            bisect.insort(taken, s[1:])
        out.append(s)
    return out


class Chars:
    """From byte offsets to code points within a row."""

    def __init__(self, texts: textbuf.Texts):
        self.before = np.concatenate([[0], np.cumsum((texts.bytes & 0xC0) != 0x80)])
        self.offsets = texts.offsets

    def at(self, row: int, byte: int) -> int:
        return int(self.before[byte] - self.before[self.offsets[row]])


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, cut at the rows' edges: (start, end)."""
    starts, ends = mask.copy(), np.zeros(len(mask) + 1, bool)
    starts[1:] &= ~mask[:-1]
    ends[1:] = mask
    ends[:-1] &= ~mask
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(mask))]
    starts[edge] = mask[edge]
    ends[edge] = mask[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
