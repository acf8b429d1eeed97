"""Personal data: fixed patterns, and a semi-Markov conditional random field.

Only stretches of words with a digit or an @ (joined by spaces, and by words of plain
punctuation) can hold any of it; a stretch is worked on alone, and the rest of a text costs
one pass over its bytes. Within a stretch the model scores whole candidate segments, up to
a bounded number of atoms, by features of the segment as a whole; a dynamic program over
segment ends chooses boundaries and types together and gives each segment its posterior.
Features are computed as arrays, for all segments that end in a window of atoms; the values
of the dynamic program are carried from window to window, so a stretch of any length takes
a bounded number of segments at once, and the result is that of the whole. It is trained on stretches that the patterns label, rewritten in other layouts too, so
that it finds what they miss.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm import spans as sp
from sievemill.llm import textbuf
from sievemill.llm.common import fresh, texts_by_hash

KINDS = ("email", "ip", "card", "phone")
#: Documents and stretches to train on, passes over them, the least posterior to report.
SAMPLE, STRETCHES, PASSES, POSTERIOR = 4000, 800, 25, 0.95
#: Most atoms and characters of a segment, and atoms of a window.
ATOMS, CHARS, WINDOW = 24, 80, 4096

_LOCAL = frozenset(sp.DIGITS + sp.UPPER + sp.LOWER + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT, _JOIN = sp.byte_class(sp.DIGITS + "@"), sp.byte_class("()+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in sp.DIGITS)


def base_spans(s: str) -> list[sp.Span]:
    """By kind as listed, then start."""
    out, at = [], 0
    for p in (m.start() for m in re.finditer("@", s)):
        a = p
        while a > at and s[a - 1] in _LOCAL:
            a -= 1
        if a < p and p >= at and (m := _DOMAIN.match(s, p + 1)):
            out.append(("email", a, m.end()))
            at = m.end()
    for m in _DOTTED.finditer(s):
        parts = m[0].split(".")
        a = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            z = a + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in four):
                out.append(("ip", a, z))
            a = z + 1
    for m in _CARD.finditer(s):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(s):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def stretches(texts: textbuf.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes."""
    words, b = textbuf.Words(texts), texts.bytes
    if not len(words.start):
        none = np.zeros(0, np.int64)
        return none, none, none

    def total(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)])

    hot_, join_ = total(_HOT[b]), total(_JOIN[b])
    hot = hot_[words.end] > hot_[words.start]
    usable = hot | (join_[words.end] - join_[words.start] == words.end - words.start)
    breaks = total(textbuf._SPACE[b] & (b != 0x20))
    goes_on = np.zeros(len(hot), bool)
    goes_on[1:] = usable[1:] & usable[:-1] & (words.row[1:] == words.row[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
    first = np.flatnonzero(usable & ~goes_on)
    last = np.flatnonzero(usable & ~np.append(goes_on[1:], False))
    some = total(hot)
    keep = some[last + 1] > some[first]
    first, last = first[keep], last[keep]
    return words.row[first], words.start[first], words.end[last]


class Segments:
    """Candidate segments of stretches (strings), which none crosses, and their features.

    Atoms are runs of ASCII letters, runs of ASCII digits, and other characters; a segment
    is a range of atoms, ``first`` to ``last`` inclusive.
    """

    def __init__(self, found: list[str]):
        codes = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.int32)
        size = np.array([len(s) for s in found], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        low = np.minimum(codes, 128).astype(np.uint8)

        def is_in(chars: str) -> np.ndarray:
            table = np.zeros(129, bool)
            table[[ord(c) for c in chars]] = True
            return table[low]

        def total(mask: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])

        letter, digit = is_in(sp.UPPER + sp.LOWER), is_in(sp.DIGITS)
        alpha, alnum = letter.copy(), letter | digit
        wide = np.flatnonzero(codes >= 128)
        if len(wide):
            each, inverse = np.unique(codes[wide], return_inverse=True)
            alpha[wide] = np.array([chr(c).isalpha() for c in each.tolist()])[inverse]
            alnum[wide] = np.array([chr(c).isalnum() for c in each.tolist()])[inverse]
        sort = letter + 2 * digit.astype(np.int8)
        begins = np.ones(len(codes), bool)
        begins[1:] = (sort[1:] != sort[:-1]) | (sort[1:] == 0)
        begins[edge[:-1][size > 0]] = True
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(codes))[: len(self.start)]
        self.stretch = np.searchsorted(edge, self.start, "right") - 1
        self.edge = edge
        self.n = n = len(self.start)
        self.word, self.number = alnum[self.start], digit[self.start]
        head = codes[self.start]
        self.opens = self.word | (head == ord("+")) | (head == ord("("))
        self.mark, self.dot = head == ord("@"), head == ord(".")
        length = self.end - self.start
        value = np.zeros(n, np.int64)
        for place in range(3):
            has = self.number & (length > place)
            value[has] = value[has] * 10 + codes[self.start[has] + place] - 48
        self.byte = self.number & (length <= 3) & (value <= 255)
        self.digits = np.concatenate([[0], np.cumsum(np.where(self.number, length, 0))])
        self.marks, self.numbers = total(self.mark), total(self.number)
        self.fours = total(self.number & (length == 4))
        # runs of digits by their order, and sums for Luhn's check by the place of a digit
        self.runs = np.append(length[self.number], [0, 0])
        d = codes[digit] - 48
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        even = np.arange(len(d)) % 2 == 0
        self.luhn = np.stack([np.concatenate([[0], np.cumsum(np.where(even, d, twice))]), np.concatenate([[0], np.cumsum(np.where(even, twice, d))])])
        self.n_local, self.n_alpha, self.n_letter = total(is_in("".join(_LOCAL))), total(alpha), total(letter)
        self.n_plain = total(is_in("0123456789 ().+-"))
        self.n_of = {c: total(is_in(c)) for c in " +.()-"}
        pair = np.zeros(len(codes), bool)
        pair[:-1] = (codes[:-1] == 32) & (codes[1:] == 32)
        self.n_pair = total(pair)
        dots = np.zeros(len(codes), bool)
        dots[:-1] = (codes[:-1] == 46) & (codes[1:] == 46)
        self.n_dots = total(dots)
        at = np.arange(len(codes), dtype=np.int32)
        self.last_mark = np.maximum.accumulate(np.where(codes == ord("@"), at, np.int32(-1))) if len(codes) else at
        self.last_dot = np.maximum.accumulate(np.where(codes == ord("."), at, np.int32(-1))) if len(codes) else at
        self.is_dot = codes == ord(".")
        # of the character at a place: blank, or one that goes on as a word
        self.blank = codes == 32
        self.before = alnum | is_in("+.@-_%")
        self.after = alnum | is_in("@-_")
        self.plus = codes == ord("+")

    def candidates(self, lo: int, hi: int, by_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of the segments whose last, or else first, atom is in lo to hi - 1;
        ordered by it, shorter ones first."""
        there = np.arange(lo, min(hi, self.n))[:, None]
        other = there + (-1 if by_end else 1) * np.arange(ATOMS)
        ok = (other >= 0) & (other < self.n)
        other = np.clip(other, 0, max(self.n - 1, 0))
        i, j = (other, there) if by_end else (there, other)
        ok &= self.opens[i] & self.word[j] & (self.stretch[i] == self.stretch[j]) & (self.end[j] - self.start[i] <= CHARS)
        ok &= (self.digits[j + 1] - self.digits[i] >= 4) | ((self.marks[j + 1] > self.marks[i]) & (j > i))
        row, column = np.nonzero(ok)
        here, there = there[row, 0], other[row, column]
        return (there, here) if by_end else (here, there)

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of whole segments and the characters beside them; a row for each."""
        a, z = self.start[i], self.end[j]
        size = z - a

        def count(total: np.ndarray) -> np.ndarray:
            return total[z] - total[a]

        n = self.digits[j + 1] - self.digits[i]
        marks = self.marks[j + 1] - self.marks[i]
        one = marks == 1
        at = self.last_mark[z - 1]  # of a segment with a single @
        local = one & (at > a) & (self.n_local[np.maximum(at, a)] - self.n_local[a] == at - a)
        b = np.where(one, at + 1, z)  # the domain
        dot = self.last_dot[z - 1]
        tail = np.where(one & (dot >= b), z - dot - 1, 0)
        domain = one & (dot >= b) & (self.n_local[z] - self.n_local[b] == z - b) & ~self.is_dot[np.minimum(b, z - 1)]
        domain &= (self.n_dots[np.maximum(z - 1, b)] - self.n_dots[b] == 0) & (tail > 1)
        domain &= self.n_letter[z] - self.n_letter[z - tail] == tail
        plus, opened, closed, dashes, dots = (count(self.n_of[c]) for c in "+()-.")
        first_plus = self.plus[a]
        groups = self.numbers[j + 1] - self.numbers[i]
        end = self.numbers[j + 1]
        parity = (self.digits[j + 1] - 1) % 2
        check = self.luhn[parity, self.digits[j + 1]] - self.luhn[parity, self.digits[i]]
        long = (n >= 13) & (n <= 19)
        four = j - i == 6
        for k in range(7):
            four &= (self.dot if k % 2 else self.byte)[np.minimum(i + k, self.n - 1)]
        plain = count(self.n_plain) == size
        left, right = a == self.edge[self.stretch[i]], z == self.edge[self.stretch[i] + 1]
        l_at, r_at = np.maximum(a - 1, 0), np.minimum(z, len(self.plus) - 1)
        return np.stack(
            [
                np.ones(len(i), bool),
                one,
                marks > 1,
                local,
                domain,
                count(self.n_of[" "]) > 0,
                first_plus,
                plus > first_plus,
                n < 7,
                (n >= 7) & (n <= 9),
                (n >= 10) & (n <= 11),
                n == 12,
                long,
                n > 19,
                long & (check % 10 == 0),
                four,
                ~four & (dots >= 2),
                count(self.n_alpha) > 0,
                opened > 0,
                opened != closed,
                dashes > 0,
                (groups > 1) & (self.runs[end - 1] == 4) & (self.runs[end - 2] == 3),
                (groups > 1) & (self.fours[j + 1] - self.fours[i] == groups),
                plain,
                ~plain & (marks == 0),
                left | self.blank[l_at],
                right | self.blank[r_at],
                ~left & self.before[l_at],
                ~right & self.after[r_at],
                groups > 5,
                self.n_pair[z - 1] - self.n_pair[a] > 0,
            ],
            1,
        ).astype(float)


FEATURES = 31


def likely(found: list[str], w: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(stretch, kind, start, end) of the segments of the best way to cut each stretch whose
    posterior is ``POSTERIOR`` or more."""
    seg = Segments(found)
    n = seg.n

    def scored(lo: int, hi: int, by_end: bool) -> tuple:
        i, j = seg.candidates(lo, hi, by_end)
        score = seg.features(i, j) @ w.T
        kind = score.argmax(1) if len(score) else np.zeros(0, np.int64)
        weight = np.exp(np.minimum(score, 40.0)).sum(1)  # of so high a score no other way matters
        best = score[np.arange(len(score)), kind]
        return i.tolist(), (j + 1).tolist(), weight.tolist(), kind.tolist(), best.tolist()

    # sums over the ways to cut what is before an atom, scaled: ahead * exp(scale)
    ahead, scale, top, off = np.ones(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0.0
    via, via_kind, via_score = np.full(n + 1, -1), np.zeros(n + 1, np.int8), np.zeros(n + 1)
    kept = None
    for lo in range(0, n, WINDOW):
        i_, t_, weight, kind, best = kept = scored(lo, lo + WINDOW, True)
        base, hi = max(0, lo - ATOMS), min(lo + WINDOW, n)
        sums, offs, tops = (x[base : lo + 1].tolist() for x in (ahead, scale, top))
        k, most = 0, len(i_)
        for t in range(lo + 1, hi + 1):
            total, high = sums[-1], tops[-1]
            while k < most and t_[k] == t:
                i = i_[k] - base
                total += sums[i] * weight[k]
                if tops[i] + best[k] > high:
                    high = tops[i] + best[k]
                    via[t], via_kind[t], via_score[t] = i_[k], kind[k], best[k]
                k += 1
            sums.append(total)
            tops.append(high)
            offs.append(off)
            if total > 1e60:
                off += math.log(total)
                for b in range(max(0, t - base - ATOMS), t - base + 1):
                    sums[b] /= total
                    offs[b] = off
        ahead[base : hi + 1], scale[base : hi + 1], top[base : hi + 1] = sums, offs, tops
    way, t = [], n
    while t:
        if via[t] < 0:
            t -= 1
        else:
            way.append((int(via[t]), t, int(via_kind[t]), float(via_score[t])))
            t = int(via[t])
    if not way:
        return []
    whole = math.log(ahead[n]) + scale[n]
    back, back_scale, off = np.ones(n + 1), np.zeros(n + 1), 0.0
    for lo in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
        if n <= WINDOW:  # the same ones, by their first atom
            order = sorted(range(len(kept[0])), key=kept[0].__getitem__)
            i_, t_, weight = ([c[k] for k in order] for c in kept[:3])
        else:
            i_, t_, weight, *_ = scored(lo, lo + WINDOW, False)
        hi = min(lo + WINDOW, n)
        last = min(hi + ATOMS, n)
        sums, offs = [0.0] * (hi - lo) + back[hi : last + 1].tolist(), [0.0] * (hi - lo) + back_scale[hi : last + 1].tolist()
        k = len(i_) - 1
        for t in range(hi - 1, lo - 1, -1):
            total = sums[t + 1 - lo]
            while k >= 0 and i_[k] == t:
                total += sums[t_[k] - lo] * weight[k]
                k -= 1
            sums[t - lo], offs[t - lo] = total, off
            if total > 1e60:
                off += math.log(total)
                for b in range(t - lo, min(last, t + ATOMS) - lo + 1):
                    sums[b] /= total
                    offs[b] = off
        back[lo : last + 1], back_scale[lo : last + 1] = sums, offs
    out = []
    for i, t, kind, score in reversed(way):
        log = math.log(ahead[i]) + scale[i] + score + math.log(back[t]) + back_scale[t] - whole
        if log >= math.log(POSTERIOR):
            own = int(seg.stretch[i])
            begin = int(seg.edge[own])
            out.append((own, KINDS[kind], int(seg.start[i]) - begin, int(seg.end[t - 1]) - begin))
    return out


class Lattice:
    """The candidate segments of a stretch with their features."""

    def __init__(self, s: str):
        seg = Segments([s])
        self.cuts = list(zip(seg.start.tolist(), seg.end.tolist(), strict=True))
        i, j = seg.candidates(0, seg.n, False)
        self.segments = list(zip(i.tolist(), j.tolist(), strict=True))
        self.x = seg.features(i, j).reshape(-1, FEATURES)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w.T

    def posteriors(self, score: np.ndarray) -> tuple[np.ndarray, float]:
        """The probability of every (segment, type), and the log of the sum over all
        ways to cut the stretch; an atom outside of segments scores 0."""
        n = len(self.cuts)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(self.segments):
            ends[j + 1].append(k)
            starts[i].append(k)
        high = score.max(1) if len(score) else score
        each = high + np.log(np.exp(score - high[:, None]).sum(1)) if len(score) else np.zeros(0)
        each_ = each.tolist()

        def add(values: list[float]) -> float:
            m = max(values)
            return m + math.log(sum(math.exp(v - m) for v in values))

        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            ahead[t] = add([ahead[t - 1], *(ahead[self.segments[k][0]] + each_[k] for k in ends[t])]) if ends[t] else ahead[t - 1]
        for t in range(n - 1, -1, -1):
            back[t] = add([back[t + 1], *(back[self.segments[k][1] + 1] + each_[k] for k in starts[t])]) if starts[t] else back[t + 1]
        whole = ahead[n]
        if not len(score):
            return score, whole
        outer = np.array([ahead[i] + back[j + 1] - whole for i, j in self.segments])
        return np.exp(np.minimum(score + outer[:, None], 0.0)), whole

    def best(self, score: np.ndarray) -> list[tuple[int, int]]:
        """The (segment, type) pairs of the best way to cut the stretch."""
        n = len(self.cuts)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(self.segments):
            ends[j + 1].append(k)
        kind = score.argmax(1) if len(score) else []
        top: list[float] = [0.0] * (n + 1)
        via: list[int] = [-1] * (n + 1)
        for t in range(1, n + 1):
            top[t] = top[t - 1]
            for k in ends[t]:
                v = top[self.segments[k][0]] + score[k, kind[k]]
                if v > top[t]:
                    top[t], via[t] = v, k
        out, t = [], n
        while t:
            if via[t] < 0:
                t -= 1
            else:
                out.append((via[t], int(kind[via[t]])))
                t = self.segments[via[t]][0]
        return out[::-1]


_MADE = ["12345", "2024-05-17", "10:30", "v1.2.3", "x 1999 y", "3.14159", "100 200 300", "a1b2c3", "+1 (212) 555-0147", "4111111111111111", "10.0.0.1", "ab.cd@example.com", "12.05.2024", "1,234,567"]


def _layouts(phone: str, mark: str) -> list[str]:
    d = _digits(phone)
    tail = f"{d[-10:-7]}{mark}{d[-7:-4]}{mark}{d[-4:]}"
    return [phone, phone[1:], tail, f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", "+" + tail]


def _unlabelled(found: list[str]) -> re.Pattern:
    """What is laid out as another form of a phone in ``found`` or ``_MADE``, of three or
    more groups of digits: bare numbers are left to the model."""
    phones = {s[a:z] for s in [*found, *_MADE] for kind, a, z in base_spans(s) if kind == "phone"}
    shapes = {re.sub("[0-9]", "0", e) for phone in phones for mark in " -." for e in _layouts(phone, mark)[1:]}
    wanted = sorted((e for e in shapes if len(re.findall("0+", e)) > 2), key=lambda e: (-len(e), e))
    return re.compile("(?<![A-Za-z0-9])(?:" + ("|".join(re.escape(e).replace("0", "[0-9]") for e in wanted) or "(?!)") + ")(?![A-Za-z0-9])")


def _certain(s: str, unlabelled: re.Pattern) -> list[str]:
    """The parts of a stretch beside what may be a phone that the patterns miss."""
    out, at, spans = [], 0, base_spans(s)
    for m in unlabelled.finditer(s):
        if all(m.end() <= a or m.start() >= z for _, a, z in spans):
            out.append(s[at : m.start()])
            at = m.end()
    return [*out, s[at:]]


def _rewritten(rng: random.Random, s: str, spans: list[sp.Span]) -> tuple[str, list[sp.Span]]:
    """A stretch with its entities in other layouts, or spoiled and then without label."""
    out, labels, at = "", [], 0
    for kind, a, z in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        out += s[at:a]
        e, keep = s[a:z], True
        turn = rng.random()
        if kind == "phone":
            d = _digits(e)
            e = rng.choice(_layouts(e, rng.choice([" ", "-", "."])))
            if turn < 0.15:
                e, keep = d[-6:], False
        elif kind == "card":
            d = _digits(e)
            e = rng.choice([d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])
            if turn < 0.3:
                e, keep = e[:-1] + str((int(e[-1]) + rng.randint(1, 9)) % 10), False
        elif kind == "ip" and turn < 0.3:
            e, keep = e.rsplit(".", 1)[0] + rng.choice([".999", ""]), False
        elif kind == "email" and turn < 0.15:
            e, keep = e.replace("@", rng.choice(["@@", " @ ", ""])), False
        if keep:
            labels.append((kind, len(out), len(out) + len(e)))
        out += e
        at = z
    return out + s[at:], labels


def fit(found: list[str], passes: int = PASSES, seed: int = 5) -> np.ndarray:
    """Weights (type, feature) of largest regularized likelihood over ``found``, labelled by
    the patterns, and rewritten forms of it. What looks like such a form and has no label is
    left out: it may be an entity."""
    rng = random.Random(seed)
    data = []
    found = [s for s in [*found, *_MADE] if len(s) <= 400]
    unlabelled = _unlabelled(found)
    for s in (part for s in found for part in _certain(s, unlabelled)):
        spans = base_spans(s)
        for text, labels in [(s, spans), _rewritten(rng, s, spans)]:
            if text.strip():
                data.append((text, labels))
    prepared = []
    for s, labels in data:
        lattice = Lattice(s)
        index = {seg: k for k, seg in enumerate(lattice.segments)}
        start = {a: i for i, (a, _) in enumerate(lattice.cuts)}
        end = {z: j for j, (_, z) in enumerate(lattice.cuts)}
        gold, used = [], 0
        for kind, a, z in sorted(labels, key=lambda x: (x[1], -x[2])):
            k = index.get((start.get(a, -1), end.get(z, -1)))
            if k is not None and a >= used:
                gold.append((k, KINDS.index(kind)))
                used = z
        if lattice.segments:
            prepared.append((lattice, gold))
    w = np.zeros((len(KINDS), FEATURES))
    step = np.full_like(w, 1e-6)
    for p in range(passes):
        order = list(range(len(prepared)))
        rng.shuffle(order)
        for lo in range(0, len(order), 64):
            g = 1e-3 * w
            for k in order[lo : lo + 64]:
                lattice, gold = prepared[k]
                post, _ = lattice.posteriors(lattice.scores(w))
                g = g + post.T @ lattice.x
                for seg, kind in gold:
                    g[kind] -= lattice.x[seg]
            step += g * g
            w = w - 0.5 * g / np.sqrt(step)
    return w


def train(docs: DataFrame, sample: int = SAMPLE, most: int = STRETCHES) -> np.ndarray:
    """On at most ``most`` stretches of at most ``sample`` documents, taken by a hash; those
    with what ``fit`` would leave out come last."""
    rows = texts_by_hash(docs, sample, F.col("text").rlike("[0-9@]"), over=10)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                texts = textbuf.of(part, "text")
                found = {texts.bytes[a:z].tobytes().decode() for _, a, z in zip(*stretches(texts), strict=True) if z - a <= 400}
                yield pa.RecordBatch.from_pydict({"s": sorted(found)}, schema=pa.schema([("s", pa.string())]))

    got = rows.mapInArrow(split, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(4 * most).collect()
    found = [r["s"] for r in got]
    unlabelled = _unlabelled(found)
    return fit(sorted(found, key=lambda s: len(_certain(s, unlabelled)) > 1)[:most])


def found_in(s: str, w: np.ndarray) -> tuple[list[sp.Span], list[sp.Span]]:
    """The patterns' spans of a stretch, and what the model adds."""
    base = base_spans(s)
    return base, sp.apart(base, [(kind, a, z) for _, kind, a, z in likely([s], w)])


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_more", T.LongType())]
)


def scan(texts: textbuf.Texts, w: np.ndarray) -> list[tuple[list[sp.Span], list[sp.Span]]]:
    """For every row the patterns' spans and the model's, each by kind, then start."""
    out: list[tuple[list, list]] = [([], []) for _ in range(texts.n)]
    rows, start, end = stretches(texts)
    chars = sp.Chars(texts)
    data = texts.bytes.tobytes()
    found = [data[a:z].decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
    more: dict[int, list[sp.Span]] = {}
    for k, kind, a, z in likely(found, w):
        more.setdefault(k, []).append((kind, a, z))
    for k, (r, a) in enumerate(zip(rows.tolist(), start.tolist(), strict=True)):
        at, base = chars.at(r, a), base_spans(found[k])
        for to, spans in zip(out[r], (base, sp.apart(base, more.get(k, []))), strict=True):
            to += [(kind, at + x, at + y) for kind, x, y in spans]
    for pair in out:
        for spans in pair:
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def _find(shared, keep: int, names: list[str], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in textbuf.pieces(batch, batch.schema.names[keep]):
                text = part.column(keep)
                got = scan(textbuf.Texts(text), w)
                if redact:
                    changed = [k for k, (a, b) in enumerate(got) if a or b]
                    mask = np.zeros(part.num_rows, bool)
                    mask[changed] = True
                    new = [redacted(text[k].as_py(), [*got[k][0], *got[k][1]]) for k in changed]
                    text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
                    yield pa.RecordBatch.from_arrays([*part.columns[:keep], text], names)
                    continue
                cols: list[list] = [[] for _ in _FOUND]
                for base, more in got:
                    every = sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1]))
                    row = [sum(s[0] == k for s in base) for k in KINDS] + [sp.digest(base), sp.joined(every), len(more)]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                found = pa.StructArray.from_arrays(
                    [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(cols, _FOUND, strict=True)], _FOUND.names
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], found], names)

    return run


def redacted(text: str, spans: list[sp.Span]) -> str:
    """Every span replaced by its kind in brackets; spans that overlap, by the first's."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, w: np.ndarray, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``name`` of what is found in the text.

    ``spans`` has the patterns' spans and those of the model that overlap none of them, by
    kind, then start. A null or empty text has none. Rows that repeat have the same; an
    empty table gives an empty result. A very long text is worked on alone and whole, its
    segments by windows. Columns that aren't in ``keep`` are not looked at, so they may have
    any names.
    """
    text = fresh(docs, "__text")
    cols = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(text))
    schema = T.StructType([*cols.schema.fields[:-1], T.StructField(name, _FOUND)])
    shared = docs.sparkSession.sparkContext.broadcast(w)
    return cols.mapInArrow(_find(shared, len(keep), schema.names, False), schema)


def redact(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """``docs`` with all that ``find`` finds replaced; an ``n_chars`` column follows."""
    columns, text = docs.columns, fresh(docs, "__text")
    cols = docs.withColumn(text, F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(w)
    out = cols.mapInArrow(_find(shared, len(columns), cols.schema.names, True), cols.schema)
    new = {"text": F.col(text), "n_chars": F.length(text)}
    return out.select(*(new[c].cast(t).alias(c) if c in new and c in columns else F.col(f"`{c}`") for c, t in docs.dtypes))
