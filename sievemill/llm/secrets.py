"""Secrets: fixed patterns, and strings that look random to character Markov models.

Two first-order models over bytes are trained: one of random strings (secrets that the
patterns find in a labelled sample, and strings drawn at random from usual alphabets) and
one of ordinary identifiers (words of the sample, alone and joined). A candidate is a long
run of key characters of at least two classes of digit, upper and lower case, or with many
letters of one case, or a shorter one with digits and letters; the method takes it if the
log-likelihood ratio a character is above a threshold. Words of the sample may be secrets that no pattern
finds, so only those teach that are clearly ordinary, and the threshold is set on
held-out joined words. A run's ratio is a difference of two running sums, so a batch of
texts is scored in one pass over its bytes.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm import spans as sp
from sievemill.llm import textbuf
from sievemill.llm.common import fresh, texts_by_hash

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Documents to train on, one word of how many, and most strings; shortest candidate, and
#: the share of held-out identifiers that may look random.
SAMPLE, ONE_WORD_OF, STRINGS, MIN_CHARS, FALSE_SHARE = 2000, 8, 60_000, 16, 0.0002
#: Shorter candidates, of digits and letters, and what they must reach a character.
SHORT_CHARS, SHORT_LEAST = 12, 0.75
#: Letters of a candidate that are of one case alone.
LETTERS = 24
#: At most this a character, a word of the sample that is not of letters in usual case is
#: learned as ordinary; words nearer to random ones may be secrets.
CLEAR = -1.0
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
_KEY = sp.byte_class(sp.DIGITS + sp.UPPER + sp.LOWER + "+/_=-")
_DIGIT, _UPPER, _LOWER = sp.byte_class(sp.DIGITS), sp.byte_class(sp.UPPER), sp.byte_class(sp.LOWER)


def base_spans(text: str) -> list[sp.Span]:
    """Ordered by start, then kind as listed."""
    out: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


@dataclass(frozen=True)
class Model:
    """``ratio``: log-likelihood ratio of a byte after another; ``least``: what a
    character must reach on average."""

    ratio: np.ndarray
    least: float


def _counts(strings: list[str], prior: float) -> np.ndarray:
    out = np.full((256, 256), 0.0)
    for s in strings:
        b = np.frombuffer(s.encode(), np.uint8)
        np.add.at(out, (b[:-1], b[1:]), 1.0)
    alive = np.outer(_KEY, _KEY)
    out = np.where(alive, out + prior, 0.0)
    return np.log(np.maximum(out, 1e-300) / np.maximum(out.sum(1, keepdims=True), 1e-300))


def fit(secrets: list[str], identifiers: list[str]) -> Model:
    rng = random.Random(11)
    alphabets = ["0123456789abcdef", sp.LOWER + sp.DIGITS, sp.UPPER + sp.DIGITS, sp.UPPER + sp.LOWER + sp.DIGITS, sp.UPPER + sp.LOWER + sp.DIGITS + "+/", sp.UPPER + sp.LOWER + sp.DIGITS + "_-"]
    drawn = ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 48))) for i in range(3000)]
    every = sorted({w for w in identifiers if w})
    words = [w for w in every if len(w) < MIN_CHARS and _WORD.fullmatch(w)]
    random_ = _counts(drawn + secrets, 0.5)
    for _ in range(2):
        learned, held = _ordinary(words)
        ratio = np.where(np.outer(_KEY, _KEY), random_ - _counts(learned, 0.5), 0.0)
        np.fill_diagonal(ratio, np.minimum(ratio.diagonal(), 0.0))  # a repeated letter is no sign of a key
        words = sorted({*words, *(w for w in every if _mean(ratio, w) <= CLEAR)})
    scores = [_mean(ratio, w) for w in held]
    least = float(np.quantile(scores, 1 - FALSE_SHARE)) if scores else 0.0
    return Model(ratio, max(least, 0.25))


def _ordinary(words: list[str]) -> tuple[list[str], list[str]]:
    """``words`` and joined ones to learn from, and joined ones to hold out."""
    rng = random.Random(12)
    words = [*words]
    rng.shuffle(words)
    words = words[:20_000]
    plain = [w for w in words if _WORD.fullmatch(w)] or ["identifier", "value", "name"]
    joiners = ("_", "-", "/", "", "=")
    cases = (str.title, str, str.upper)
    linked = [joiners[i % 5].join(cases[i % 3](rng.choice(plain)) for _ in range(rng.randint(2, 4))) for i in range(6000)]
    numbered = [f"{rng.choice(plain)}{rng.choice(joiners)}{rng.randint(0, 2030)}" for _ in range(3000)]
    made = linked + numbered
    held = [w for i, w in enumerate(made) if i % 4 == 0 and len(w.encode()) >= MIN_CHARS]
    return [*(words or plain), *(w for i, w in enumerate(made) if i % 4)], held


def _sums(ratio: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[k]: the ratios of bytes 1 to k after the one before them."""
    return np.concatenate([[0.0], np.cumsum(ratio[b[:-1], b[1:]])]) if len(b) else np.zeros(1)


def _mean(ratio: np.ndarray, word: str) -> float:
    b = np.frombuffer(word.encode(), np.uint8)
    return float(_sums(ratio, b)[-1]) / max(1, len(b) - 1)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """On at most ``sample`` documents, by a hash; the labels of strings are the patterns'
    finds. Only finds and one word of ``ONE_WORD_OF``, by a hash, of at most 200 characters
    reach the driver, ``STRINGS`` at most: a fit's sample, which what is scanned doesn't
    depend on."""
    rows = texts_by_hash(docs, sample)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, plain = set(), set()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                rest, at = [], 0
                for kind, a, b in base:
                    m = ASSIGN.match(text, a) if kind == "assign" else None
                    found.add((m[2] if m else text[a:b])[:200])
                    rest.append(text[at:a])
                    at = max(at, b)
                rest.append(text[at:])
                words = re.findall(r"[A-Za-z0-9+/_=-]{4,200}", "\n".join(rest))
                plain |= {w for w in words if zlib.crc32(w.encode()) % ONE_WORD_OF == 0 and not w.isdigit()}
            yield pa.RecordBatch.from_pydict({"s": [*sorted(found), *sorted(plain)], "y": [1] * len(found) + [0] * len(plain)})

    got = rows.mapInArrow(split, "s string, y long").distinct().orderBy(F.xxhash64("s"), "s", "y").limit(STRINGS).collect()
    return fit([r["s"] for r in got if r["y"] and len(r["s"]) >= 6], [r["s"] for r in got if not r["y"]])


def found_by_model(texts: textbuf.Texts, model: Model) -> list[list[sp.Span]]:
    out: list[list[sp.Span]] = [[] for _ in range(texts.n)]
    b = texts.bytes
    if not len(b):
        return out
    start, end = sp.runs(_KEY[b], texts.offsets)
    long = end - start >= SHORT_CHARS
    start, end = start[long], end[long]

    def count(cls: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(cls[b])])
        return total[end] - total[start]

    digits, upper, lower = (count(cls) for cls in (_DIGIT, _UPPER, _LOWER))
    mixed = (np.stack([digits, upper, lower]) > 0).sum(0) >= 2
    mixed |= upper + lower >= LETTERS
    mixed &= (end - start >= MIN_CHARS) | ((digits > 0) & (upper + lower > 0))
    start, end = start[mixed], end[mixed]
    total = _sums(model.ratio, b)
    score = (total[end - 1] - total[start]) / (end - start - 1)
    keep = score >= np.where(end - start >= MIN_CHARS, model.least, max(model.least, SHORT_LEAST))
    chars = sp.Chars(texts)
    rows = np.searchsorted(texts.offsets, start[keep], "right") - 1
    for r, a, z in zip(rows.tolist(), start[keep].tolist(), end[keep].tolist(), strict=True):
        out[r].append(("random", chars.at(r, a), chars.at(r, z)))
    return out


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())]
)


def _find(shared, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in textbuf.pieces(batch, batch.schema.names[keep]):
                cols: list[list] = [[] for _ in _FOUND]
                more = found_by_model(textbuf.of(part, part.schema.names[keep]), model)
                for text, extra in zip(part.column(keep).to_pylist(), more, strict=True):
                    base = base_spans(text or "")
                    extra = sp.apart(base, extra)
                    every = sorted([*base, *extra], key=lambda s: (s[1], (*KINDS, "random").index(s[0])))
                    row = [sum(s[0] == k for s in base) for k in KINDS] + [sp.digest(base), sp.joined(every), len(extra)]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                found = pa.StructArray.from_arrays(
                    [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(cols, _FOUND, strict=True)], _FOUND.names
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], found], names)

    return run


def find(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``name`` of what is found in the text.

    ``spans`` has the patterns' spans and the method's ``random`` ones, which overlap none
    of them, by start. A null or empty text has none. Rows that repeat have the same; an
    empty table gives an empty result. A very long text is worked on alone and whole.
    Columns that aren't in ``keep`` are not looked at, so they may have any names.
    """
    text = fresh(docs, "__text")
    cols = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(text))
    schema = T.StructType([*cols.schema.fields[:-1], T.StructField(name, _FOUND)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return cols.mapInArrow(_find(shared, len(keep), schema.names), schema)
