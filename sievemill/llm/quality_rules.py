"""Quality rules: a decision list over text statistics, learned from labels.

Sequential covering: a rule is a conjunction of thresholds that rejects. It is grown on
two thirds of the labelled rows by information gain, pruned on the last third, and taken
if it is precise there; the rows it covers are set aside and the next one is grown. The
list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm import textbuf
from sievemill.llm.common import fresh, labelled_ids

#: Most labelled rows to learn from.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Growing: thresholds tried for a feature, and conditions of a rule. Taking: precision on
#: the pruning rows, and rows it must cover there.
THRESHOLDS, CONDITIONS, PRECISION, SUPPORT = 48, 4, 0.98, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_stops", "n_digits", "n_distinct")
_STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _STOPS, _DIGITS = _class("#*$%&|<>"), _class(".!?,;:"), _class("0123456789")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def counts(part: pa.RecordBatch, column: str) -> dict[str, np.ndarray]:
    texts = textbuf.of(part, column)
    words = textbuf.Words(texts)
    n, b = texts.n, texts.bytes
    h = words.hashes()

    def per_row(mask: np.ndarray) -> np.ndarray:
        return textbuf.per_row(texts, mask)

    starts_char = (b & 0xC0) != 0x80
    solid = ~textbuf._SPACE[b]
    # capitals: ASCII, and À to Þ, which UTF-8 writes as C3 80 to C3 9E
    upper = _UPPER[b]
    upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)

    line_row, line_start, line_end = textbuf.lines(words)
    lines = np.bincount(line_row, minlength=n)
    different = textbuf.distinct(line_row, textbuf.segment_hashes(b, line_start, line_end), n)
    repeat = textbuf.repeated(words, h, 3)
    return {
        "n_words": words.counts,
        "word_chars": per_row(solid & starts_char),
        "n_symbols": per_row(_SYMBOLS[b]),
        "n_dup_lines": lines - different,
        "n_repeat_words": np.bincount(words.row[repeat], minlength=n),
        "n_chars": per_row(starts_char),
        "n_lines": lines,
        "n_upper": per_row(upper),
        "n_stops": per_row(_STOPS[b]),
        "n_digits": per_row(_DIGITS[b]),
        "n_distinct": textbuf.distinct(words.row, h, n),
    }


def _statistics(column: int, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, batch.schema.names[column]):
                got = counts(part, part.schema.names[column])
                stats = pa.StructArray.from_arrays([pa.array(got[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], stats], names)

    return run


def statistics(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``name`` of the text's counts."""
    text = fresh(docs, "__text")
    cols = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(text))
    schema = T.StructType([*cols.schema.fields[:-1], T.StructField(name, _STATS)])
    return cols.mapInArrow(_statistics(len(keep), len(keep), schema.names), schema)


def features(s: Column) -> dict[str, Column]:
    """What rules look at: shares, so that they hold at every length."""
    words = F.greatest(s["n_words"], F.lit(1))
    lines, chars = F.greatest(s["n_lines"], F.lit(1)), F.greatest(s["n_chars"], F.lit(1))
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "duplicate_line_share": s["n_dup_lines"] / lines,
        "repeated_word_share": s["n_repeat_words"] / words,
        "chars_per_word": s["word_chars"] / words,
        "words_per_line": words / lines,
        "upper_share": s["n_upper"] / chars,
        "stops_per_word": s["n_stops"] / words,
        "digit_share": s["n_digits"] / chars,
        "distinct_word_share": s["n_distinct"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = live.copy()
    while len(rule) < CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        y = bad[inside]
        for name, x in values.items():
            x = x[inside]
            cuts = np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]).round(6))
            below = x[None, :] <= cuts[:, None]
            for above in (False, True):
                part = ~below if above else below
                p = part @ y.astype(np.int64)
                n = part.sum(1) - p
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        cond = best[1]
        x, on = values[cond.feature][inside], cond.holds(values)[inside]
        # the middle of the gap between the rows on either side
        gap = (x[~on].max() + x[on].min()) / 2 if cond.above else (x[on].max() + x[~on].min()) / 2
        cond = Condition(cond.feature, cond.above, round(float(gap), 9))
        rule += (cond,)
        inside &= cond.holds(values)
    return rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules in order, each of which rejects."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while (left & ~prune & bad).any():
        grown = _grow(values, bad, left & ~prune)
        if not grown:
            break
        best: tuple[float, Rule, int, int] = (-2.0, (), 0, 0)
        for length in range(1, len(grown) + 1):
            inside = covers(grown[:length], values, n) & left & prune
            p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
            worth = (p - q) / (p + q) if p + q else -1.0
            if worth > best[0]:
                best = (worth, grown[:length], p, q)
        _, rule, p, q = best
        if p < SUPPORT or p < PRECISION * (p + q):
            break
        rules.append(rule)
        left &= ~covers(rule, values, n)
    return rules


def verdict(rules: list[Rule], s: Column) -> Column:
    """The first rule that rejects, as text; null if none does."""
    values = features(s)
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(values)
        said = F.lit(" and ".join(map(str, rule)))
        out = F.when(cond, said) if out is None else out.when(cond, said)
    return F.lit(None).cast("string") if out is None else out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """From at most ``sample`` labelled rows; only their statistics reach the driver.

    Held-out rows (see ``common.is_held_out``), null or conflicting labels, and documents
    that the base rules reject anyway are not learned from.
    """
    chosen = labelled_ids(labels, sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"], "s")
    picked = {k: c.alias(k) for k, c in features(F.col("s")).items()}
    got = rows.filter(~base_failed(F.col("s"))).select("doc_id", "y", *picked.values()).toPandas()
    got = got.sort_values(["doc_id", "y", *picked]).reset_index(drop=True)
    order = np.argsort([hash((int(i), 7)) & 0xFFFFFFFF for i in got["doc_id"]], kind="stable") if len(got) else []
    got = got.iloc[order]
    return learn({k: got[k].to_numpy(float) for k in picked}, (got["y"] == 0).to_numpy(bool))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def judged(docs: DataFrame, rules: list[Rule], keep: list[str], name: str) -> DataFrame:
    """``keep`` and a struct ``name``: the counts, base_failed, rule and kept.

    A null or empty text has no words: it fails the base rules. Rows that repeat are
    judged alike; an empty table gives an empty result. Very long texts are judged alone and
    whole. Columns that aren't in ``keep`` are not looked at, so they may have any names.
    """
    stats = fresh(docs, "__stats")
    s = F.col(stats)
    rows = statistics(docs, keep, stats)
    failed, rule = base_failed(s), verdict(rules, s)
    return rows.select(
        *(F.col(f"`{c}`") for c in keep),
        F.struct(*(s[c].alias(c) for c in COUNTS), failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept")).alias(name),
    )
