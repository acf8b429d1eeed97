"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its score comes from its own features and those of
the lines beside it; a transition matrix ties it to its neighbours' labels. With two
labels the forward and backward messages are one log-odds for each line, so all documents
of a batch are stepped through together. A document's share of good text is the mean of its
lines' probabilities of being good, weighted by their length, and its quality is a logistic
function of that share.

Only documents are labelled, so the labels of their lines are latent: training goes from
the documents' labels by turns to the lines' probabilities, moved as far as a document's
label asks for (of a good one nearly all text is good, of a bad one a good part is bad),
and from those to the weights. So good lines of a bad document are learned as good, and
moves between labels are seen. The two classes of documents weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm import spans as sp
from sievemill.llm import textbuf
from sievemill.llm.common import fresh, labelled_ids

#: Most labelled documents to learn from, and their most lines; passes of training, and how
#: often the lines' labels are estimated anew.
SAMPLE, SAMPLE_LINES, PASSES, TURNS = 4000, 2000, 60, 3
#: Least share of a good document's text that is good, most of a bad one's.
GOOD_SHARE, BAD_SHARE = 0.97, 0.7
#: Score of a text without a word, and the least score that counts as good.
EMPTY, GOOD = 0.0, 0.3

_UPPER, _DIGIT = sp.byte_class(sp.UPPER), sp.byte_class(sp.DIGITS)
_SYMBOL, _BAR, _CRY, _STOP = (sp.byte_class(c) for c in ("#*$%&<>{}[]\\^~=_", "|", "!", ".,;:?"))
_ENDS = sp.byte_class(".!?:")
OWN = 15


def line_features(texts: textbuf.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length in code points, features) of every line with a word."""
    words, b = textbuf.Words(texts), texts.bytes
    row, start, end = textbuf.lines(words)
    if not len(row):
        return row, start, np.zeros((0, OWN), np.float32)
    h = words.hashes()

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[end] - total[start]).astype(float)

    length = share((b & 0xC0) != 0x80)
    lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = (hi - lo).astype(float)
    again = np.concatenate([[0], np.cumsum(textbuf.repeated(words, h, 3))])
    line_of_word = np.repeat(np.arange(len(row)), hi - lo)
    different = textbuf.distinct(line_of_word, h, len(row))
    line_hash = textbuf.segment_hashes(b, start, end)
    order = np.lexsort((line_hash, row))
    same = textbuf.equal_to_last(row[order], line_hash[order])
    twin = np.zeros(len(row))
    twin[order] = same
    twin[order[:-1]] += same[1:]
    upper = _UPPER[b]
    upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    tail = b[words.end[hi - 1] - 1]
    x = np.stack(
        [
            np.ones(len(row)),
            np.log1p(n),
            length / n / 10,
            share(upper) / length,
            np.minimum(share(_SYMBOL[b]) / n, 3),
            np.minimum(share(_BAR[b]) / n, 3),
            np.minimum(share(_CRY[b]) / n, 3),
            np.minimum(share(_STOP[b]) / n, 3),
            share(_DIGIT[b]) / length,
            (again[hi] - again[lo]) / n,
            twin > 0,
            different / n,
            _ENDS[tail],
            upper[words.start[lo]],
            n < 4,
        ],
        1,
    )
    return row, length, x.astype(np.float32)


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and of the line after, 0 at edges (where
    the neighbour's first, always 1, tells that there is none)."""
    out = np.zeros((len(x), 3 * OWN), np.float32)
    out[:, :OWN] = x
    if len(x) > 1:
        inner = row[1:] == row[:-1]
        out[1:, OWN : 2 * OWN][inner] = x[:-1][inner]
        out[:-1, 2 * OWN :][inner] = x[1:][inner]
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray  # [from, to]: log-weights of labels 0 (bad), 1 (good)
    curve: tuple[float, float] = (-4.0, 8.0)  # of a document's quality: a logistic function's constant and slope


class Chains:
    """Lines of several documents, each document's in a row; stepped through together."""

    def __init__(self, row: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(row)))
        order = np.argsort(-count, kind="stable")
        self.first, self.count = first[order], count[order]
        self.steps = int(self.count[0]) if len(order) else 0
        self.live = np.searchsorted(-self.count, -np.arange(1, self.steps + 1), "right")

    def messages(self, e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good from the lines up to each one, and from those after it."""
        ahead, back = np.array(e, float), np.zeros(len(e))
        for t in range(1, self.steps):
            at = self.first[: self.live[t]] + t
            r = ahead[at - 1]
            ahead[at] += np.logaddexp(m[1, 1] + r, m[0, 1]) - np.logaddexp(m[1, 0] + r, m[0, 0])
        for t in range(self.steps - 2, -1, -1):
            at = self.first[: self.live[t + 1]] + t
            r = e[at + 1] + back[at + 1]
            back[at] = np.logaddexp(m[1, 1] + r, m[1, 0]) - np.logaddexp(m[0, 1] + r, m[0, 0])
        return ahead, back

    def pairs(self, e: np.ndarray, m: np.ndarray, ahead: np.ndarray, back: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Expected numbers of each (label, next label), lines counted by ``weight``."""
        inner = np.ones(len(e), bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        a, z = ahead[at - 1], e[at] + back[at]
        logs = np.stack([m[0, 0] + 0 * a, m[0, 1] + z, m[1, 0] + a, m[1, 1] + a + z], 1)
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        p /= p.sum(1, keepdims=True)
        return (p if weight is None else p * weight[at, None]).sum(0).reshape(2, 2)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _climb(chains: Chains, x: np.ndarray, y: np.ndarray, seen: np.ndarray, weight: np.ndarray, start: Model, passes: int, docs: int) -> Model:
    """Largest expected likelihood with a quadratic penalty, by Adam. ``y``: each line's
    probability of being good; ``seen``: expected numbers of moves."""
    weights, moves = start.weights, start.moves
    state = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    for step in range(1, passes + 1):
        e = x @ weights
        ahead, back = chains.messages(e, moves)
        miss = weight * (y - _logistic(ahead + back))
        g = np.concatenate([x.T @ miss / docs - 0.01 * weights, ((seen - chains.pairs(e, moves, ahead, back, weight)) / docs - 0.1 * moves).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.15 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + move[:-4], moves + move[-4:].reshape(2, 2)
    return Model(weights, moves)


def _estimated(chains: Chains, row: np.ndarray, length: np.ndarray, label: np.ndarray, e: np.ndarray, moves: np.ndarray) -> tuple:
    """(lines' scores, forward and backward messages) with each document's scores moved, no
    further than needed, until its share of good text is what its label asks for."""
    total = np.maximum(np.bincount(row, length, minlength=len(label)), 1e-9)
    lo, hi = np.zeros(len(label)), np.full(len(label), 30.0)
    side = np.where(label == 1, 1.0, -1.0)

    def moved(by: np.ndarray) -> tuple:
        own = e + (side * by)[row]
        ahead, back = chains.messages(own, moves)
        share = np.bincount(row, length * _logistic(ahead + back), minlength=len(label)) / total
        return own, ahead, back, np.where(label == 1, share >= GOOD_SHARE, share <= BAD_SHARE)

    met = moved(lo)[3]
    hi[met] = 0.0
    for _ in range(9):
        mid = (lo + hi) / 2
        met = moved(mid)[3]
        lo, hi = np.where(met, lo, mid), np.where(met, mid, hi)
    return moved(hi)[:3]


def _curve(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Constant and slope of a logistic function that tells labels by shares, with both
    labels weighing the same; by Newton's method with a penalty on the slope."""
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    x = np.stack([np.ones(len(share)), share - 0.5], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = _logistic(x @ b)
        g = x.T @ (weight * (label - p)) - np.array([1e-6, 1e-4]) * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-4])
        move = np.linalg.solve(h, g)
        b = b + move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
    return float(b[0] - b[1] / 2), float(max(b[1], 0.0))


def fit(row: np.ndarray, x: np.ndarray, length: np.ndarray, label: np.ndarray, passes: int = PASSES, turns: int = TURNS) -> Model:
    """``row``: the document of each line, ``label``: of each document."""
    chains = Chains(row)
    both = np.bincount(label, minlength=2)
    weight = (len(label) / 2 / np.maximum(both, 1))[label][row]
    y = label[row].astype(float)
    # first by lines alone: what lies beside a line tells its document's label, not its own
    alone = Chains(np.arange(len(row)))
    model = _climb(alone, x[:, :OWN], y, np.zeros((2, 2)), weight, Model(np.zeros(OWN), np.zeros((2, 2))), passes, len(label))
    model = Model(np.concatenate([model.weights, np.zeros(x.shape[1] - OWN)]), model.moves)
    for _ in range(turns):
        e, ahead, back = _estimated(chains, row, length, label, x @ model.weights, model.moves)
        seen = chains.pairs(e, model.moves, ahead, back, weight)
        model = _climb(chains, x, _logistic(ahead + back), seen, weight, model, passes, len(label))
    if both.min() == 0:
        return model
    return Model(model.weights, model.moves, _curve(_shares(row, length, x, model, len(label)), label))


def _shares(row: np.ndarray, length: np.ndarray, x: np.ndarray, model: Model, n: int) -> np.ndarray:
    """The share of good text of each of ``n`` documents; ``x`` has neighbours' features."""
    ahead, back = Chains(row).messages(x @ model.weights, model.moves)
    total = np.bincount(row, length, minlength=n)
    return np.bincount(row, length * _logistic(ahead + back), minlength=n) / np.maximum(total, 1)


def score(texts: textbuf.Texts, model: Model) -> np.ndarray:
    """The quality of every row."""
    row, length, x = line_features(texts)
    share = _shares(row, length, with_neighbours(row, x), model, texts.n)
    some = np.bincount(row, minlength=texts.n) > 0
    return np.where(some, _logistic(model.curve[0] + model.curve[1] * share), EMPTY)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From at most ``sample`` labelled documents outside the held-out fold; documents of more
    than ``SAMPLE_LINES`` lines aren't learned from. Only text is looked at, never id, source
    or language."""
    chosen = labelled_ids(labels, sample)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                row, length, x = line_features(textbuf.of(part, "text"))
                x = np.concatenate([length[:, None], x], 1, dtype=np.float32)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                data = [x[a:z].tobytes() if z - a <= SAMPLE_LINES else b"" for a, z in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y long, x binary").collect()
    got = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in got if len(r["x"]))
    if not got:
        return Model(np.zeros(3 * OWN), np.zeros((2, 2)))
    xs = [np.frombuffer(x, np.float32).reshape(-1, 1 + OWN) for *_, x in got]
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    every = np.concatenate(xs)
    return fit(row, with_neighbours(row, every[:, 1:]).astype(float), every[:, 0].astype(float), np.array([y for _, y, _ in got]))


def _scored(shared, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in textbuf.pieces(batch, batch.schema.names[keep]):
                s = score(textbuf.Texts(part.column(keep)), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(s)], names)

    return run


def scores(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a double ``name``, 0 to 1.

    A null, empty or wordless text has ``EMPTY``. Rows that repeat have the same; an empty
    table gives an empty result. Very long texts are scored alone and whole. Columns that
    aren't in ``keep`` are not looked at, so they may have any names.
    """
    text = fresh(docs, "__text")
    cols = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(text))
    schema = T.StructType([*cols.schema.fields[:-1], T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return cols.mapInArrow(_scored(shared, len(keep), schema.names), schema)
