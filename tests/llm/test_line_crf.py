import itertools
import math
import random

import numpy as np
import pytest

from sievemill.llm import line_crf as c

SCHEMA = "doc_id long, text string, score string"


def test_messages_are_exact():
    rng = np.random.default_rng(0)
    row = np.array([0] * 5 + [1] + [2] * 3)
    e, m = rng.normal(size=9), rng.normal(size=(2, 2))
    chains = c.Chains(row)
    ahead, back = chains.messages(e, m)
    good = 1 / (1 + np.exp(-(ahead + back)))
    pairs = np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        ways = {y: math.exp(sum(e[i] * l for i, l in zip(at, y, strict=True)) + sum(m[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(at))}
        whole = sum(ways.values())
        for k, i in enumerate(at):
            assert good[i] == pytest.approx(sum(v for y, v in ways.items() if y[k]) / whole)
        for y, v in ways.items():
            for a, b in itertools.pairwise(y):
                pairs[a, b] += v / whole
    assert chains.pairs(e, m, ahead, back) == pytest.approx(pairs)


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        lines = []
        for _ in range(rng.randint(1, 12)):
            w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 15))]
            junk = not y if rng.random() < 0.9 else y
            lines.append(" | ".join(w).upper() + "!!" if junk else " ".join(w).capitalize() + ".")
        out.append((i, "\n".join(lines), y))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = c.train(docs, labels)
    from sievemill.llm.common import held_out

    more = [(10**6, None, ""), (10**6 + 1, "", ""), (10**6 + 2, "\n \n", ""), (3, "Twice here.", ""), (3, "Twice here.", ""), (10**6 + 3, "Long words here. " * 20_000, ""), (10**6 + 4, "x\n" * 30_000, "")]
    got = c.scores(docs.unionByName(spark.createDataFrame(more, SCHEMA)), model, ["doc_id", "score"], "quality").collect()
    assert all(0 <= r["quality"] <= 1 for r in got) and len(got) == len(rows) + len(more)
    truth = {i: y for i, _, y in rows}
    test = [(r["quality"] >= 0.3, truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and held_out(r["doc_id"]) and r["doc_id"] != 3]
    assert len(test) > 100 and sum(a == b for a, b in test) > 0.9 * len(test)  # a tenth of the lines is of the other kind
    assert [r["quality"] for r in got if r["doc_id"] in (10**6, 10**6 + 1, 10**6 + 2)] == [c.EMPTY] * 3
    assert c.scores(docs.limit(0), c.train(docs, labels.limit(0)), ["doc_id"], "q").count() == 0


def mixed(n, seed):
    """Half of a bad document's lines are good ones; (lines, label, whether each line is good)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y, lines = int(rng.random() < 0.8), []
        for k in range(rng.randint(2, 12)):
            w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 15))]
            good = bool(y) or k % 2 == 0
            lines.append((" ".join(w).capitalize() + "." if good else " | ".join(w), good))
        out.append((lines, y))
    return out


def test_lines_of_mixed_documents_are_told_apart():
    docs = mixed(1500, 3)
    texts = c.textbuf.Texts(c.pa.array(["\n".join(t for t, _ in lines) for lines, _ in docs]))
    label = np.array([y for _, y in docs])
    row, length, x = c.line_features(texts)
    x, train = c.with_neighbours(row, x), row < 1000
    model = c.fit(row[train], x[train].astype(float), length[train], label[:1000])
    ahead, back = c.Chains(row).messages(x @ model.weights, model.moves)
    good = np.array([g for lines, _ in docs for _, g in lines])
    assert ((ahead + back > 0) == good)[~train].mean() > 0.97
    right = (c.score(texts, model) >= c.GOOD) == (label == 1)
    assert right[1000:].mean() > 0.97 and right[1000:][label[1000:] == 0].mean() >= 0.95
    assert model.moves[0, 0] + model.moves[1, 1] != pytest.approx(model.moves[0, 1] + model.moves[1, 0], abs=1e-3)


def test_scores_as_by_brute_force():
    """All ways to label the lines of a few texts, from features to the quality."""
    rng = np.random.default_rng(4)
    model = c.Model(rng.normal(size=3 * c.OWN), rng.normal(size=(2, 2)), (-3.0, 7.0))
    texts = ["One line here.", "A b c d.\n\nx | y | z\n  \nE f g h", "", " \n", "é É ü!\n" * 6]
    got = c.score(c.textbuf.Texts(c.pa.array(texts)), model)
    for k, text in enumerate(texts):
        lines = [s for s in text.split("\n") if s.split()]
        if not lines:
            assert got[k] == c.EMPTY
            continue
        _, _, own = c.line_features(c.textbuf.Texts(c.pa.array([text])))
        none = [0.0] * c.OWN
        x = [[*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)] for i in range(len(own))]
        e = [float(np.dot(v, model.weights)) for v in x]
        ways = {y: math.exp(sum(a for a, l in zip(e, y, strict=True) if l) + sum(model.moves[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(e))}
        whole = sum(ways.values())
        good = [sum(v for y, v in ways.items() if y[i]) / whole for i in range(len(e))]
        share = sum(len(s) * g for s, g in zip(lines, good, strict=True)) / sum(map(len, lines))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(-3.0 + 7.0 * share))), rel=1e-5)
