import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string, stats int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if times[t] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(5)
    parts = ["a", "bb", "É", "漢字", "#x", "|", "\n", "\n\n", " ", "\t", "same line\n", "a b c d ", "\x1c", "\x0b", " ", "<&>"]
    out = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    return out + [None, "", "\n", " ", "a", "x y", "l\nl\nl", "\nl\n\nl", "w " * 40_000, "a a a a a", "end\n"]


def test_counts_as_by_brute_force(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["s"] for r in q.statistics(docs, ["doc_id"], "s").collect()}
    for i, t, *_ in rows:
        assert tuple(got[i])[:5] == brute(t), t
    out = q.judged(docs, [(q.Condition("upper_share", True, 0.5),)], docs.columns, "judged")
    assert out.columns == [*docs.columns, "judged"] and out.count() == len(rows)
    for r in out.collect():
        n, _, _, _, rep = brute(r["text"])
        assert r["judged"]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
    assert q.judged(docs.limit(0), [], ["doc_id"], "j").count() == 0


def test_learned_list_finds_planted_thresholds():
    rng = np.random.default_rng(0)
    values = {k: rng.random(6000) for k in ("a", "b", "c")}
    bad = ((values["a"] > 0.7) & (values["b"] <= 0.4)) | (values["c"] > 0.95)
    rules = q.learn(values, bad)
    hit = np.zeros(6000, bool)
    for r in rules:
        hit |= q.covers(r, values, 6000)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * hit.sum()
    assert q.learn(values, rng.random(6000) < 0.1) == []  # noise teaches nothing
    assert q.learn({k: v[:0] for k, v in values.items()}, bad[:0]) == []


def test_order_and_text_of_rules(spark):
    rules = [(q.Condition("upper_share", True, 0.5),), (q.Condition("chars_per_word", False, 2.0), q.Condition("digit_share", False, 0.5))]
    docs = spark.createDataFrame([(1, "ABC DEF"), (2, "a b c"), (3, "words here")], "doc_id long, text string")
    got = {r["doc_id"]: r["j"]["rule"] for r in q.judged(docs, rules, ["doc_id"], "j").collect()}
    assert got == {1: "upper_share > 0.5", 2: "chars_per_word <= 2 and digit_share <= 0.5", 3: None}


def test_trained_on_labels(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["word", "other", "more"]) + str(rng.randrange(99)) for _ in range(80))) for i in range(300)]
    junk = [(i, " ".join(rng.choice(["WORD", "X"]) + str(rng.randrange(99)) + "!!" for _ in range(80))) for i in range(300, 400)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(1, 0), (None, 1), (9999, None)], "doc_id long, quality int"))
    rules = q.train(docs, labels)
    kept = {r["doc_id"] for r in q.judged(docs, rules, ["doc_id"], "j").filter("j.kept").collect()}
    assert kept == set(range(300))
    assert q.train(docs, labels.limit(0)) == []
