import random
import re

import pytest

from sievemill.llm.mixing import curriculum, mixed, targets

SCHEMA = "doc_id long, text string, source string, size int, stream string, row int"


def filled(sizes):
    """The stated rule, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while free:
        if left <= 0:
            return out | dict.fromkeys(free, 0.0)
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


ROWS = [(i, "w " * (i % 13 + 1), f"s{i % 5}" if i % 7 else "big", 1, "x", 2) for i in range(900)]
ROWS += [(5000, None, "s1", 0, None, 0), (5001, "", None, 0, None, 0), (None, "a b c", None, 0, None, 0), (5002, "é x", "Ünï", 0, None, 0)]
ROWS += [(7, "same text", "s2", 0, None, 0)] * 3 + [(6000, "long " * 30_000, "s3", 0, None, 0)]


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = curriculum(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(map(str, got)) == sorted(map(str, curriculum(docs.repartition(3)).collect()))
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS]
    sizes = {}
    for r, n in zip(ROWS, words, strict=True):
        sizes[r[2]] = sizes.get(r[2], 0) + n
    want = filled(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is not None) == (r["taken"] > 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    placed = [r["position"] for r in got if r["position"] is not None]
    assert placed == sorted(placed) and got[-1]["position"] is None and 0 <= placed[0] <= placed[-1] <= 1


def test_mixed_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    sizes = {}
    for r in ROWS:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = filled(sizes)
    largest = {s: max(len((r[1] or "").split()) for r in ROWS if r[2] == s) for s in want}
    assert all(abs(words.get(s, 0) - want[s]) <= largest[s] for s in want)
    empty = spark.createDataFrame([], SCHEMA)
    assert curriculum(empty).count() == mixed(empty).count() == 0


def test_ramps_meet_demand_over_time(spark):
    docs = spark.createDataFrame([(i, "w w", "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    rows = [r for r in curriculum(docs).collect() if r["source"] == "a"]
    half = sum(r["taken"] for r in rows if (r["position"] or 2) < 0.5) / sum(r["taken"] for r in rows)
    assert half > 0.5  # the heavy source's first pass comes early


def test_targets_follow_the_stated_rule(spark):
    rng = random.Random(3)
    for _ in range(12):
        sizes = {f"s{i}": rng.choice([0, 1, 30, 30, rng.randrange(1000)]) for i in range(rng.randint(1, 9))}
        if not sum(sizes.values()):
            continue
        got = targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()
        assert {r["source"]: r["target"] for r in got} == pytest.approx(filled(sizes))
        assert sum(r["target"] for r in got) == pytest.approx(1.5 * sum(sizes.values()))


def test_native_plan(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for df in (curriculum(docs), mixed(docs)):
        assert not re.search("Python|Pandas|InArrow|CartesianProduct|BroadcastNestedLoop", df._jdf.queryExecution().toString())
