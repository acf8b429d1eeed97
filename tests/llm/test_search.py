import math
import random
import re
from collections import Counter

import numpy as np

from sievemill.llm import search as s

SCHEMA = "doc_id long, text string, term string, score int"


def words(text):
    return [w for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(rows, queries, k, most):
    docs = [(i, Counter(words(t))) for i, t, *_ in rows if i is not None]
    n, average = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = {}
    for q, text in queries:
        ask = {w for w in words(text) if w in df}
        if most is not None:
            ask = {w for w in ask if df[w] > 1}
            if len(ask) > most:
                low = sorted((idf[w] for w in ask), reverse=True)
                assert low[most - 1] > low[most], "the test needs queries without ties at the cut"
                ask = set(sorted(ask, key=lambda w: -idf[w])[:most])
        got = []
        for i, c in docs:
            length = sum(c.values())
            v = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / average)) for w in ask if w in c)
            if v > 0:
                got.append((-round(v, 6), i))
        out[q] = [(i, -v) for v, i in sorted(got)[:k]]
    return out


def corpus():
    rng = random.Random(5)
    zipf = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        n = rng.choice([3, 20, 80])
        rows.append((i, " ".join(rng.choices(zipf, [1 / (j + 1) for j in range(300)], k=n)) + rng.choice(["", ", É!", " W1"]), "x", 1))
    rows += [(1000 + i, "exact copies of one text w7 w8", "x", 1) for i in range(50)]
    rows += [(2000, None, "", 0), (2001, "", "", 0), (2002, "?! ...", "", 0), (2003, "long w5 " * 30_000, "", 0), (None, "w1 w2", "", 0), (7, "again w9 w9", "", 0)]
    return rows


def as_map(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def close(a, b):
    return [i for i, _ in a] == [i for i, _ in b] and np.allclose([v for _, v in a], [v for _, v in b], atol=2e-6)


def test_same_as_brute_force(spark, monkeypatch):
    for name, value in {"TILE": 3, "BLOCK": 40, "CHUNK": 9, "GROUP": 3, "POSTINGS": 2500, "FREQUENT": 0.01}.items():
        monkeypatch.setattr(s, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ask = [(i, t) for i, t, *_ in rows if i is not None and i % 20 == 0]
    queries = spark.createDataFrame(ask, "query_id long, text string")
    got = as_map(s.top_k(docs, queries, k=7).collect())
    want = {q: v for q, v in brute(rows, ask, 7, None).items() if v}
    assert got.keys() == want.keys()
    assert all(close(got[q], want[q]) for q in want)


def test_formulated_queries(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(40) if i % (j + 1) == 0) + f" own{i}", "", 0) for i in range(1, 400)]
    ask = [(i, t) for i, t, *_ in rows if i in (360, 240, 7)]
    got = as_map(s.top_k(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ask, "query_id long, text string"), k=5, max_terms=4).collect())
    assert all(close(got[q], v) for q, v in brute(rows, ask, 5, 4).items())


def searched(shard, average, asks, k):
    """(best, pairs scored) of queries given as {term: weight}."""
    first = np.cumsum([0] + [len(a) for a in asks])
    at = np.array([np.flatnonzero(shard.terms == t)[0] for a in asks for t in sorted(a)], int)
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asks)
    n = s.Searcher(shard, average).search(first, at, np.array([a[t] for a in asks for t in sorted(a)]), best, k)
    return best, n


def test_blocks_are_skipped(monkeypatch):
    rng = np.random.default_rng(1)
    n = 1024 * 20
    doc = np.unique(np.concatenate([rng.integers(0, n, 10_000), np.arange(5)]))
    tf = np.where(doc < 5, 50, 1)
    shard = s.Shard.build(np.arange(n), np.full(n, 10), doc, np.full(len(doc), 9, np.uint64), tf)
    for share in (0.01, 9.0):  # as a matrix, and from postings
        monkeypatch.setattr(s, "FREQUENT", share)
        [(ids, scores)], scored = searched(shard, 10.0, [{9: 1.0}], 3)
        assert ids.tolist() == [0, 1, 2] and scored < 4 < len(shard.starts) and scores[0] == scores[2]


def test_languages_apart():
    """Documents of few common words are in other blocks, which queries skip."""
    rng = np.random.default_rng(2)
    n, lang = 8000, np.arange(8000) % 4
    doc = np.repeat(np.arange(n), 30)
    term = (200 * rng.random(len(doc)) ** 3).astype(int) + 1000 * lang[doc]  # some words are common
    pairs, tf = np.unique(doc * 10_000 + term, return_counts=True)
    shard = s.Shard.build(np.arange(n), np.full(n, 30), pairs // 10_000, (pairs % 10_000).astype(np.uint64), tf)
    blocks = list(zip(shard.starts, shard.starts[1:], strict=False))
    pure = [len(set(lang[shard.ids[a:b]].tolist())) == 1 for a, b in blocks]
    assert sum(b - a for (a, b), x in zip(blocks, pure, strict=True) if x) > 0.8 * n
    _, scored = searched(shard, 30.0, [{int(t): 1.0 for t in np.unique(term[doc == i])} for i in range(40)], 10)
    assert scored <= 40 * len(blocks) / 2


def test_shards_are_read_as_written():
    import io

    shard = s.Shard.build(np.array([-5, 7]), np.array([3, 70_000]), np.array([0, 1, 1]), np.array([8, 8, 2], np.uint64), np.array([1, 300, 2]))
    out = io.BytesIO()
    shard.save(out)
    back = s.Shard.load(out.getvalue())
    assert all((getattr(back, n) == getattr(shard, n)).all() for n in s.Shard.NAMES)
    assert s.Shard.load(out.getvalue(), ("terms",)).doc is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "query_id long, text string")
    some = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    assert s.top_k(empty, none).count() == s.top_k(some, none).count() == 0
    assert s.top_k(empty, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def two_languages(n=4000, seed=3):
    """(shard, queries): documents have 100 words of their language and 2 of the other one, so
    that a block has most words of both and a span few of the other's."""
    rng = np.random.default_rng(seed)
    own, other = np.repeat(np.arange(n), 100), np.repeat(np.arange(n), 2)
    term = np.concatenate([(2000 * rng.random(len(own)) ** 3).astype(int) + 5000 * (own % 2), rng.integers(0, 2000, len(other)) + 5000 * (1 - other % 2)])
    pairs, tf = np.unique(np.concatenate([own, other]) * 10_000 + term, return_counts=True)
    doc, term = pairs // 10_000, pairs % 10_000
    shard = s.Shard.build(np.arange(n), np.full(n, 500), doc, term.astype(np.uint64), tf)
    return shard, [{int(t): 1.0 for t in term[doc == i]} for i in range(40)]


def test_spans_skip_what_blocks_do_not():
    shard, asks = two_languages()
    _, scored = searched(shard, 500.0, asks, 10)
    assert scored <= 0.6 * len(asks) * (len(shard.starts) - 1)


def test_scores_reached_elsewhere_bound_a_search():
    shard, asks = two_languages()
    best, _ = searched(shard, 500.0, asks, 10)
    first = np.cumsum([0] + [len(a) for a in asks])
    at = np.array([np.flatnonzero(shard.terms == t)[0] for a in asks for t in sorted(a)], int)
    for floor, want in ((np.array([v[-1] for _, v in best]), best), (np.array([v[2] for _, v in best]), [(i[:3], v[:3]) for i, v in best])):
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(asks)
        s.Searcher(shard, 500.0).search(first, at, np.ones(len(at)), found, 10, floor)
        for (i, v), (ids, scores), low in zip(found, want, floor, strict=True):
            over = v >= low
            assert set(ids[scores > low]) <= set(i[over]) and (v[over][: len(scores)] == scores).all()
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(asks)
    assert s.Searcher(shard, 500.0).search(first, at, np.ones(len(at)), found, 10, np.full(len(asks), 1e6)) == 0


def test_groups_of_short_documents():
    """Short documents are bounded together; wordless ones, copies and ties among them."""
    rng = np.random.default_rng(4)
    n = 900
    texts = [Counter(rng.integers(0, 60, rng.integers(0, 9)).tolist()) for _ in range(n)]
    texts[100:140] = [Counter([1, 2, 3])] * 40
    doc, term, tf = (np.array(x) for x in zip(*[(i, t, c) for i, text in enumerate(texts) for t, c in text.items()], strict=True))
    lengths = np.array([sum(c.values()) for c in texts])
    shard = s.Shard.build(np.arange(n), lengths, doc, term.astype(np.uint64), tf)
    assert len(shard.groups) < n / 2
    asks = [{t: 1.0 + t / 50 for t in c} for c in texts[95:145] if c]
    best, _ = searched(shard, lengths.mean(), asks, 10)
    for ask, (ids, scores) in zip(asks, best, strict=True):
        want = [(-round(sum(w * s._impact(c[t], m, lengths.mean()) for t, w in sorted(ask.items()) if t in c), 6), i) for i, (c, m) in enumerate(zip(texts, lengths, strict=True))]
        want = sorted(x for x in want if x[0] < 0)[:10]
        assert ids.tolist() == [i for _, i in want] and np.allclose(scores, [-v for v, _ in want], atol=2e-6)


def test_nothing_near_is_left_in_a_tile():
    """What looked near in one block falls behind the documents of the next."""
    shard, asks = two_languages(600)
    best, _ = searched(shard, 500.0, asks, 10)
    first = np.cumsum([0] + [len(a) for a in asks])
    at = np.array([np.flatnonzero(shard.terms == t)[0] for a in asks for t in sorted(a)], int)
    searcher = s.Searcher(shard, 500.0)
    for share in (0.5, 0.9, 1.0, 1.1):
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(asks)
        searcher.search(first, at, np.ones(len(at)), found, 10, np.array([v[0] * share for _, v in best]))
        assert all((v >= share * b[0] - 1e-5).all() for (_, v), (_, b) in zip(found, best, strict=True))
