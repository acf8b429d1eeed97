import itertools
import random
import re

from sievemill.llm import near_dedup
from sievemill.llm.near_dedup import near_duplicates, unique

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, k, percent):
    sets = {}
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ö", "x y"]
    rows = [(900, None, "z"), (901, "", None), (902, " \t\n", None), (903, "One two", None), (904, "one  TWO", None), (905, "one", None)]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 400]))]
        for c in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(words), None))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for c in range(120):  # many of these link with some others only
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(words), None))
    rng.shuffle(rows)
    for k, percent in ((3, 85), (5, 80)):
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, percent=percent).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, k, percent)
        assert len(got) == len(rows)


def test_repeated_rows_null_ids_long_and_empty(spark):
    long = " ".join(f"t{i % 7919}" for i in range(60_000))
    rows = [(5, long, ""), (5, long, ""), (9, long + " end", ""), (None, long, ""), (None, "alone here now", ""), (7, "other text of this id", ""), (7, "second text of this id", "")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA), k=3).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, 5, False), (None, None, True), (7, 7, True), (7, 7, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    left = unique(spark.createDataFrame(rows, SCHEMA), k=3)
    assert left.columns == ["doc_id", "text", "component_id"]
    assert sorted((str(r[0]), r[1]) for r in left.collect()) == sorted([("5", long), ("None", "alone here now"), ("7", "other text of this id"), ("7", "second text of this id")])


def test_large_near_copy_groups_cost_in_proportion(spark, monkeypatch):
    """A group of near copies whose buckets are led by a document outside of it."""
    held = []
    before = near_dedup.block_links

    def counted(sets, groups, percent):
        rows = groups.collect()
        for lead in {r["lead"] for r in rows}:
            own = [r for r in rows if r["lead"] == lead]
            held.append(len(own) * sum(r["comp"] != r["main"] for r in own))
        return before(sets, groups, percent)

    monkeypatch.setattr(near_dedup, "block_links", counted)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    work = {}
    for n in (200, 800):
        far = list(base)
        for at in range(0, 300, 30):  # shares bands with the group, but is not similar enough
            far[at] = "other"
        rows = [(0, " ".join(far), None)]
        for i in range(1, n + 1):
            words = list(base)
            words[rng.randrange(300)] = f"x{i}"
            rows.append((i, " ".join(words), None))
        held.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), k=3, percent=85).collect()}
        assert got == {0: 0} | {i: 1 for i in range(1, n + 1)}
        work[n] = sum(held)
    assert work[800] <= 5 * max(work[200], 200)


def test_hot_keys_are_joined_without_a_shuffle_of_them(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 10)
    rows = [(i, "copies of one text all over", "") for i in range(60)] + [(100 + i, "", "") for i in range(60)]
    rows += [(200 + i, "one long text of many words that is nearly the same everywhere else " * 3 + str(i), "") for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), k=3, percent=85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 3, 85).items()}
    left = spark.createDataFrame([(i % 3, i) for i in range(300)] + [(7, 1), (9, 2)], "k long, v long")
    right = near_dedup.cut(spark.createDataFrame([(0, 100, "a"), (1, 5, "b"), (2, 100, "c"), (7, 1, "d")], "k long, c long, w string"))
    for how in ("inner", "left"):
        want = left.join(right.drop("c"), ["k"], how)
        assert sorted(map(str, near_dedup.with_one(left, right, ["k"], 100, how).collect())) == sorted(map(str, want.collect()))
