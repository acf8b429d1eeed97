import hashlib
import math
import random
import re
import time

import pytest

from sievemill.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, spans string"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] * (13 <= len(d) <= 19 and luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", m.start(), m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(1)
    found = []
    for _ in range(60):
        found += [f"{rng.choice('abc')}x.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", ".".join(str(rng.randrange(256)) for _ in range(4)), str(rng.randrange(10**6)), f"token{rng.randrange(99)}"]
        d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        found.append(next(d + c for c in "0123456789" if luhn(d + c)))
    return pii.fit(found, passes=12)


def test_base_as_by_brute_force(spark, weights):
    rng = random.Random(7)
    parts = ["a.b", "@", "mail", ".", "com", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+", "+1", " (212) ", "555", "-", " ", "  ", "\n", "\t", "é", "漢", "(", ")", "٣", "0000000001", "x@y.z", "000", "\x1c", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), 0, "c") for i in range(3000)]
    rows += [(9000, None, 0, ""), (9001, "", 0, ""), (9002, "7" * 60_000, 0, ""), (9002, "7" * 60_000, 0, ""), (9003, "a " * 50_000 + "x@y.zz", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in pii.find(docs, weights, ["doc_id", "spans"], "found").collect():
        got.setdefault(r["doc_id"], []).append(r["found"])
    for i, t, *_ in rows:
        short = t is None or len(t) < 50_000
        if short:
            assert all(f["base_sha256"] == hashlib.sha256(brute(t or "").encode()).hexdigest() for f in got[i]), t
    assert got[9003][0]["n_email"] == 1 and len(got[9002]) == 2
    assert pii.find(docs.limit(0), weights, ["doc_id"], "f").count() == 0


def test_model_adds_what_patterns_miss(weights):
    base, more = pii.found_in("(212) 555-0147", weights)
    assert base == [] and [k for k, *_ in more] == ["phone"]
    for clean in ("2024-05-17", "12345", "3.14159", "10:30", "v1.2.3", "100 200", "4111111111111112"):
        assert pii.found_in(clean, weights) == ([], []), clean


def test_dynamic_program_is_exact(weights):
    s = "+1 (212) 555-0147 a@b.cd"
    lattice = pii.Lattice(s)
    score = lattice.scores(weights)

    def every(t):
        if t == len(lattice.cuts):
            yield 0.0, ()
            return
        for v, rest in every(t + 1):
            yield v, rest
        for k, (i, j) in enumerate(lattice.segments):
            if i == t:
                for kind in range(4):
                    for v, rest in every(j + 1):
                        yield v + score[k, kind], ((k, kind), *rest)

    ways = list(every(0))
    post, whole = lattice.posteriors(score)
    assert whole == pytest.approx(math.log(sum(math.exp(v) for v, _ in ways)))
    assert tuple(lattice.best(score)) == max(ways)[1]
    k, kind = lattice.best(score)[0]
    assert post[k, kind] == pytest.approx(sum(math.exp(v - whole) for v, way in ways if (k, kind) in way))


def test_redaction(spark, weights):
    rows = [(1, "é call +1 (212) 555-0147 or a.b@c.de now", 40, "s"), (2, "clean text 12", 13, None), (3, None, None, None)]
    out = pii.redact(spark.createDataFrame(rows, SCHEMA), weights)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "é call [phone] or [email] now", 29, "s"), (2, "clean text 12", 13, None), (3, None, None, None)]
    assert out.dtypes == spark.createDataFrame(rows, SCHEMA).dtypes


def test_national_numbers_in_the_sample_are_no_negatives():
    rng = random.Random(2)
    found = []
    for _ in range(60):
        found += [f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", f"a.b{rng.randrange(99)}@mail.example.com", str(rng.randrange(10**6)), f"token{rng.randrange(99)}"]
        found += [f"{rng.randrange(1990, 2030)}-0{rng.randrange(1, 9)}-{rng.randrange(10, 29)}", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    weights = pii.fit(found, passes=12)
    assert pii.found_in("(212) 555-0147", weights) == ([], [("phone", 0, 14)])
    for clean in ("2024-05-17", "12345", "100 200", "4111111111111112"):
        assert pii.found_in(clean, weights) == ([], []), clean


def features(s, left, right):
    """As stated, one segment at a time."""
    d = re.sub("[^0-9]", "", s)
    at, n = s.count("@"), len(d)
    local, _, domain = s.partition("@")
    labels, dotted = domain.split("."), s.split(".")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    four = len(dotted) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in dotted)
    plain, ok = set(s) <= set("0123456789 ().+-"), "[A-Za-z0-9._%+-]+"
    email = at == 1 and len(labels) > 1 and all(re.fullmatch(ok, x) for x in labels) and labels[-1].isalpha() and len(labels[-1]) > 1
    out = [1, at == 1, at > 1, at == 1 and re.fullmatch(ok, local), email, " " in s, s[0] == "+", s.count("+") > (s[0] == "+")]
    out += [n < 7, 7 <= n <= 9, 10 <= n <= 11, n == 12, 13 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(d), four, not four and len(dotted) > 2]
    out += [any(c.isalpha() for c in s), "(" in s, s.count("(") != s.count(")"), "-" in s, groups[-2:] == [3, 4], len(groups) > 1 and set(groups) == {4}, plain, not plain and not at]
    out += [left in ("", " "), right in ("", " "), left.isalnum() or left in set("+.@-_%"), right.isalnum() or right in {"@", "-", "_"}, len(groups) > 5, "  " in s]
    return [float(bool(x)) for x in out]


PARTS = ["a.b", "@", "mail", ".", "com", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+", "+1", " (212) ", "555", "-", " ", "  ", "é", "漢", "(", ")", "٣", "0000000001", "x@y.zz", "000", "_", "%", "2024-05-17", "1.2.3.4", "300"]


def test_features_are_those_of_single_segments():
    rng = random.Random(5)
    for _ in range(800):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        lattice = pii.Lattice(s)
        cuts = [m.span() for m in re.finditer("(?s)[A-Za-z]+|[0-9]+|.", s)]
        assert lattice.cuts == cuts
        for (i, j), x in zip(lattice.segments, lattice.x.tolist(), strict=True):
            a, z = cuts[i][0], cuts[j][1]
            assert x == features(s[a:z], s[a - 1 : a] if a else "", s[z : z + 1]), s


def added(s, w):
    """What the model adds to a stretch, from all of its segments at once."""
    lattice = pii.Lattice(s)
    score = lattice.scores(w)
    post, _ = lattice.posteriors(score)
    return [(pii.KINDS[kind], lattice.cuts[lattice.segments[k][0]][0], lattice.cuts[lattice.segments[k][1]][1]) for k, kind in lattice.best(score) if post[k, kind] >= pii.POSTERIOR]


def test_added_spans_as_by_whole_lattices(weights, monkeypatch):
    rng = random.Random(6)
    found = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(600)] + ["(212) 555-0147", "call 212-555-0147 now"]
    want = [(k, *x) for k, s in enumerate(found) for x in added(s, weights)]
    assert len(want) > 10
    for window in (4096, 7, 1):
        monkeypatch.setattr(pii, "WINDOW", window)
        assert pii.likely(found, weights) == want


def test_a_long_table_of_numbers(weights):
    import tracemalloc

    rng = random.Random(7)
    s = " ".join(str(rng.randrange(10**5)) for _ in range(170_000)) + " +1 (212) 555-0147"
    tracemalloc.start()
    began = time.time()
    base, more = pii.found_in(s, weights)
    took, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(s) > 1_000_000 and ("phone", len(s) - 17, len(s)) in base and all(z - a < 80 for _, a, z in more)
    assert peak < 400e6 and took < 120
