import glob
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from test_mixing import filled
from test_near_dedup import brute as near_classes
from test_packing import check
from test_pii import added
from test_pii import brute as base_spans

import corpus_pipeline
from sievemill.llm import pii, quality_rules, textbuf
from sievemill.llm.common import shared_dir
from sievemill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, judged string, stream int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []

    def add(text, source="s1"):
        rows.append((len(rows), text, "en", source, len(text or ""), "x", 1))

    for i in range(240):
        add(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 200))) + ".", f"s{i % 4}" if i % 3 else "s0")
    for i in range(20):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        add(" ".join(words))
        add(rows[i][1])
    for i in range(40):
        add(" | ".join(rng.choice(vocabulary) for _ in range(80)))
    for i in range(20):
        add(rows[100 + i][1] + f" mail x{i}.y@host{i}.example.com or +1 (212) 555-01{i:02d} now", "s2")
    add(None)
    add("")
    rows.append((None, "no id " + rows[50][1], None, None, None, None, None))
    rows += [rows[60], rows[60]]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int("|" not in (r[1] or "|"))) for r in rows if r[0] is not None]
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"http://h{i % 9}.example.org/en/{i}", "<p>") for i in range(200)] + [(900, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, rows


def failed_base(text):
    """The stated rule, and what learned rules look at, from the words on."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        again |= {i + j for i in at for j in range(3) if len(at) > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = max(1, len(words)), max(1, len(text or ""))
    values = {
        "symbols_per_word": len(re.findall(r"[#*$%&|<>]", text or "")) / n,
        "duplicate_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "repeated_word_share": len(again) / n,
        "chars_per_word": sum(map(len, words)) / n,
        "words_per_line": n / max(1, len(lines)),
        "upper_share": len(re.findall("[A-ZÀ-Þ]", text or "")) / chars,
        "stops_per_word": len(re.findall("[.!?,;:]", text or "")) / n,
        "digit_share": len(re.findall("[0-9]", text or "")) / chars,
        "distinct_word_share": len(set(words)) / n,
    }
    return len(words) < 50 or 100 * len(again) > 50 * len(words), values


def redacted(text, w):
    texts = textbuf.Texts(pa.array([text]))
    data, spans = text.encode(), [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in base_spans(text).split(",") if x)]
    for _, a, z in zip(*pii.stretches(texts), strict=True):
        at = len(data[:a].decode())
        spans += [(k, at + x, at + y) for k, x, y in added(data[a:z].decode(), w) if not any(at + x < e and at + y > b for _, b, e in spans)]
    out, at = "", 0
    for kind, a, z in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, z)
    return out + text[at:]


def test_run_as_by_brute_force(spark, folder):
    """Each stage of a run, from what the one before wrote, with the trained rules and weights."""
    at, rows = folder
    before = set(glob.glob(f"{shared_dir(spark)}/pipeline-*".removeprefix("file:")))
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    (own,) = set(glob.glob(f"{shared_dir(spark)}/pipeline-*".removeprefix("file:"))) - before
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    stage = {name: spark.read.parquet(f"{own}/{name}") for name in names}
    assert all(stage[name].columns == docs.columns for name in names[:-1])
    got = {name: [tuple(r) for r in stage[name].collect()] for name in names}

    def same(x, y):
        return sorted(map(str, x)) == sorted(map(str, y))

    # quality rules
    rules = quality_rules.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    want = []
    for r in rows:
        failed, values = failed_base(r[1])
        bad = any(all((values[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        want += [r] * (not failed and not bad)
    assert rules and same(got["quality_rules"], want) and {r[0] for r in want} == {r[0] for r in rows if r[1] and "|" not in r[1]}
    # near duplicates: the smallest id of each class; a row without an id stays if no set equals its own
    named = [r for r in want if r[0] is not None]
    classes = near_classes([(r[0], r[1], None) for r in named], 5, 80)
    want = list({r[0]: r for r in named if classes[r[0]][2]}.values()) + [r for r in want if r[0] is None]
    assert same(got["near_dedup"], want) and len(want) == 241
    # personal data
    w = pii.train(stage["near_dedup"])
    texts = [redacted(r[1], w) for r in want]
    want = [(r[0], t, *r[2:4], len(t), *r[5:]) for r, t in zip(want, texts, strict=True)]
    assert same(got["pii"], want) and not any(re.search(r"@host|555-01", t) for t in texts)
    # mixing: whole documents, each at most twice, every source near its target
    sizes, taken, times = {}, {}, Counter(got["mixing"])
    for r in want:
        sizes.setdefault(r[3], []).append(len(r[1].split()))
    for r in got["mixing"]:
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    assert set(times) <= set(want) and max(times.values()) <= 2
    target = filled({k: sum(v) for k, v in sizes.items()})
    assert all(abs(taken.get(k, 0) - target[k]) <= max(v) for k, v in sizes.items())
    # packing, by the library's ids of whole texts
    used = check([(r[0], r[1], None) for r in got["mixing"]], out.collect(), 2048)
    assert used <= 1.05 * sum(r["length"] for r in out.collect()) / 2048 + 1


def test_queries(spark, folder):
    at, rows = folder
    for name, query in QUERIES.items():
        n = query(spark, at).count()
        if name == "op5_url_rules" or name == "fixed_url_rules":
            assert n == 201
        elif name in ("op2_best_fit_packing", "op10_top_k"):
            assert n > 0, name
        else:
            assert n == len(rows), name
