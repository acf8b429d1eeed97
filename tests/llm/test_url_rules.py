import random
import re

from pyspark.sql import functions as F

from sievemill.llm import url_rules as u

SCHEMA = "page_id long, url string, host string, token int"
FIXED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    best = max((r for r in FIXED if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def pages(spark):
    rng = random.Random(4)
    parts = ["http://", "://", "A.example.org", "example.org", "xexample.org", "b.COM", "com", "É.com", "/", "/es/", "/en/1", "/en/2", "/fr/", "/de/x", "?q=/es/", "#", "?", "", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(7))), "x", 1) for i in range(1500)]
    rows += [(5000, None, None, 0), (5001, "no scheme.org/", "", 0), (5002, "http://a.org", "", 0), (5003, "http://a.org/" + "p" * 90_000, "", 0)]
    rows += [(5004, "http://same.net/a", "", 0)] * 3 + [(None, "http://same.net/a", "", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_fixed_rules_as_by_brute_force(spark):
    rows, df = pages(spark)
    none = u.mine(spark.createDataFrame([], "url string, bad int"))
    got = u.judge(df, FIXED, none).collect()
    want = sorted(str((i, *brute(url)[:3], brute(url)[3] or "allow")) for i, url, *_ in rows)
    assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert u.judge(df.limit(0), FIXED, none).count() == 0


def test_mined_rules_match_by_all_their_tokens(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        h, d, k = rng.choice(["a.net", "b.net", "c.net"]), rng.choice(["shop", "news", "blog"]), rng.choice(["", "?ref=x"])
        bad = (h == "a.net" and d == "shop") or rng.random() < 0.03
        rows.append((i, f"http://{h}/{d}/{i}{k}", int(not bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, quality int")
    labelled = u.labelled_urls(df.select("page_id", "url"), df.select(F.col("page_id").alias("doc_id"), "quality"))
    rules = u.mine(labelled)
    kept = [set(r["items"]) for r in rules.filter("block").collect()]
    assert {"host:a.net", "path:shop"} in kept
    assert not any(a < b for a in kept for b in kept if a == {"host:a.net", "path:shop"})
    got = u.judge(df.select("page_id", "url"), [], rules).collect()
    for r in got:
        assert (r["verdict"] == "block") == ("a.net/shop" in rows[r["page_id"]][1]), r
    # brute force over all rules
    all_rules = rules.collect()
    toks = {r["url"]: set(r["t"]) for r in df.select("url", u.tokens(F.col("url")).alias("t")).collect()}
    for r in got:
        fit = [x for x in all_rules if set(x["items"]) <= toks[rows[r["page_id"]][1]]]
        best = max(fit, key=lambda x: (x["confidence"], x["support"], x["block"], " ".join(x["items"])), default=None)
        assert r["mined"] == (best and " ".join(best["items"]))


def test_native_plan(spark):
    _, df = pages(spark)
    rules = spark.createDataFrame([(1, ["host:same.net"], True, 0.9, 0.1)], "rule_id long, items array<string>, block boolean, confidence double, support double")
    plan = u.judge(df, FIXED, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|BroadcastNestedLoop", plan)
    assert u.judge(df, [], rules).filter("verdict = 'block'").count() == 4


def labelled(spark, bad):
    """(url, bad) of three hosts with two folders each; ``bad`` tells from (host, folder)."""
    rng = random.Random(12)
    rows = []
    for i in range(6000):
        h, d = rng.choice(["a.net", "b.net", "c.net"]), rng.choice(["shop", "news"])
        rows.append((f"http://{h}/{d}/{i}", int(bad(h, d, rng))))
    return spark.createDataFrame(rows, "url string, bad int")


def test_nothing_is_mined_from_labels_that_do_not_depend_on_urls(spark):
    for share in (0.14, 0.5):
        assert u.mine(labelled(spark, lambda h, d, rng, share=share: rng.random() < share)).count() == 0
    few = spark.createDataFrame([(f"http://a.net/shop/{i}", 1) for i in range(12)] + [(f"http://b.net/{i}", 0) for i in range(50)], "url string, bad int")
    assert u.mine(few).count() == 0


def test_allow_rules_are_exceptions(spark):
    """A host that is mostly bad, with a folder that is good."""
    df = labelled(spark, lambda h, d, rng: h == "a.net" and rng.random() < (0.95 if d == "shop" else 0.0) or rng.random() < 0.02)
    more = spark.createDataFrame([(f"http://a.net/shop/more/{i}", 1) for i in range(1500)], "url string, bad int")
    rules = u.mine(df.unionByName(more))
    kept = {tuple(r["items"]): r["block"] for r in rules.collect()}
    assert kept[("host:a.net",)] and not kept[("host:a.net", "path:news")]
    pages = spark.createDataFrame([(1, "http://a.net/news/1"), (2, "http://a.net/shop/1"), (3, "http://b.net/news/2"), (4, "http://a.net/other")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.judge(pages, [], rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block"}


def test_hosts_of_many_labels_have_all_their_parents(spark):
    host = ".".join(f"l{i}" for i in range(90))
    got = spark.createDataFrame([(f"http://{host}/x",)], "url string").select(u.tokens(F.col("url")).alias("t")).first()["t"]
    assert {f"host:{host}", "host:l89", "host:l88.l89"} <= set(got)
