"""URL filters: fixed host rules, and association rules mined from labelled URLs.

A URL is a set of tokens (host, parent domains, path segments, query keys, extension).
Spark's FP-growth mines sets of tokens that go with a label from two thirds of the labelled
URLs. A page is allowed unless a rule blocks it, so a rule that blocks is kept if its
confidence lies surely above the share of bad pages, and one that allows if it is an
exception: if it has all tokens of a rule that blocks and surely more good pages than that.
"Surely" is by a lower confidence bound in the mined part, strict as many sets are tried,
and again in the third that was held out; few pages are never enough. A rule that a
shorter, no less confident one implies is dropped. Rules match by an inverted index: a
URL's tokens are joined with the rules' tokens, and a rule fits that has all of its tokens
there. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import cut, is_held_out

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of mined rules: share and least number of the mined URLs, confidence, and how many
#: standard errors the confidence must be above what it is held against, in the mined part
#: and in the held-out one.
SUPPORT, LEAST, CONFIDENCE, SURE, AGAIN = 0.003, 20, 0.6, 4.0, 1.64
#: Most labelled URLs to mine.
SAMPLE = 200_000
#: Most rules that are broadcast; more are joined by shuffling.
BROADCAST = 50_000


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """What rules are made of. Numbers are one token, whatever their value."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    plain = F.regexp_replace(path(url), "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(plain, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.element_at(F.split(x, "="), 1)))
    rest = F.array(
        F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([^:]*)://", 1)),
        F.when(plain.rlike(r"\.[A-Za-z]+$"), F.concat(F.lit("ext:"), F.regexp_extract(plain, r"\.([A-Za-z]+)$", 1))),
        F.when(plain.endswith("/"), F.lit("folder")),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    return F.array_distinct(F.array_compact(F.concat(parents, segments, keys, rest)))


def lower_bound(right: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share, ``right`` of ``n``."""
    p = right / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - half) / (1 + z * z / n)


def mine(urls: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, items, block, confidence, support) from (url, bad), ``bad`` 0 or 1.

    Consequents are the two labels. Only the URLs of a sample that is bounded by its caller
    are mined, so FP-growth's trees are bounded too. URLs are held out by a hash, so equal
    ones are on one side. A null URL has no tokens; an empty table gives no rules.
    """
    spark = urls.sparkSession
    empty = spark.createDataFrame([], "rule_id long, items array<string>, block boolean, confidence double, support double")
    rows = cut(urls.select(tokens(F.col("url")).alias("items"), "url", "bad", (F.pmod(F.xxhash64("url", F.lit(3)), F.lit(3)) == 0).alias("out")))
    sides = {r["out"]: r for r in rows.groupBy("out").agg(F.count("*").alias("n"), F.avg("bad").alias("bad")).collect()}
    if len(sides) < 2 or sides[False]["n"] < least:
        return empty
    n = sides[False]["n"]
    label = F.when(F.col("bad") == 1, F.lit("=block")).otherwise(F.lit("=allow"))
    baskets = rows.filter(~F.col("out")).select(F.array_append("items", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence).fit(baskets)
    head = F.element_at("consequent", 1)
    found = model.associationRules.filter(head.isin("=block", "=allow")).select(
        F.array_sort("antecedent").alias("items"), (head == "=block").alias("block"), "confidence", "support",
        F.round(F.col("support") * n).alias("right"),
    )
    sure = lower_bound(F.col("right"), F.col("right") / F.col("confidence"), SURE)
    found = cut(found.withColumn("rule_id", F.xxhash64("items", "block")).withColumn("sure", sure))
    # what a rule is held against in either part: the share of bad pages, or the good ones
    # among those that the rule with fewer of its tokens blocks
    blocks = found.filter("block").filter(F.col("sure") > sides[False]["bad"]).withColumn("above", F.lit(sides[True]["bad"]))
    blocks = again(rows.filter("out"), blocks)
    broader = blocks.select(F.col("rule_id").alias("of"), F.col("items").alias("wider"), F.col("confidence").alias("c"), F.col("again").alias("c2"))
    terms = found.filter("not block").select("rule_id", F.explode("items").alias("token"))
    fits = terms.join(broader.select("of", F.size("wider").alias("need"), F.explode("wider").alias("token")), "token")
    refined = fits.groupBy("rule_id", "of").agg(F.count("*").alias("k"), F.first("need").alias("need")).filter("k = need")
    against = refined.join(broader, "of").groupBy("rule_id").agg(F.max(1 - F.col("c")).alias("good"), F.max(1 - F.col("c2")).alias("above"))
    allows = again(rows.filter("out"), found.filter("not block").join(against, "rule_id").filter("sure > good"))
    names = ["rule_id", "items", "block", "confidence", "support"]
    rules = cut(blocks.select(*names).unionByName(allows.select(*names)))
    # implied: all items of a shorter rule of the same verdict and at least the confidence
    parts = F.when(F.size("items") > 1, F.transform("items", lambda x: F.array_except("items", F.array(x))))
    shorter = rules.select(F.col("items").alias("sub"), F.col("block").alias("b"), F.col("confidence").alias("c"))
    pairs = rules.select("rule_id", "block", "confidence", F.explode(F.concat(parts, F.transform("items", lambda x: F.array(x)))).alias("sub"))
    implied = pairs.join(shorter, ["sub"]).filter("block = b and c >= confidence").select("rule_id").distinct()
    return cut(rules.join(implied, "rule_id", "left_anti").select(*names))


def again(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``rules`` whose confidence in ``rows`` (url, items, bad) is surely above theirs in
    ``above``, with that confidence as ``again``."""
    rules = cut(rules)
    index = rules.select("rule_id", "block", F.size("items").alias("need"), F.explode("items").alias("token"))
    each = rows.groupBy("url", "bad").agg(F.count("*").alias("w"), F.first("items").alias("items"))
    terms = each.select("url", "bad", "w", F.explode("items").alias("token"))
    fits = terms.join(index, "token").groupBy("url", "bad", "rule_id").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("w", "block", "need"))).filter("k = need")
    right = F.sum(F.when(F.col("block") == (F.col("bad") == 1), F.col("w")).otherwise(0)).cast("double")
    seen = fits.groupBy("rule_id").agg(right.alias("r"), F.sum("w").alias("m")).withColumn("again", F.col("r") / F.col("m"))
    kept = rules.join(seen, "rule_id").filter(lower_bound(F.col("r"), F.col("m"), AGAIN) > F.col("above"))
    return cut(kept.drop("r", "m"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, block, mined) of the URLs that a rule fits: the rule of highest confidence,
    then support, then block before allow, then its items' order."""
    index = rules.select("rule_id", F.size("items").alias("need"), "block", "confidence", "support", F.array_join("items", " ").alias("mined"), F.explode("items").alias("token"))
    index = cut(index)
    if index.count() <= BROADCAST:
        index = F.broadcast(index)
    terms = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    fits = (
        terms.join(index, "token")
        .groupBy("url", "rule_id")
        .agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("need", "block", "confidence", "support", "mined")))
        .filter("n = need")
    )
    best = F.max(F.struct("confidence", "support", "block", "mined"))
    return fits.groupBy("url").agg(best.alias("b")).select("url", "b.block", "b.mined")


def fixed_rule(rules: list[tuple[str, str, str]], name: str, at: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits; rules are (host, path, verdict)."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col(name) == h) | F.col(name).endswith("." + h)) & F.col(at).startswith(p)
        said = F.lit(h + p)
        rule = F.when(fits, said) if rule is None else rule.when(fits, said)
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def labelled_urls(pages: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(url, bad): a page is labelled by the document that its path numbers: this link is an
    assumption, as the tables state none. Held-out documents and labels that disagree are
    left out; at most ``sample`` rows, by a hash."""
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .filter((F.col("lo") == F.col("hi")) & ~is_held_out(F.col("doc_id")))
    )
    url = F.col("url").cast("string")
    numbered = pages.select(url.alias("url"), F.regexp_extract(path(url), r"/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long").alias("doc_id"))
    rows = numbered.join(known, "doc_id").select("url", (F.col("lo") == 0).cast("int").alias("bad"), F.xxhash64("url").alias("h"))
    return rows.orderBy("h", "url").limit(sample).select("url", "bad")


def judge(pages: DataFrame, fixed: list[tuple[str, str, str]], rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined), a row for every row of ``pages``.

    The longest fixed rule decides; where none fits, the mined rule; where neither does, a
    page is allowed. A null URL, or one without ``://``, has an empty host and path. Rows
    that repeat are judged alike; an empty table gives an empty result. Very long URLs are
    judged whole. Other columns are not looked at.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = fixed_rule(fixed, "host", "path")
    rows = rows.withColumn("rule", rule).withColumn("fixed", verdict)
    open_ = rows.filter("fixed is null and url is not null").select("url").distinct()
    found = cut(matches(open_, rules))
    mined = F.when(F.col("fixed").isNull(), F.col("mined"))
    verdict = F.coalesce("fixed", F.when(F.col("block"), F.lit("block")), F.lit("allow"))
    return rows.join(found, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), mined.alias("mined"))
