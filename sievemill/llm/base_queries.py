"""Queries of what the corpus operators compute by stated rules, without a learned part,
each with its DuckDB SQL: counts of words and lines (op3), the patterns' spans (op4, op8),
hosts, paths and fixed rules (op5). Each reads its whole table through its operator.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import pii, quality_rules, secrets, url_rules
from sievemill.llm.common import table


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"), [], ["doc_id"], "j")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("doc_id", *(f"j.{c}" for c in names))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"), secrets.fit([], []), ["doc_id"], "f")
    return found.select("doc_id", *(f"f.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256")))


def personal_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = np.zeros((len(pii.KINDS), pii.FEATURES))
    found = pii.find(table(spark, sf_dir, "documents"), none, ["doc_id"], "f")
    return found.select("doc_id", *(f"f.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")))


def fixed_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemill.llm.queries import FIXED_RULES

    url = F.col("url").cast("string")
    rows = table(spark, sf_dir, "pages").select("page_id", url_rules.host(url).alias("host"), url_rules.path(url).alias("path"))
    rule, verdict = url_rules.fixed_rule(FIXED_RULES, "host", "path")
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


QUERIES = {
    "document_counts": document_counts,
    "secret_base_spans": secret_base_spans,
    "personal_base_spans": personal_base_spans,
    "fixed_url_rules": fixed_url_rules,
}

DOCUMENT_COUNTS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS three
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n FROM m, (VALUES (0), (1), (2)) AS o(j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(u.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN u USING (r) LEFT JOIN p USING (r)
"""


def _found(kind: str, pattern: str, keep: str, order: int) -> str:
    """Rows (r, kind, s, e) of a pattern's matches ``m`` that meet ``keep``: what is between
    matches gives their places."""
    return f"""
SELECT r, {order} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT r, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) - length(m) AS s FROM (
    SELECT r, unnest(ms) AS m, unnest(list_slice(gaps, 1, len(ms))) AS gap, unnest(range(len(ms))) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)))
WHERE {keep}"""


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    found = "\nUNION ALL".join(_found(kind, pattern, keep, k) for k, (kind, pattern, keep) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    names = ", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind, *_ in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
a AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS spans FROM f GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (r)
"""


def _either(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = rf"""(?:{_either("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?"""
SECRETS = _spans(
    [
        ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ],
    "s, o",
)

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INT) ELSE (2 * CAST({_DIGITS}[-i] AS INT)) % 10 + (2 * CAST({_DIGITS}[-i] AS INT)) // 10 END)) % 10 = 0"""
PERSONAL = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        (
            "ip",
            r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
            "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0",
        ),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ],
    "o, s",
)

FIXED_URLS = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
f AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS f(h, q, v)),
b AS (SELECT r, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS verdict
      FROM p JOIN f ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN b USING (r)
"""

ORACLE_SQL = {
    "document_counts": DOCUMENT_COUNTS,
    "secret_base_spans": SECRETS,
    "personal_base_spans": PERSONAL,
    "fixed_url_rules": FIXED_URLS,
}
