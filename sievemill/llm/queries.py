"""The registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import base_queries, line_crf, mixing, near_dedup, packing, pii, quality_rules, search, secrets, token_files, url_rules
from sievemill.llm.common import is_held_out, table
from sievemill.llm.tokens import tokenizer_path


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return quality_rules.judged(docs, rules, ["doc_id"], "j").select("doc_id", *(f"j.{c}" for c in names))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    return secrets.find(docs, secrets.train(docs), ["doc_id"], "f").select("doc_id", *(f"f.{c}" for c in names))


#: (host, path, verdict): fixed values of the query.
FIXED_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_rules.mine(url_rules.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, FIXED_RULES, rules)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(manifest, folder)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.scores(docs, model, ["doc_id"], "score")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= line_crf.GOOD).cast("int").alias("predicted"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more"]
    return pii.find(docs, pii.train(docs), ["doc_id"], "f").select("doc_id", *(f"f.{c}" for c in names))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position"
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries, k=10)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_rules": op5_url_rules,
    "op6_token_files": op6_token_files,
    "op7_line_crf": op7_line_crf,
    "op8_pii": op8_pii,
    "op9_mix_sources": op9_mix_sources,
    "op10_top_k": op10_top_k,
} | base_queries.QUERIES

OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)) AS h
  FROM documents),
b AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS nth FROM s),
w AS (SELECT *, CASE nth WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             CASE nth WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS f,
             CASE nth WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS l,
             2.0::DOUBLE * source_size AS cap FROM n),
r AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, nth, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, nth, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, coalesce(least(cap, max(CASE WHEN level <= cap / w THEN level END) OVER () * w), cap) AS target FROM r),
j AS (SELECT b.doc_id, b.source, b.size, b.before, g.source_size, g.target, g.f, g.l, CAST(round(g.target) AS BIGINT) AS goal
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - source_size - before)) AS taken,
             least(greatest(before / target, 0.0::DOUBLE), 1.0::DOUBLE) AS part FROM j)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, source,
       CASE WHEN taken > 0 THEN CASE WHEN f = l THEN part
            ELSE (sqrt(greatest(f * f + (l - f) * part * (f + l), 0.0::DOUBLE)) - f) / (l - f) END END AS position
FROM t
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '(?:[0-9a-z]|[^\x00-\x7F])+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
c AS (SELECT count(*) AS n, (SELECT count(*) FROM t) / count(*) AS average FROM documents),
w AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM f, c GROUP BY term, n),
s AS (SELECT q.doc_id AS query_id, f.doc_id, round(sum(idf * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / average))), 6) AS score
      FROM f q JOIN w USING (term) JOIN f USING (term) JOIN l ON l.doc_id = f.doc_id, c WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_top_k": OP10_SQL,
} | base_queries.ORACLE_SQL
