"""Registered queries outside the corpus subpackage, with their DuckDB counterparts.

The tables have no genomic data; intervals, sequences and CIGAR strings are derived from
``lineitem`` and ``part`` by arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import sequences as seq
from sievemill.operators import intervals, references


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_suppkey % 5 AS contig", "(l_orderkey * 613 + l_partkey * 17) % 400000 AS start",
        "(l_orderkey * 613 + l_partkey * 17) % 400000 + 20 + CAST(l_quantity AS BIGINT) AS end", "l_orderkey", "l_linenumber",
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey % 5 AS contig", "(p_partkey * 7907) % 400000 AS start",
        "(p_partkey * 7907) % 400000 + CAST(p_size AS BIGINT) * 3 AS end", "p_partkey",
    )


READS_SQL = """SELECT l_suppkey % 5 AS contig, (l_orderkey * 613 + l_partkey * 17) % 400000 AS s,
  (l_orderkey * 613 + l_partkey * 17) % 400000 + 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem"""


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = intervals.overlap_totals(_reads(spark, sf_dir), _regions(spark, sf_dir), "contig")
    return totals.groupBy("p_partkey").agg(F.sum("n").alias("n_reads"), F.sum("shared").alias("shared_bases"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(_regions(spark, sf_dir), "contig")


def interval_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth(_reads(spark, sf_dir), "contig")


def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTNRYSWKMBDHVA")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", bases.alias("seq"))
    return rows.select("p_partkey", seq.reverse_complement(F.col("seq")).alias("reversed"), seq.gc_share(F.col("seq")).alias("gc"))


def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cigar = F.expr("concat(p_size, 'M', p_partkey % 9 + 1, 'I', p_size % 4 + 1, 'D30=', p_partkey % 3 + 1, 'X5S')")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", cigar.alias("cigar"))
    return rows.select("p_partkey", seq.reference_length(F.col("cigar")).alias("on_reference"), seq.query_length(F.col("cigar")).alias("on_query"))


def quality_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "!\"#+5?IJ@ABCDEFG")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("quality"))
    values = seq.phred_values(F.col("quality"))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("p_partkey", F.array_join(values.cast("array<string>"), ",").alias("phred"), total.alias("total"), seq.phred_text(values).alias("again"))


def aligned_base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", "p_partkey * 7 AS pos", "concat(p_size % 3 + 1, 'S', p_size % 5 + 1, 'M', p_partkey % 2 + 1, 'I', p_partkey % 4 + 1, 'D', p_size % 7 + 1, 'M') AS cigar",
        "translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq", "'*' AS qual",
    )
    return seq.aligned_bases(rows).select("p_partkey", "ref_pos", "read_pos", "op", "base")


def subsequence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "CAST(p_partkey % 5 AS STRING) AS name", "(p_partkey DIV 5) * 32 AS start",
        "translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence",
    )
    regions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "CAST(l_suppkey % 6 AS STRING) AS contig",
        "(l_orderkey * 613 + l_partkey * 17) % 1500 - 40 AS start", "(l_orderkey * 613 + l_partkey * 17) % 1500 - 40 + CAST(l_quantity AS BIGINT) * 2 AS end",
    )
    found = references.subsequences(chunks, regions, 32)
    return found.groupBy("contig", "start", "end").agg(F.count("*").alias("n"), F.min("sequence").alias("sequence"), F.max("sequence").alias("same"))


QUERIES = {
    "quality_codecs": quality_codecs,
    "aligned_base_rows": aligned_base_rows,
    "subsequence_lookup": subsequence_lookup,
    "interval_overlap_join": interval_overlap_join,
    "interval_merge": interval_merge,
    "interval_depth": interval_depth,
    "sequence_functions": sequence_functions,
    "cigar_lengths": cigar_lengths,
}
FLAGSHIP = "interval_overlap_join"

ORACLE_SQL: dict[str, str] = {
    "quality_codecs": """
WITH q AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', '!"#+5?IJ@ABCDEFG') AS t FROM part),
v AS (SELECT p_partkey, t, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i]) - 33) AS v FROM q)
SELECT p_partkey, array_to_string(v, ',') AS phred, CAST(list_sum(v) AS BIGINT) AS total, t AS again FROM v""",
    "aligned_base_rows": """
WITH r AS (SELECT p_partkey, p_partkey * 7 AS pos, p_size % 3 + 1 AS s, p_size % 5 + 1 AS m, p_partkey % 2 + 1 AS ins, p_partkey % 4 + 1 AS del,
             p_size % 7 + 1 AS m2, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
x AS (SELECT p_partkey, seq, pos + i AS ref_pos, s + i AS read_pos, 'M' AS op FROM (SELECT *, unnest(range(m)) AS i FROM r)
  UNION ALL SELECT p_partkey, seq, pos + m + i, NULL, 'D' FROM (SELECT *, unnest(range(del)) AS i FROM r)
  UNION ALL SELECT p_partkey, seq, pos + m + del + i, s + m + ins + i, 'M' FROM (SELECT *, unnest(range(m2)) AS i FROM r))
SELECT p_partkey, CAST(ref_pos AS BIGINT) AS ref_pos, CAST(read_pos AS BIGINT) AS read_pos, op, CASE WHEN op = 'M' THEN seq[read_pos + 1] END AS base FROM x""",
    "subsequence_lookup": """
WITH c AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS contig, string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), ''
             ORDER BY p_partkey // 5) AS whole, min(p_partkey // 5) * 32 AS first FROM part GROUP BY 1),
r AS (SELECT CAST(l_suppkey % 6 AS VARCHAR) AS contig, (l_orderkey * 613 + l_partkey * 17) % 1500 - 40 AS start,
        (l_orderkey * 613 + l_partkey * 17) % 1500 - 40 + CAST(l_quantity AS BIGINT) * 2 AS "end" FROM lineitem),
f AS (SELECT r.*, substring(whole, CAST(greatest(start - first, 0) + 1 AS BIGINT), CAST(greatest("end" - first, 0) - greatest(start - first, 0) AS BIGINT)) AS sequence FROM r LEFT JOIN c USING (contig))
SELECT contig, start, "end", count(*) AS n, min(sequence) AS sequence, max(sequence) AS same FROM f GROUP BY 1, 2, 3""",
    "interval_overlap_join": f"""
WITH r AS ({READS_SQL}),
w AS (SELECT p_partkey, p_partkey % 5 AS contig, (p_partkey * 7907) % 400000 AS s,
        (p_partkey * 7907) % 400000 + CAST(p_size AS BIGINT) * 3 AS e FROM part)
SELECT p_partkey, count(*) AS n_reads, CAST(sum(least(r.e, w.e) - greatest(r.s, w.s)) AS BIGINT) AS shared_bases
FROM r JOIN w ON r.contig = w.contig AND r.s < w.e AND w.s < r.e GROUP BY p_partkey""",
    "interval_merge": """
WITH w AS (SELECT p_partkey % 5 AS contig, (p_partkey * 7907) % 400000 AS s,
        (p_partkey * 7907) % 400000 + CAST(p_size AS BIGINT) * 3 AS e FROM part),
m AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY contig, k""",
    "interval_depth": f"""
WITH r AS ({READS_SQL}),
p AS (SELECT contig, s AS pos, 1 AS d FROM r UNION ALL SELECT contig, e, -1 FROM r),
g AS (SELECT contig, pos, sum(d) AS d FROM p GROUP BY contig, pos HAVING sum(d) <> 0),
x AS (SELECT contig, pos AS start, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS "end",
        CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM g)
SELECT contig, start, "end", depth FROM x WHERE depth > 0""",
    "sequence_functions": """
WITH s AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTNRYSWKMBDHVA') AS seq FROM part)
SELECT p_partkey, reverse(translate(seq, 'ACGTNRYSWKMBDHV', 'TGCANYRSWMKVHDB')) AS reversed,
  CAST(length(regexp_replace(seq, '[^GCS]', '', 'g')) AS DOUBLE) / length(seq) AS gc FROM s""",
    "cigar_lengths": """
SELECT p_partkey, CAST(p_size + (p_size % 4 + 1) + 30 + (p_partkey % 3 + 1) AS BIGINT) AS on_reference,
  CAST(p_size + (p_partkey % 9 + 1) + 30 + (p_partkey % 3 + 1) + 5 AS BIGINT) AS on_query FROM part""",
}
