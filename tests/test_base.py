import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sievemill import catalog
from sievemill.functions import sequences as seq
from sievemill.operators import intervals
from sievemill.sources import text_formats as tf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert rows == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str) and rows


def test_entry_has_every_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_binned_join_as_by_naive_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, None]), s, s + rng.choice([0, 1, 5, 300]), i) for i in range(300) for s in [rng.randrange(-500, 900)]]
    a = spark.createDataFrame(rows, "g int, start long, end long, a int")
    b = spark.createDataFrame(rows[::2], "g int, start long, end long, b int")
    want = sorted((x[3], y[3]) for x in rows for y in rows[::2] if x[0] is not None and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    for width in (1, 64, 10_000):
        assert sorted(map(tuple, intervals.overlap_join(a, b, "g", width).select("a", "b").collect())) == want


def test_overlap_totals_as_by_naive_join(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, None]), s, s + rng.choice([0, 1, 5, 300, -4]), i, "x") for i in range(300) for s in [rng.choice([rng.randrange(-500, 900), 10, 9_000_000_000 + i])]]
    rows += [(0, None, 4, 300, "x"), (0, 4, None, 301, "x")]
    names = "g int, start long, end long, id int, __v_start string"
    a, b = spark.createDataFrame(rows, names), spark.createDataFrame(rows[::2] + rows[:40:2], names)
    want = []
    for g, s, e, i, _ in rows[::2] + rows[:40:2]:
        met = [r for r in rows if None not in (g, s, e, *r[:3]) and r[0] == g and r[1] < r[2] and s <= e and r[1] < e and s < r[2]]
        want += [(i, len(met), sum(min(e, r[2]) - max(s, r[1]) for r in met))] if met else []
    for width in (1, 64, 1 << 16):
        got = intervals.overlap_totals(a, b, "g", width)
        assert got.columns == [*b.columns, "n", "shared"]
        assert sorted(map(tuple, got.select("id", "n", "shared").collect())) == sorted(want)
    assert intervals.overlap_totals(a.limit(0), b, "g").count() == intervals.overlap_totals(a, b.limit(0), "g").count() == 0


def _nodes(plan):
    """Nodes of an executed plan, also below adaptive ones."""
    below = plan.children()
    inner = [getattr(plan, x)() for k, x in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if plan.getClass().getSimpleName().endswith(k)]
    return [plan] + [n for p in [*inner, *(below.apply(i) for i in range(below.size()))] for n in _nodes(p)]


def test_overlap_query_makes_no_pairs(spark, tmp_path):
    """All of 5,000 reads meet all of 400 regions; also regions without length, of no length known and repeated."""
    spark.range(5000).selectExpr("id * 400000 AS l_orderkey", "0L AS l_partkey", "5L AS l_suppkey", "1 AS l_linenumber", "50.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    regions = spark.range(400).selectExpr("id * 400000 AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    regions = regions.union(regions.limit(9)).union(spark.sql("SELECT 2000000, CAST(NULL AS INT) UNION ALL SELECT NULL, 4"))
    regions.union(spark.sql(f"SELECT 5L * {pow(7907, -1, 80000)}, 0")).write.parquet(f"{tmp_path}/part.parquet")
    query = catalog.QUERIES["interval_overlap_join"](spark, str(tmp_path))
    got = sorted(map(tuple, query.collect()))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLE_SQL["interval_overlap_join"]).fetchall()) and sum(r[1] for r in got) > 1_900_000
    nodes = _nodes(query._jdf.queryExecution().executedPlan())
    made = [n.metrics().apply("numOutputRows").value() for n in nodes if n.metrics().contains("numOutputRows")]
    assert any("Join" in n.nodeName() for n in nodes) and max(made) <= 2 * 5000 + 2 * 500
    read = [n for n in nodes if "l_quantity" in n.toString().split("\n")[0] and n.nodeName().startswith("Scan")]
    assert len({n.id() for n in read}) == 1


def test_depth_and_merge(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 3, 8), ("c", 8, 9), ("c", 20, 21), ("c", 4, 4)], "g string, start long, end long")
    assert sorted(map(tuple, intervals.merged(df, "g").collect())) == [("c", 1, 9, 3), ("c", 20, 21, 1)]
    assert sorted(map(tuple, intervals.depth(df, "g").collect())) == [("c", 1, 3, 1), ("c", 3, 5, 2), ("c", 5, 9, 1), ("c", 20, 21, 1)]
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([0, 1, 4, 30, 200]), i, "x") for i in range(250) for s in [rng.choice([rng.randrange(-900, 900), 10])]] + [("a", None, 4, 1, "x"), ("a", 4, None, 1, "x")]
    df = spark.createDataFrame(rows, "reach string, start long, end long, island int, bin string")
    islands, heights = [], []
    for g in ("a", "b", None):
        own = sorted(r[1:3] for r in rows if r[0] == g and None not in r[1:3] and r[1] < r[2])
        cuts = sorted({x for r in own for x in r})
        for a, z in own:
            if islands and islands[-1][0] == g and a <= islands[-1][2]:
                islands[-1] = (g, islands[-1][1], max(z, islands[-1][2]), islands[-1][3] + 1)
            else:
                islands.append((g, a, z, 1))
        for a, z in zip(cuts, cuts[1:], strict=False):
            n = sum(x <= a and y >= z for x, y in own)
            if n and heights and heights[-1][0] == g and heights[-1][2:] == (a, n):
                heights[-1] = (g, heights[-1][1], z, n)
            elif n:
                heights.append((g, a, z, n))
    for width in (7, 64, 1 << 20):
        assert sorted(map(str, map(tuple, intervals.merged(df, "reach", width).collect()))) == sorted(map(str, islands))
        assert sorted(map(str, map(tuple, intervals.depth(df, "reach", width).collect()))) == sorted(map(str, heights))
    assert intervals.merged(df.limit(0), "reach").count() == intervals.depth(df.limit(0), "reach").count() == 0


def test_sequence_columns(spark):
    row = spark.range(1).select(
        seq.reverse_complement(F.lit("ACGTNx")), seq.phred_values(F.lit("!?J")), seq.phred_text(F.array(*map(F.lit, (0, 30, 41)))),
        seq.reference_length(F.lit("5S10M2I3D7M1H")), seq.query_length(F.lit("5S10M2I3D7M1H")), seq.query_length(F.lit("*")), seq.gc_share(F.lit("")),
    ).first()
    assert tuple(row) == ("xNACGT", [0, 30, 41], "!?J", 20, 24, 0, None)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t99\tchr1\t7\t30\t8M\t=\t37\t39\tTTAGATAA\t*\tNM:i:1\tSA:Z:x,1;\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = tf.read_sam(spark, str(tmp_path / "a.sam")).orderBy("qname").collect()
    assert rows[0]["pos"] == 7 and rows[0]["tags"] == {"NM:i": "1", "SA:Z": "x,1;"} and rows[1]["flag"] == 4 and rows[1]["tags"] == {}
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n20\t14370\trs1\tG\tA,T\t29\tPASS\tDP=14;AF=0.5,0.1;DB\n20\t5\t.\tC\t.\t.\t.\t.\n")
    rows = tf.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()
    assert rows[0]["info"] == {} and rows[0]["qual"] is None and rows[1]["info"] == {"DP": "14", "AF": "0.5,0.1", "DB": None} and rows[1]["alts"] == ["A", "T"]
    (tmp_path / "b.vcf").write_text("20\t7\trs1\tG\tA\t29\tPASS\tDP=14;DB;DP=3;DB=2\n")
    assert tf.read_vcf(spark, str(tmp_path / "b.vcf")).first()["info"] == {"DP": "14", "DB": None}
    (tmp_path / "b.sam").write_text("r1\t0\tc\t7\n@bad\nr2\tx\tc\t7\t30\t8M\t=\t37\t39\tTT\t*\tNM:i:1\tNM:i:2\tjunk\n")
    rows = tf.read_sam(spark, str(tmp_path / "b.sam")).orderBy("qname").collect()
    assert rows[0]["seq"] is None and rows[0]["tags"] == {} and rows[1]["flag"] is None and rows[1]["tags"] == {"NM:i": "1"}
    (tmp_path / "a.fa").write_text(">s1 first a>b one\nACGT\nAC\n>s2\r\nTT\r\n>s3\n>s4 \n\n")
    assert sorted(map(tuple, tf.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("s1", "first a>b one", "ACGTAC"), ("s2", "", "TT"), ("s3", "", ""), ("s4", "", "")]
    text = spark.createDataFrame([("r", "AC", "II")], "n string, s string, q string").select(tf.fastq_record("n", "s", "q")).first()[0]
    assert text == "@r\nAC\n+\nII"


def test_breakends(spark):
    alts = ["G]17:198982]", "]13:123456]T", "C[<ctg1>:7[", "[17:198983[A", "AGT.", ".ACT", "A", "<DEL>", None, "."]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(alts)], "i int, alt string").select("i", tf.breakend(F.col("alt")).alias("b")).orderBy("i").collect()
    want = [("G", True, "17", 198982, True), ("T", False, "13", 123456, False), ("C", True, "<ctg1>", 7, False), ("A", False, "17", 198983, True), ("AGT", True, None, None, None), ("ACT", False, None, None, None)]
    assert [r["b"] and tuple(r["b"]) for r in rows] == want + [None] * 4


def test_fastq_is_read_as_written(spark, tmp_path):
    from sievemill.sources.record_formats import FastqSource

    rows = [("r1", "ACGT", "@II!"), ("r2", "", ""), ("r3", "A", "+")]
    df = spark.createDataFrame(rows, "name string, seq string, qual string")
    tf.write_fastq(df, str(tmp_path / "out"))
    spark.dataSource.register(FastqSource)
    assert sorted(map(tuple, spark.read.format("fastq").load(str(tmp_path / "out")).select("name", "seq", "qual").collect())) == rows
    with pytest.raises(Exception, match="no FASTQ record"):
        tf.write_fastq(spark.createDataFrame([("r", "AC", "I")], "name string, seq string, qual string"), str(tmp_path / "bad"))


def test_aligned_bases(spark):
    rows = [("r1", 10, "2S3M1I2D1N2M1H", "ttACGiTT", "##IIJ!56", "x"), ("r2", 5, "2M", "*", "*", "y"), ("r3", 1, "*", "A", "I", "z"), ("r4", 1, None, None, None, None), ("r5", 7, "3M", "AC", "I", "w")]
    df = spark.createDataFrame(rows, "name string, pos long, cigar string, seq string, qual string, op string")
    got = [tuple(r) for r in seq.aligned_bases(df).drop("pos", "cigar", "seq", "qual").orderBy("name", "ref_pos").collect()]
    want = [("r1", 10, 2, "M", "A", 40), ("r1", 11, 3, "M", "C", 40), ("r1", 12, 4, "M", "G", 41)]
    want += [("r1", 13, None, "D", None, None), ("r1", 14, None, "D", None, None), ("r1", 15, None, "N", None, None), ("r1", 16, 6, "M", "T", 20), ("r1", 17, 7, "M", "T", 21)]
    want += [("r2", 5, 0, "M", None, None), ("r2", 6, 1, "M", None, None), ("r5", 7, 0, "M", "A", 40), ("r5", 8, 1, "M", "C", None), ("r5", 9, 2, "M", None, None)]
    assert got == want
