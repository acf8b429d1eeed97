import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sievemill.operators.references import subsequences
from sievemill.sources import record_formats as rf
from sievemill.sources.record_formats import BamSource, FastaSource, FastqSource


def bam(records):
    out = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for name, length in ((b"chr1", 100), (b"chr2", 50)):
        out += struct.pack("<i", len(name) + 1) + name + b"\0" + struct.pack("<i", length)
    for r in records:
        out += struct.pack("<i", len(r)) + r
    half = len(out) // 2  # two members, as in BGZF
    return gzip.compress(out[:half]) + gzip.compress(out[half:])


def record(name, flag, ref, pos, cigar, seq, quals, mate, mate_pos, tags):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    head = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), mate, mate_pos, 9)
    return head + name + b"\0" + ops + packed + bytes(quals) + tags


def test_bam(spark, tmp_path):
    tags = b"NMC\x02" + b"SAZx,1;\0" + b"XAAq" + b"ZBBs" + struct.pack("<I2h", 2, -1, 3)
    rows = [
        record(b"r1", 99, 0, 6, [(3, "M"), (1, "I"), (1, "S")], "ACGTN", [0, 30, 40, 1, 2], 0, 36, tags),
        record(b"r2", 4, -1, -1, [], "", [], 1, 4, b""),
        record(b"r3", 0, 1, 0, [(2, "M")], "AC", [255, 255], -1, -1, b""),
    ]
    (tmp_path / "a.bam").write_bytes(bam(rows))
    (tmp_path / "b.bam").write_bytes(bam(rows[:1]))
    (tmp_path / ".skipped").write_bytes(b"")
    spark.dataSource.register(BamSource)
    df = spark.read.format("bam").load(str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    first = ("r1", 99, "chr1", 7, 30, "3M1I1S", "=", 37, 9, "ACGTN", "!?I\"#", {"NM:i": "2", "SA:Z": "x,1;", "XA:A": "q", "ZB:B": "s,-1,3"})
    assert got == [first, first, ("r2", 4, "*", 0, 30, "*", "chr2", 5, 9, "*", "*", {}), ("r3", 0, "chr2", 1, 30, "2M", "*", 0, 9, "AC", "*", {})]
    assert df.filter("rname = 'chr1' and pos < 10").count() == 2
    (tmp_path / "c.bam").write_bytes(b"text")
    with pytest.raises(Exception, match="no BAM file"):
        spark.read.format("bam").load(str(tmp_path / "c.bam")).collect()


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 one two\nACGT\n+\n@II!\n@r2\n\n+r2\n\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@r3\nAC\n+\nII\n"))
    spark.dataSource.register(FastqSource)
    got = sorted(map(tuple, spark.read.format("fastq").load(f"file://{tmp_path}").collect()))
    assert got == [("r1", "one two", "ACGT", "@II!"), ("r2", "", "", ""), ("r3", "", "AC", "II")]


def bgzf(data, size):
    """(the file, where each block begins in it)."""
    out, starts = b"", []
    for at in [*range(0, len(data), size), None]:
        part = b"" if at is None else data[at : at + size]  # the last block is empty
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(part) + press.flush()
        starts.append(len(out))
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HHHH", 6, 0x4342, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, starts


def reg2bin(first, last):
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if first >> shift == last >> shift:
            return base + (first >> shift)
    return 0


def indexed(records, size):
    """A BAM file of blocks of ``size`` bytes, and its BAI."""
    head = b"BAM\x01" + struct.pack("<ii", 0, 2)
    for name in (b"chr1", b"chr2"):
        head += struct.pack("<i", 5) + name + b"\0" + struct.pack("<i", 1 << 28)
    data, places = head, []
    for r in records:
        places.append(len(data))
        data += struct.pack("<i", len(r)) + r
    places.append(len(data))
    out, starts = bgzf(data, size)
    voffset = [starts[x // size] << 16 | x % size for x in places]
    bins, linear = [{}, {}], [{}, {}]
    for k, r in enumerate(records):
        ref, pos = struct.unpack_from("<ii", r)
        if ref >= 0:
            bins[ref].setdefault(reg2bin(pos, pos + 9), []).append((voffset[k], voffset[k + 1]))
            for w in range(pos >> 14, (pos + 9 >> 14) + 1):
                linear[ref].setdefault(w, voffset[k])
    bai = b"BAI\x01" + struct.pack("<i", 2)
    for own, lin in zip(bins, linear, strict=True):
        own = own | {37450: [(0, 0), (0, 0)]}
        bai += struct.pack("<i", len(own))
        for number, chunks in own.items():
            bai += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n = max(lin, default=-1) + 1
        last, row = 0, []
        for w in range(n):
            last = lin.get(w, last)
            row.append(last)
        bai += struct.pack("<i", n) + struct.pack(f"<{n}Q", *row)
    return out, bai


def test_indexed_bam_is_split_and_narrowed(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    spots = sorted((rng.randrange(2), rng.randrange(1 << 22)) for _ in range(900)) + [(-1, -1)] * 40
    records = [record(b"r%d" % i, 0 if ref >= 0 else 4, ref, pos, [(10, "M")], "ACGTACGTAC", [30] * 10, -1, -1, b"") for i, (ref, pos) in enumerate(spots)]
    data, bai = indexed(records, 1000)
    (tmp_path / "a.bam").write_bytes(data)
    (tmp_path / "a.bam.bai").write_bytes(bai)
    monkeypatch.setattr(rf, "SPLIT", 3000)
    reader = rf.BamReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 3 and parts[0].start is None and parts[-1].end is None
    got = [r["qname"] for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert got == [f"r{i}" for i in range(len(spots))]
    for contig, lo, hi in (("chr1", 1, 1 << 28), ("chr2", 100_000, 160_000), ("chr1", 4_000_000, 5_000_000), ("chr2", 20, 10), ("none", 1, 9)):
        reader = rf.NarrowBamReader(str(tmp_path))
        asked = [rf.EqualTo(("rname",), contig), rf.GreaterThan(("pos",), lo - 1), rf.LessThanOrEqual(("pos",), hi)]
        assert list(reader.pushFilters(asked)) == asked
        found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        want = [f"r{i}" for i, (ref, pos) in enumerate(spots) if f"chr{ref + 1}" == contig and lo <= pos + 1 <= hi]
        assert [r["qname"] for r in found if r["rname"] == contig and lo <= r["pos"] <= hi] == want
        assert len(found) <= len(want) + 150  # few others are read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    assert spark.read.format("bam").load(str(tmp_path)).count() == len(spots)
    df = spark.read.format("bam").option("narrow", True).load(str(tmp_path))
    assert df.filter("rname = 'chr2' and pos between 100000 and 160000").count() == sum(ref == 1 and 100_000 <= pos + 1 <= 160_000 for ref, pos in spots)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_fasta_chunks_and_regions(spark, tmp_path):
    rng = random.Random(4)
    seqs = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((0, 1, 99, 100, 1234))}
    text = "; a comment\n" + "".join(f">{k} a>b {k}\r\n" + "".join(v[i : i + 37] + "\n" for i in range(0, len(v), 37)) for k, v in seqs.items())
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(text.encode()))
    spark.dataSource.register(FastaSource)
    chunks = spark.read.format("fasta").option("width", 100).load(str(tmp_path))
    rows = sorted(chunks.collect(), key=lambda r: (r["name"], r["start"]))
    assert all("".join(r["sequence"] for r in rows if r["name"] == k) == v for k, v in seqs.items())
    assert all(r["start"] % 100 == 0 and r["description"] == f"a>b {r['name']}" for r in rows) and len(rows) == 1 + 1 + 1 + 1 + 13
    asked = [(f"c{rng.randrange(6)}", a, a + rng.randrange(-5, 400), i) for i, a in enumerate(rng.randrange(-50, 1400) for _ in range(200))]
    asked += [asked[0], (None, 1, 2, 500), ("c4", None, 3, 501)]
    regions = spark.createDataFrame(asked, "contig string, start long, end long, sequence int").withColumnRenamed("sequence", "id").withColumn("sequence", F.lit("x"))
    got = [(str(r["id"]), r["contig"], r["sequence"]) for r in subsequences(chunks, regions, 100).collect() if r["contig"]]

    def part(contig, a, z):
        if contig not in seqs or a is None or a >= z:
            return None
        return seqs[contig][max(a, 0) : max(z, 0)]

    assert sorted(map(str, got)) == sorted(str((str(i), c, part(c, a, z))) for c, a, z, i in asked if c)
    assert subsequences(chunks, regions.limit(0), 100).count() == 0
    assert subsequences(chunks.limit(0), regions, 100).filter("sequence is not null").count() == 0
