"""Readers of text formats of sequencing data, after their public specifications. Paths are
read by Spark, so they can be globs, compressed, and in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mandatory fields of a SAM line and of a VCF line.
SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
SAM_NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")
VCF = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def _first_of_each(entries):
    """A map of (key, value) entries; of a key that repeats, the first one counts."""
    keys = F.transform(entries, lambda x: x["key"])
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The mandatory fields (pos 1-based, ``*`` kept) and ``tags``, a map of TAG:TYPE to value.

    Missing fields, and numbers that are none, are null; of a tag that repeats the first one
    counts, and what is no TAG:TYPE:VALUE is left out. Files without records give no rows.
    """
    fields = F.split("value", "\t")
    kinds = {c: "long" if c in SAM_NUMBERS else "string" for c in SAM}
    rest = F.slice(fields, len(SAM) + 1, F.greatest(F.size(fields) - len(SAM), F.lit(0)))
    pairs = F.transform(
        F.filter(rest, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")),
        lambda x: F.struct(F.substring(x, 1, 4).alias("key"), F.substr(x, F.lit(6)).alias("value")),
    )
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    return lines.select(*(F.get(fields, F.lit(i)).try_cast(kinds[c]).alias(c) for i, c in enumerate(SAM)), _first_of_each(pairs).alias("tags"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The fixed fields (pos 1-based), ``alts`` and ``info`` as a map; flags have null.

    Missing fields, and numbers that are none, are null; of a key that repeats the first one
    counts. Files without records give no rows.
    """
    fields = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = lines.select(*(F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(VCF)))
    entries = F.transform(
        F.filter(F.split("info", ";"), lambda x: (x != "") & (x != ".")),
        lambda x: F.struct(F.element_at(F.split(x, "=", 2), 1).alias("key"), F.get(F.split(x, "=", 2), F.lit(1)).alias("value")),
    )
    return rows.select(
        "chrom", F.col("pos").try_cast("long").alias("pos"), "id", "ref", F.split("alt", ",").alias("alts"),
        F.col("qual").try_cast("double").alias("qual"), "filter", _first_of_each(entries).alias("info"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence), a row for every record, which begins where a line
    begins with ``>``.

    A record is one row, so this is for short sequences; the ``fasta`` data source gives
    long ones in chunks. A file begins with a record; one without sequence has an empty one.
    """
    start = F.expr("value LIKE '>%'")
    records = spark.read.option("lineSep", "\n>").text(path).filter(~F.col("value").rlike(r"^>?\s*$"))
    # only a file's first record keeps its sign
    text = F.when(start, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    lines = F.split(text, "\r?\n", 2)
    head, body = F.element_at(lines, 1), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")
    name = F.element_at(F.split(head, r"\s", 2), 1)
    return records.select(name.alias("name"), F.trim(F.substr(head, F.length(name) + 1)).alias("description"), body.alias("sequence"))


#: The forms of a breakend's ALT in VCF, with its bases before or after the mate's place.
_MATE_AFTER = r"^([A-Za-z.*]*)([\[\]])(.+):([0-9]+)[\[\]]$"
_MATE_BEFORE = r"^([\[\]])(.+):([0-9]+)[\[\]]([A-Za-z.*]*)$"


def breakend(alt: Column) -> Column:
    """struct(bases, after, contig, pos, reversed) of an ALT that is a breakend, else null.

    ``after``: whether the mate's piece follows the bases; ``reversed``: whether it is the
    reverse complement. A single breakend (``A.`` or ``.A``) has a null contig and pos.
    """
    def made(bases: Column, after: bool, contig: Column, pos: Column, turned: Column) -> Column:
        return F.struct(
            bases.alias("bases"), F.lit(after).alias("after"), contig.cast("string").alias("contig"),
            pos.cast("long").alias("pos"), turned.cast("boolean").alias("reversed"),
        )

    none = F.lit(None)
    a, b = (lambda i: F.regexp_extract(alt, _MATE_AFTER, i)), (lambda i: F.regexp_extract(alt, _MATE_BEFORE, i))
    return (
        F.when(alt.rlike(_MATE_AFTER), made(a(1), True, a(3), a(4), a(2) == "]"))
        .when(alt.rlike(_MATE_BEFORE), made(b(4), False, b(2), b(3), b(1) == "["))
        .when(alt.rlike(r"^[A-Za-z*]+\.$"), made(F.regexp_replace(alt, r"\.$", ""), True, none, none, none))
        .when(alt.rlike(r"^\.[A-Za-z*]+$"), made(F.regexp_replace(alt, r"^\.", ""), False, none, none, none))
    )


def fastq_record(name: str, seq: str, qual: str):
    """A FASTQ record as one text column; columns are given by name."""
    return F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))


def write_fastq(df: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str = "qual", compression: str = "gzip") -> None:
    """The rows as FASTQ files in the folder ``path``, one for each partition, in their order.
    Rows without a name, sequence or quality, or with unequal lengths of these two, are an
    error: a file of them could not be read again."""
    fits = F.coalesce(F.length(seq) == F.length(qual), F.lit(False)) & F.col(name).isNotNull()
    record = F.when(fits, fastq_record(name, seq, qual)).otherwise(F.raise_error(F.lit("no FASTQ record: name, sequence or quality is missing or uneven")))
    df.select(record.alias("value")).write.option("compression", compression).text(path)
