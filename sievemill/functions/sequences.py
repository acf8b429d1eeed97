"""Column functions over nucleotide sequences, qualities and CIGAR strings, after the public
SAM specification. A null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and their complements.
IUPAC = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENT = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: Column) -> Column:
    """Characters that are no IUPAC code stay as they are."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def gc_share(seq: Column) -> Column:
    """Share of G, C and S among the bases; null for an empty sequence."""
    gc = F.length(seq) - F.length(F.regexp_replace(seq, "[GCSgcs]", ""))
    return F.when(F.length(seq) > 0, gc / F.length(seq))


def phred_values(quality: Column) -> Column:
    """Sanger-encoded (offset 33) qualities as an array of integers."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_text(values: Column) -> Column:
    return F.concat_ws("", F.transform(values, lambda q: F.char(q + 33)))


def cigar_operations(cigar: Column) -> Column:
    """array<struct<length, op>>; empty for ``*``."""
    lengths = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lengths, ops, lambda n, op: F.struct(n.cast("long").alias("length"), op.alias("op")))


def _consumed(cigar: Column, ops: str) -> Column:
    parts = F.filter(cigar_operations(cigar), lambda x: F.lit(ops).contains(x["op"]))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + x["length"])


def reference_length(cigar: Column) -> Column:
    return _consumed(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    return _consumed(cigar, "MIS=X")


def aligned_bases(df: DataFrame, pos: str = "pos", cigar: str = "cigar", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """A row for every reference position that a read's CIGAR covers: the other columns, then
    ``ref_pos``, ``read_pos`` (from 0; null in a deletion or skip), ``op``, ``base``, ``quality``.

    ``pos`` is 1-based, as in SAM. Insertions and clipped bases have no reference position
    and no row. A base is null where the sequence is ``*`` or too short, a quality where
    qualities are. Reads without a CIGAR (null or ``*``) give no rows. Rows that repeat give
    the same rows each; an empty table gives none. The new columns replace others of their
    names. Everything is a built-in expression over one read at a time.
    """
    ops = cigar_operations(F.col(cigar))
    start = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.array().cast("array<struct<op:string,length:bigint,ref:bigint,read:bigint>>").alias("parts"))

    def step(state: Column, x: Column) -> Column:
        on_ref, on_read = F.lit("MDN=X").contains(x["op"]), F.lit("MIS=X").contains(x["op"])
        part = F.struct(x["op"].alias("op"), x["length"].alias("length"), state["ref"].alias("ref"), F.when(on_read, state["read"]).alias("read"))
        return F.struct(
            (state["ref"] + F.when(on_ref, x["length"]).otherwise(0)).alias("ref"),
            (state["read"] + F.when(on_read, x["length"]).otherwise(0)).alias("read"),
            F.when(on_ref & (x["length"] > 0), F.array_append(state["parts"], part)).otherwise(state["parts"]).alias("parts"),
        )

    made = ("ref_pos", "read_pos", "op", "base", "quality")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    there = {c.lower() for c in df.columns} | set(made)
    part, offset = "__part", "__offset"
    while part in there or offset in there:
        part, offset = f"_{part}", f"_{offset}"
    parts = df.select("*", F.explode(F.aggregate(ops, start, step, lambda s: s["parts"])).alias(part))
    each = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{part}.length") - 1)).alias(offset))
    read = F.col(f"{part}.read") + F.col(offset)

    def at(column: str) -> Column:
        one = F.substr(F.col(column), (read + 1).cast("int"), F.lit(1))
        return F.when((F.col(column) != "*") & (one != ""), one)

    return each.select(
        *kept, (F.col(pos) + F.col(f"{part}.ref") + F.col(offset)).alias("ref_pos"), read.alias("read_pos"), F.col(f"{part}.op").alias("op"),
        at(seq).alias("base"), (F.ascii(at(qual)) - 33).alias("quality"),
    )
