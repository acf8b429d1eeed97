"""Look-ups in sequences that are stored in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subsequences(chunks: DataFrame, regions: DataFrame, width: int, contig: str = "contig") -> DataFrame:
    """``regions`` with the bases of the half-open, 0-based range [start, end) of their contig
    as ``sequence``.

    ``chunks`` has (name, start, sequence) with starts that are multiples of ``width``, as the
    ``fasta`` data source gives them. Only chunks that a region meets are joined, by contig
    and number; equal regions are looked up once. Positions outside of a contig have no
    bases, so a region may get fewer than it is long, or an empty text; an empty range or a
    null field gives null, as does a contig that isn't there. Rows that repeat stay; empty
    tables give no rows, or nulls. A ``sequence`` column of ``regions`` is replaced.
    """
    keys = ["__contig", "__start", "__end"]
    asked = regions.select(F.col(contig).alias(keys[0]), F.col("start").alias(keys[1]), F.col("end").alias(keys[2])).distinct().filter("__start < __end")
    lo, hi = F.floor(F.greatest(F.col("__start"), F.lit(0)) / width), F.floor((F.col("__end") - 1) / width)
    numbers = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array(lo))
    each = asked.select(*keys, F.explode(numbers).alias("__k"))
    stored = chunks.select(F.col("name").alias("__contig"), F.floor(F.col("start") / width).alias("__k"), F.col("sequence").alias("__bases"))
    met = each.join(stored, ["__contig", "__k"])
    begin = F.greatest(F.col("__start") - F.col("__k") * width, F.lit(0))
    stop = F.greatest(F.least(F.col("__end") - F.col("__k") * width, F.lit(width)), begin)
    part = F.substr("__bases", (begin + 1).cast("int"), (stop - begin).cast("int"))
    whole = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", part.alias("bases")))).alias("parts"))
    known = asked.join(chunks.select(F.col("name").alias("__contig")).distinct(), "__contig")
    text = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<__k:bigint,bases:string>>")), lambda x: x["bases"]), "")
    found = known.join(whole, keys, "left").select(*keys, text.alias("__found"))
    left = regions.drop("sequence")
    same = (left[contig] == F.col("__contig")) & (left["start"] == F.col("__start")) & (left["end"] == F.col("__end"))
    return left.join(found, same, "left").select(*(left[c] for c in left.columns), F.col("__found").alias("sequence"))
