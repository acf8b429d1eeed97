"""Mixing of sources to target weights as a curriculum that varies over time.

Every source has a weight schedule, here a ramp from a first to a last weight over the
training time 0 to 1. Its integral, scaled to the source's target, is the number of words
that training has asked of it by any time. A document that covers the words from c to
c + size of its source's stream stands where that demand reaches c, the inverse of the
integral. Documents of all sources are range-sorted by that position.

A source's stream is its documents by a hash; it starts anew where the target is above
the source's size. Running sums are taken inside salted buckets of a source and offset by
sums over the buckets before, so no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import WORD, buckets_for, cut, fresh

WEIGHTS = (5.0, 2.0, 1.0)
#: (first, last) weight of the ramps, one for each weight: heavy sources fade, light ones grow.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """(source, source_size, target, first, last), from (source, source_size).

    Sources in order of code points, null last, have ``weights`` in turn. They share
    ``share`` times all sizes by weight; none gets more than ``most`` times its size, and
    what it leaves is shared by the others. With the sources in the order in which they
    reach their bound, the level (words for each weight) follows from two running sums.
    These run over one row for each source in a single task: sources are parts of a corpus,
    thousands at most, not hosts.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)

    def pick(values: list) -> Column:
        out = F.lit(float(values[0]))
        for i, v in enumerate(values[1:], 1):
            out = F.when(F.col("nth") == i, F.lit(float(v))).otherwise(out)
        return out

    rows = (
        sizes.withColumn("nth", nth)
        .withColumn("w", pick([*weights]))
        .withColumn("first", pick([a for a, _ in ramps]))
        .withColumn("last", pick([b for _, b in ramps]))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("reach", F.col("cap") / F.col("w"))
    )
    order = Window.orderBy("reach", "nth", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    # the first level within its source's bound; levels after it are no higher
    found = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(all_rows)
    return rows.withColumn("target", F.coalesce(F.least("cap", found * F.col("w")), F.col("cap"))).select(
        "source", "source_size", "target", "first", "last"
    )


def positions(consumed: Column, target: Column, first: Column, last: Column) -> Column:
    """The time at which a source's demand reaches ``consumed``: with a weight of first +
    (last - first) t, the inverse of its integral, as a share of the whole."""
    part = F.least(F.greatest(consumed / target, F.lit(0.0)), F.lit(1.0))
    slope = last - first
    root = (F.sqrt(F.greatest(first * first + slope * part * (first + last), F.lit(0.0))) - first) / slope
    return F.when(target > 0, F.when(slope == 0, part).otherwise(root))


def streams(docs: DataFrame, **options) -> DataFrame:
    """``docs`` and a struct column, its name from ``stream_column``: size, source_size,
    target, goal (the target in whole words), before (words before it in its source's
    stream), first, last."""
    name = stream_column(docs)
    source, text, doc_id = F.col("source").cast("string"), F.col("text").cast("string"), F.col("doc_id")
    rows = docs.withColumn(
        name,
        F.struct(
            source.alias("source"),
            n_words(text).alias("size"),
            F.md5(F.concat_ws(":", doc_id.cast("string"), text)).alias("h"),
        ),
    )
    slim = rows.select(f"{name}.*")
    salts = buckets_for(slim)

    def salt_of(h: Column) -> Column:  # ascending with the hash
        return F.floor(F.conv(F.substring(h, 1, 4), 16, 10).cast("long") * salts / 65536)

    salt = salt_of(F.col("h"))
    sums = cut(slim.groupBy("source", salt.alias("salt")).agg(F.sum("size").alias("n")))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **options)
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("__source"), F.col("salt").alias("__salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    starts = starts.join(goals, F.col("__source").eqNullSafe(F.col("source"))).select(
        "__source", "__salt", F.struct("start", "source_size", "target", "first", "last").alias("__goal")
    )
    starts = cut(starts)
    columns = docs.columns
    data = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row") if columns else F.lit(1).alias("row"),
        F.col(f"{name}.source").alias("s"),
        salt_of(F.col(f"{name}.h")).alias("k"),
        F.col(f"{name}.h").alias("h"),
        F.col(f"{name}.size").alias("size"),
        doc_id.alias("d"),
    )
    joined = data.join(starts, (F.col("k") == F.col("__salt")) & F.col("s").eqNullSafe(F.col("__source")))
    inner = Window.partitionBy("k", "__source").orderBy("h", "d", "size").rowsBetween(Window.unboundedPreceding, 0)
    g = F.col("__goal")
    stream = F.struct(
        F.col("size").alias("size"), g["source_size"].alias("source_size"), g["target"].alias("target"),
        F.round(g["target"]).cast("long").alias("goal"),
        (g["start"] + F.sum("size").over(inner) - F.col("size")).alias("before"),
        g["first"].alias("first"), g["last"].alias("last"),
    )
    return joined.select("row", stream.alias("stream")).select("row.*", F.col("stream").alias(name))


def stream_column(docs: DataFrame) -> str:
    return fresh(docs, "stream")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position), a row for every row
    of ``docs``, range-sorted by position.

    ``size`` is the number of words, 0 for a null text. ``taken`` is how many of its words
    the mix takes, repeats counted; a source's taken words add up to its target, rounded,
    so the last document of a source may be taken in part, and none more than twice.
    ``position`` is that of its first word, null where nothing is taken; those rows come
    last. A null source is a source like another. Rows that repeat are documents of their
    own. Reruns agree, and other columns are not looked at. An empty table gives an empty
    result.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = streams(slim, **options)
    s = F.col(stream_column(slim))
    taken = F.lit(0).cast("long")
    for turn in (0, 1):
        taken += F.greatest(F.lit(0), F.least(s["size"], s["goal"] - turn * s["source_size"] - s["before"]))
    out = rows.select(
        "doc_id", "source", s["size"].alias("size"), s["source_size"].alias("source_size"),
        F.coalesce(s["target"], F.lit(0.0)).alias("target"), taken.alias("taken"),
        positions(s["before"].cast("double"), s["target"], s["first"], s["last"]).alias("position"),
        (1.0 + F.coalesce(s["before"] / s["source_size"], F.lit(1.0))).alias("__late"),
    )
    out = out.withColumn("position", F.when(F.col("taken") > 0, F.col("position")))
    return cut(out).orderBy(F.coalesce("position", "__late")).drop("__late")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix trains on them: whole documents, once, twice or not
    at all, range-sorted by position. A turn of a document is in where at least half of it
    lies before its source's target; documents without a word are in once where their
    source is asked for at all."""
    name = stream_column(docs)
    rows = streams(docs, **options)
    s = F.col(name)
    turns = []
    for turn in (0, 1):
        at = s["before"] + turn * s["source_size"]
        inside = F.when(s["size"] > 0, 2 * at + s["size"] <= 2 * s["goal"]).otherwise((at <= s["goal"]) & (s["goal"] > 0) & F.lit(turn == 0))
        turns.append(F.when(inside, positions(at.cast("double"), s["target"], s["first"], s["last"])))
    return (
        rows.withColumn(name, F.explode(F.array_compact(F.array(*turns))))
        .repartitionByRange(F.col(name))
        .sortWithinPartitions(name)
        .drop(name)
    )
