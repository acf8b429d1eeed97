"""Set operations on half-open intervals [start, end) that carry a group (a contig)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, group: str, width: int) -> DataFrame:
    """Pairs of rows of the same group whose intervals share a position.

    Both sides have ``group``, ``start`` and ``end``; other columns must have different
    names. Right columns of these names come out as ``right_start`` and ``right_end``. Rows
    are dealt into bins of ``width`` and joined by group and bin, so a hot group is split;
    a pair that meets in several bins is kept in the one where the later of the two
    starts. Empty or null intervals and null groups match nothing; repeated rows match each;
    an empty side gives an empty result. Choose ``width`` near the usual length.
    """
    def real(df: DataFrame) -> DataFrame:
        return df.filter((F.col("start") < F.col("end")) & F.col(group).isNotNull())

    own = _fresh([*left.columns, *right.columns], "__bin")
    a = real(left).withColumn(own, _bins(F.col("start"), F.col("end"), width))
    b = real(right).withColumnsRenamed({"start": "right_start", "end": "right_end"})
    b = b.withColumn(own, _bins(F.col("right_start"), F.col("right_end"), width))
    home = F.floor(F.greatest("start", "right_start") / width)
    shared = (F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end"))
    return a.join(b, [group, own]).filter(shared & (F.col(own) == home)).drop(own)


#: Positions of a bin in which running values are computed by one task.
BIN = 1 << 20


def _fresh(columns: list[str], name: str) -> str:
    """``name`` with underscores before it until it is none of ``columns``."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def _real(df: DataFrame, group: str) -> DataFrame:
    """(g, start, end) of the intervals that aren't empty or null."""
    return df.filter(F.col("start") < F.col("end")).select(F.col(f"`{group}`").alias("g"), "start", "end")


def overlap_totals(left: DataFrame, right: DataFrame, group: str, width: int = 1 << 16) -> DataFrame:
    """``right`` rows that meet a ``left`` row of their group, with ``n`` and ``shared``: how
    many left rows they meet, and the positions shared with each of them, added up.

    These are the sums over ``overlap_join``, but no pair is made, so the work grows with the
    rows of both sides and not with their product; where few pairs meet, adding them up takes
    less time. A region meets the rows that start before
    its end, less those that end by its start; it shares the bases up to its end, less those
    up to its start. The three are running values over distinct positions, within bins of
    ``width`` and over the bins, of which a group has few, so a large group is spread over
    tasks. Positions are integers. A right row without length meets the left rows that reach
    across it and shares 0; left rows without length, intervals that end before they start
    or are null and null groups meet nothing; repeated rows count each; an empty side gives
    an empty result. Columns ``n`` and ``shared`` of ``right`` are replaced.
    """
    def points(df: DataFrame, opened: int, closed: int) -> DataFrame:
        point = lambda at, o, c: F.struct(F.col(at).alias("at"), F.lit(o).cast("long").alias("opened"), F.lit(c).cast("long").alias("closed"))
        each = F.explode(F.array(point("start", opened, 0), point("end", 0, closed))).alias("p")
        return df.select(F.col(f"`{group}`").alias("g"), each).select("g", "p.*")

    there = F.col(f"`{group}`").isNotNull()
    regions = right.filter(there & (F.col("start") <= F.col("end"))).drop("n", "shared")
    at = points(left.filter(there & (F.col("start") < F.col("end"))), 1, 1).unionByName(points(regions, 0, 0))
    at = at.groupBy("g", "at").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    # nulls are left out here, lest each join below does so in its own way and nothing is shared
    at = at.withColumn("bin", F.floor(F.col("at") / width)).filter("g is not null and at is not null and bin is not null")
    at = at.withColumn("offset", F.col("at") - F.col("bin") * width)
    moment = (F.col("opened") - F.col("closed")) * F.col("offset")

    by_bin = Window.partitionBy("g2").orderBy("bin2")
    earlier = lambda c: F.coalesce(F.sum(c).over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = at.groupBy(F.col("g").alias("g2"), F.col("bin").alias("bin2")).agg(F.sum("opened").alias("o"), F.sum("closed").alias("c"), F.sum(moment).alias("m"))
    bins = bins.select("g2", "bin2", "o", "c", "m", earlier("o").alias("o_before"), earlier("c").alias("c_before"), (F.lead("bin2").over(by_bin) - F.col("bin2")).alias("step"))
    # bases from the bin's first position to that of the next bin that has points
    bins = bins.withColumn("bases", (F.col("o_before") + F.col("o") - F.col("c_before") - F.col("c")) * F.col("step") * width - F.col("m"))
    bins = bins.select("g2", "bin2", "o_before", "c_before", earlier("bases").alias("bases_before"))

    order = Window.partitionBy("g", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = at.select("g", "bin", "at", "offset", "opened", F.sum("opened").over(order).alias("o"), F.sum("closed").over(order).alias("c"), F.sum(moment).over(order).alias("m"))
    run = run.join(bins, (F.col("g") == F.col("g2")) & (F.col("bin") == F.col("bin2")))
    o, c = F.col("o_before") + F.col("o"), F.col("c_before") + F.col("c")
    # one array, so that both joins read the same columns and share what lies below them
    run = run.select("g", "at", F.array(o - F.col("opened"), c, F.col("bases_before") + (o - c) * F.col("offset") - F.col("m")).alias("v"))

    names = [[_fresh(right.columns, f"__{x}_{side}") for x in ("g", "at", "v")] for side in ("start", "end")]
    out = regions
    for side, (g, at_, v) in zip(("start", "end"), names, strict=True):
        found = run.select(F.col("g").alias(g), F.col("at").alias(at_), F.col("v").alias(v))
        out = out.join(found, (F.col(f"`{group}`") == F.col(g)) & (F.col(side) == F.col(at_)))
    first, last = (F.col(v) for _, _, v in names)
    kept = [F.col(f"`{x}`") for x in regions.columns]
    return out.select(*kept, (last[0] - first[1]).alias("n"), (last[2] - first[2]).alias("shared")).filter("n > 0")


def merged(df: DataFrame, group: str, width: int = BIN) -> DataFrame:
    """(group, start, end, n): intervals of a group that overlap or touch, as one.

    A null group is a group of its own; empty and null intervals are left out, repeated ones
    count each; an empty table gives an empty result; other columns are not looked at. What
    earlier intervals reach is a running maximum within bins of ``width`` and over the bins,
    of which a group has few, so a large group is spread over tasks.
    """
    rows = _real(df, group).withColumn("bin", F.floor(F.col("start") / width))
    by_bin = Window.partitionBy("g").orderBy("bin")
    before = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("g", "bin").agg(F.max("end").alias("most")).withColumn("carry", F.max("most").over(before)).drop("most")
    # a carried row stands before its bin's intervals
    first = F.lit(None).cast(rows.schema["start"].dataType)
    marks = carried.select("g", "bin", first.alias("start"), F.col("carry").cast(rows.schema["end"].dataType).alias("end"))
    order = Window.partitionBy("g", "bin").orderBy(F.col("start").asc_nulls_first(), "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("g", "bin", "start", "end").unionByName(marks).withColumn("reach", reach).filter("start is not null")
    opens = (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long")
    rows = rows.withColumn("opens", opens)
    earlier = rows.groupBy("g", "bin").agg(F.sum("opens").alias("n")).withColumn("islands", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("g").eqNullSafe(F.col("g2")) & (F.col("bin") == F.col("bin2"))
    numbered = rows.withColumn("inner", inner).join(earlier.withColumnsRenamed({"g": "g2", "bin": "bin2"}), same)
    islands = numbered.groupBy("g", (F.col("islands") + F.col("inner")).alias("island")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")
    )
    return islands.select(F.col("g").alias(group), "start", "end", "n")


def depth(df: DataFrame, group: str, width: int = BIN) -> DataFrame:
    """(group, start, end, depth): maximal stretches of equal, positive depth.

    Null groups, empty and null intervals, repeated rows, empty tables and other columns are
    as in ``merged``. Starts and ends are counted by position first, so the running sum is
    over positions, however deep they are; it runs within bins of ``width`` and over the
    bins, so a large group is spread over tasks.
    """
    rows = _real(df, group)
    step = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).cast("long").alias("d"))
    steps = rows.select("g", F.explode(F.array(step("start", 1), step("end", -1))).alias("s"))
    steps = steps.groupBy("g", F.col("s.at").alias("start")).agg(F.sum("s.d").alias("d")).filter("d <> 0")
    steps = steps.withColumn("bin", F.floor(F.col("start") / width))
    by_bin = Window.partitionBy("g2").orderBy("bin2")
    bins = steps.groupBy(F.col("g").alias("g2"), F.col("bin").alias("bin2")).agg(F.sum("d").alias("all"), F.min("start").alias("first"))
    carried = bins.select(
        "g2", "bin2", F.coalesce(F.sum("all").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"),
        F.lead("first").over(by_bin).alias("next"),
    )
    order = Window.partitionBy("g", "bin").orderBy("start")
    inner = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = steps.withColumn("inner", inner).withColumn("then", F.lead("start").over(order))
    same = F.col("g").eqNullSafe(F.col("g2")) & (F.col("bin") == F.col("bin2"))
    out = run.join(carried, same).select(
        F.col("g").alias(group), "start", F.coalesce("then", "next").alias("end"), (F.col("inner") + F.col("carry")).alias("depth")
    )
    return out.filter("depth > 0")
