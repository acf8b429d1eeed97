"""Packing of token sequences by linear grouping.

The plan is made from the histogram of piece lengths alone, which has at most
``capacity`` entries however many documents there are:

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up
   to the largest of its group, so few sizes remain.
2. Over those sizes configurations (multisets that fit into a sequence) are chosen one
   after the other: each holds the largest size that is left, is filled best by a bounded
   knapsack over the others, and is used as often as the counts allow.
3. Actual pieces take the slots of their group, in order of length.
4. Small pieces go, longest first, where they leave the least room.

All steps work on runs of equal sequences. A piece finds its place by its rank among the
pieces of its length; ranks are counted per salted bucket and offset by a prefix sum, so
no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm import textbuf
from sievemill.llm.common import buckets_for, cut
from sievemill.llm.tokens import encoder

CAPACITY, GROUPS, SMALL = 2048, 400, 8


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) of each group, longest first, groups of equal cardinality."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = each
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            n = min(left, room)
            out[-1].append((length, n))
            left -= n
            room -= n
    return [g for g in out if g]


def _fill(sizes: list[int], counts: list[int], room: int, first: int) -> list[int]:
    """How many of each size, ``first`` on, fill ``room`` best; at most ``counts``."""
    reach = np.full(room + 1, -1, np.int64)  # the size that last reached this sum
    took = np.zeros(room + 1, np.int64)
    reach[0] = len(sizes)
    for i in range(first, len(sizes)):
        s = sizes[i]
        if not counts[i] or s > room:
            continue
        took[:] = 0
        for sum_ in range(s, room + 1):
            if reach[sum_] < 0 and reach[sum_ - s] >= 0 and took[sum_ - s] < counts[i]:
                reach[sum_] = i
                took[sum_] = took[sum_ - s] + 1
        if reach[room] >= 0:
            break
    best = int(np.flatnonzero(reach >= 0)[-1])
    out = [0] * len(sizes)
    while best:
        i = int(reach[best])
        out[i] += 1
        best -= sizes[i]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, how many of each size) until nothing is left."""
    left, out = list(counts), []
    for i in range(len(sizes)):
        while left[i]:
            left[i] -= 1
            use = _fill(sizes, left, capacity - sizes[i], i)
            left[i] += 1
            use[i] += 1
            times = min(left[j] // n for j, n in enumerate(use) if n)
            left = [a - times * n for a, n in zip(left, use, strict=True)]
            out.append((times, use))
    return out


class _Open:
    """Runs of equal sequences by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, first: int, n: int, room: int) -> None:
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((first, n))

    def take(self, length: int, n: int) -> tuple[int, int, int] | None:
        """(first sequence, how many, offset): the least room of ``length`` or more."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, have = self.runs[room].pop()
        n = min(n, have)
        if n < have:
            self.runs[room].append((first + n, have - n))
        if not self.runs[room]:
            del self.runs[room], self.rooms[at]
        self.add(first, n, room - length)
        return first, n, self.capacity - room


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered: pieces of a length from
    that rank on go to the sequences from that one on, one each, at that offset."""
    rows: list[tuple[int, int, int, int]] = []
    rank = dict.fromkeys(counts, 0)
    bins, open_ = 0, _Open(capacity)

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], first, offset))
        rank[length] += n

    if full := counts.get(capacity, 0):
        put(capacity, full, 0, 0)
        bins = full
    large = {k: n for k, n in counts.items() if capacity // small < k < capacity}
    sets = linear_groups(large, groups)
    sizes, sums = [g[0][0] for g in sets], [sum(n for _, n in g) for g in sets]
    queues = [list(reversed(g)) for g in sets]
    for times, use in configurations(sizes, sums, capacity):
        slots = [i for i, n in enumerate(use) for _ in range(n)]
        taken: list[list[tuple[int, int]]] = []
        for i in slots:
            need, got = times, []
            while need:
                length, have = queues[i].pop()
                n = min(need, have)
                got.append((length, n))
                need -= n
                if n < have:
                    queues[i].append((length, have - n))
            taken.append(got)
        at = [0] * len(slots)
        used = [0] * len(slots)
        done = 0
        while done < times:
            n = min(got[a][1] - u for got, a, u in zip(taken, at, used, strict=True))
            offset = 0
            for s, got in enumerate(taken):
                length, have = got[at[s]]
                put(length, n, bins, offset)
                offset += length
                used[s] += n
                if used[s] == have:
                    at[s], used[s] = at[s] + 1, 0
            open_.add(bins, n, capacity - offset)
            bins += n
            done += n
    for length in sorted((k for k in counts if k <= capacity // small and k < capacity), reverse=True):
        left = counts[length]
        while left:
            got = open_.take(length, left)
            if not got:
                fresh = max(1, -(-left // (capacity // length)))
                open_.add(bins, fresh, capacity)
                bins += fresh
                continue
            first, n, offset = got
            put(length, n, first, offset)
            left -= n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).batch
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                flat, first = encode(textbuf.of(part, "text"))
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for row, (a, z) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                    ids = np.append(flat[a:z], np.uint32(end_id)).astype("<u4")
                    for k, lo in enumerate(range(0, len(ids), capacity)):
                        piece = ids[lo : lo + capacity].tobytes()
                        for c, v in zip(out, (row, k, lo, len(piece) // 4, zlib.crc32(piece), piece), strict=True):
                            c.append(v)
                cols = [part.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32())]
                cols += [pa.array(c, pa.int64()) for c in out[2:5]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _placed(shared, columns: list[str]):
    """Adds sequence_id and offset to rows with a length and a rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        span = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0].astype(object) * span + rows[:, 1] if span > 2**50 else rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (get[c].to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            found = rows[at]
            yield pa.RecordBatch.from_arrays(
                [get[c] for c in columns] + [pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                [*columns, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    groups: int = GROUPS,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row for
    every piece of every row of ``docs``.

    A text's ids end with ``end_id``; only more than ``capacity`` ids are cut, into pieces
    of ``capacity`` but the last. Null or empty texts are the end id alone. Rows that
    repeat, or have no id, are packed as rows of their own. An empty table gives an empty
    result. Other columns are not looked at. ``tokenizer`` is the vocabulary's path.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = cut(source.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kind))
    names = pieces.columns
    salts = buckets_for(pieces)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = cut(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(starts, ["length", "__salt"]).withColumn(
        "__rank", F.col("__start") + F.row_number().over(inner) - 1
    )
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity, groups))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "__rank").mapInArrow(_placed(shared, names), schema)
