"""Near-duplicate classes by min-max hashing.

Every permutation of a document's shingle set gives two signature values, its minimum and
its maximum, so a signature of ``2 * permutations`` values costs half the hash
evaluations of plain MinHash. Bands of ``rows`` values are bucket keys.

* Documents of equal sets are one group at once, by a 128-bit sum over the set.
* In every bucket the smallest group is the leader; each other member is paired with it.
  Pairs are confirmed on the full sets, and the confirmed links give first components.
* Where buckets that still hold several components would take many comparisons, a member
  of the largest one, another at each of ``ROUNDS`` rounds, leads those outside of it. So a
  large group whose first leader isn't one of it becomes a component after all, by
  comparisons in proportion to its size.
* Only where a bucket holds several components then are members outside its largest one
  held against its members of other components, in bounded blocks that give out one link
  for each component that a member joins. Pairs within a component can't change the
  result, so no link is lost and no group is expanded into all its pairs.

Rows of one key (a bucket, a leader, a group of copies) are joined with that key's one row
by ``with_one``, which doesn't deal out hot keys by shuffling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm import textbuf
from sievemill.llm.common import cut

PERMUTATIONS, ROWS = 72, 6
#: Rounds of new leaders before members are held against each other, and the comparisons a
#: member that are not worth a round.
ROUNDS, FEW = 2, 500
#: Rows of a key that make it hot, and the most bytes of hot keys' rows that are broadcast.
HOT, BROADCAST = 100_000, 64 << 20
_U64 = np.uint64


def shingle_sets(batch: pa.RecordBatch, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, ordered by both."""
    words = textbuf.Words(textbuf.of(batch, column))
    h = words.hashes(lower=True)
    row, value = textbuf.windows(words, h, k)
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        acc = textbuf.mix(words.counts[few].astype(_U64), 99)
        for j in range(k - 1):
            has = words.counts[few] > j
            at = np.minimum(words.first[few] + j, len(h) - 1)
            with np.errstate(over="ignore"):
                acc = np.where(has, textbuf.mix(acc * _U64(0x9FB21C651E98DF25) + h[at], 101 + j), acc)
        row, value = np.concatenate([row, few]), np.concatenate([value, acc])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U64).view(np.int64)


def signatures(permutations: int, rows: int, k: int):
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 2**63, permutations, dtype=_U64) * _U64(2) + _U64(1)
    plus = rng.integers(0, 2**63, permutations, dtype=_U64)
    bands = 2 * permutations // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                row, value = shingle_sets(part, "text", k)
                n = part.num_rows
                size = np.bincount(row, minlength=n).astype(np.int64)
                full = np.flatnonzero(size)
                at = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64)
                key = np.zeros((2, n), _U64)
                sig = np.zeros((len(full), 2 * permutations), _U64)
                if len(full):
                    with np.errstate(over="ignore"):
                        key[0, full] = np.add.reduceat(textbuf.mix(value, 201), at)
                        key[1, full] = np.add.reduceat(textbuf.mix(value, 202), at)
                        for p in range(permutations):
                            seen = value * mult[p] + plus[p]
                            sig[:, 2 * p] = np.minimum.reduceat(seen, at)
                            sig[:, 2 * p + 1] = np.maximum.reduceat(seen, at)
                        sig = textbuf.mix(sig, 7)
                        acc = np.broadcast_to(textbuf.mix(np.arange(bands, dtype=_U64), 31), (len(full), bands))
                        for j in range(rows):
                            acc = textbuf.mix(acc * _U64(0x9FB21C651E98DF25) + sig[:, j : bands * rows : rows], 40 + j)
                else:
                    acc = np.zeros((0, bands), _U64)
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(size),
                        pa.array(_signed(key[0])),
                        pa.array(_signed(key[1])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.ascontiguousarray(acc).ravel()))),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def sets_of(k: int):
    """mapInArrow: (gid, set): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                row, value = shingle_sets(part, "text", k)
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[1:] = 8 * np.cumsum(np.bincount(row, minlength=part.num_rows))
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([part.column(0), data], ["gid", "set"])

    return run


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(a.as_buffer(), _U64)
                y = np.frombuffer(b.as_buffer(), _U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def with_one(left: DataFrame, right: DataFrame, on: list[str], most: int, how: str = "inner") -> DataFrame:
    """``left`` joined with the one row that ``right`` has for a key.

    The column ``c`` of ``right`` tells how many rows of ``left`` have the key, and none is
    over ``most``. The few keys of more than ``HOT`` rows are broadcast, if they are of
    ``BROADCAST`` bytes at most; only others are shuffled, so no task gets all rows of a hot
    key. Above that there are so many hot keys that a shuffle spreads them.
    """
    if most <= HOT:
        return left.join(right.drop("c"), on, how)
    right = cut(right)
    hot = right.filter(F.col("c") > HOT)
    n = hot.count()
    if not n or 32 * len(right.columns) * n > BROADCAST:
        return left.join(right.drop("c"), on, how)
    keys = F.broadcast(hot.select(*on))
    rest = left.join(keys, on, "left_anti").join(right.filter(F.col("c") <= HOT).drop("c"), on, how)
    return left.join(F.broadcast(hot.drop("c")), on).select(rest.columns).unionByName(rest)


def _most(df: DataFrame) -> int:
    return df.agg(F.max("c")).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) rows, a < b.

    Alternating large-star and small-star steps; each step is written to the shared folder.
    Rows of a step are at most twice the links; a node's links are reduced by partial
    aggregates, then joined by ``with_one``, so a hot node isn't gathered in one task.
    """
    now = cut(edges.select("a", "b").distinct())

    def marks(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    mark = marks(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
        # large star: neighbours above a node hang on its smallest neighbour
        large = cut(with_one(both.filter("b > a"), low, ["a"], mark[0]).select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # small star: neighbours below a node, and itself, hang on the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("c"))
        joined = with_one(large, least, ["b"], mark[0])
        nxt = cut(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(joined.select(F.col("m").alias("a"), "b"))
            .filter("a < b")
            .distinct()
        )
        new = marks(nxt)
        now = nxt
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for every row of ``docs``.

    Links join documents whose sets of distinct ``k``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100 (A-Z lower-cased). Texts of fewer than ``k``
    words have one shingle, the whole sequence; null or wordless texts have none, link
    with nothing and are their own component. Repeated rows of an id give equal rows. A
    row without an id takes the component of an equal set, else null; it is kept if it
    has none. An id that stands before several texts has all their links. An empty table
    gives an empty result. Very long texts are worked on alone and whole. Other columns are
    not looked at.
    """
    return classes(docs, k, percent, **options).drop("text_hash")


def unique(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those of its smallest id. Of rows
    that repeat an id and text, or a text without an id, one stays. A row without an id
    goes if its set of shingles equals that of a row with one. Null, empty and wordless
    texts link with nothing, so they stay. Very long texts are worked on alone and whole. An
    empty table gives an empty one. All columns come back, whatever their names."""
    kept = classes(docs, k, percent, **options).filter("kept").select("doc_id", "text_hash").distinct()
    text = F.col("text").cast("string")
    there = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("i"),
        F.xxhash64(text).alias("h"),
    )
    found = there.join(kept, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi")
    return found.dropDuplicates(["i", "h"]).select("row.*")


def classes(docs: DataFrame, k: int, percent: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` and a hash of the text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(
        source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
            signatures(permutations, rows, k),
            "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>",
        )
    )
    groups = (
        sig.filter("n_shingles > 0")
        .groupBy("n_shingles", "k1", "k2")
        .agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "bands"))).alias("s"), F.count("*").alias("c"))
        .filter("s is not null")
        .select("n_shingles", "k1", "k2", "c", F.col("s.doc_id").alias("gid"), F.col("s.bands").alias("bands"))
    )
    groups = cut(groups)
    members = groups.select("gid", "n_shingles", F.explode("bands").alias("bk"))
    leaders = cut(
        members.groupBy("bk").agg(F.min(F.struct("gid", "n_shingles")).alias("l"), F.count("*").alias("c")).filter("c > 1")
    )
    most = _most(leaders)
    shared = cut(with_one(members, leaders, ["bk"], most).select("bk", "gid", "n_shingles", F.col("l.gid").alias("lead"), F.col("l.n_shingles").alias("n_lead")))
    sets = sets_for(source, shared.select(F.col("gid").alias("doc_id")), k)
    pairs = led(shared, percent)
    links = cut(confirmed(sets, pairs, percent))
    parts = cut(components(links))
    at = with_components(shared, parts)
    for turn in range(ROUNDS + 1):
        open_ = unsettled(at, turn, most)
        # buckets of the same first member and component are mostly of the same members
        key = F.xxhash64("first", "main").alias("lead")
        dealt = cut(open_.select(key, "gid", "n_shingles", "comp", "main").distinct())
        lost = F.sum((F.col("comp") != F.col("main")).cast("long")).alias("lost")
        work = dealt.groupBy("lead").agg(F.count("*").alias("n"), lost).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("lost")).alias("pairs")).first()
        if turn == ROUNDS or (work["pairs"] or 0) <= FEW * (work["n"] or 0):
            break
        new = cut(confirmed(sets, led(open_.filter("comp <> main"), percent), percent))
        if not new.isEmpty():
            parts = cut(components(new.unionByName(as_links(parts))))
            at = with_components(shared, parts)
    more = cut(block_links(sets, dealt, percent))
    final = parts if more.isEmpty() else components(more.unionByName(as_links(parts)))
    final = groups.select("n_shingles", "k1", "k2", "gid", "c").join(final, F.col("gid") == F.col("node"), "left").select(
        "n_shingles", "k1", "k2", "c", F.coalesce("component", "gid").alias("component_id")
    )
    rows = sig.select("doc_id", "text_hash", "n_shingles", "k1", "k2")
    out = with_one(rows.filter("n_shingles > 0"), final, ["n_shingles", "k1", "k2"], _most(groups), "left").select(
        "doc_id", "text_hash", "n_shingles", "component_id"
    )
    wordless = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def led(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): leaders and members of rows (gid, n_shingles, lead, n_lead) where the sizes of
    their sets allow a link."""
    least, most = F.least("n_shingles", "n_lead"), F.greatest("n_shingles", "n_lead")
    some = members.filter((F.col("gid") != F.col("lead")) & (100 * least >= percent * most))
    return cut(some.select(F.col("lead").alias("a"), F.col("gid").alias("b")).distinct())


def as_links(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("component").alias("a"), F.col("node").alias("b"))


def with_components(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(bk, gid, n_shingles, first, comp): ``first`` is the bucket's smallest member."""
    at = shared.join(parts, shared.gid == parts.node, "left")
    return cut(at.select("bk", "gid", "n_shingles", F.col("lead").alias("first"), F.coalesce("component", "gid").alias("comp")))


def unsettled(at: DataFrame, turn: int, most: int) -> DataFrame:
    """Rows of the buckets with several components, with the largest one, ``main``, and a
    leader of it, another one at each ``turn``. No bucket has over ``most`` rows."""
    mixed = at.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo <> hi")
    open_ = cut(with_one(at, mixed.select("bk", "c"), ["bk"], most))
    of = F.min(F.struct(F.xxhash64("gid", F.lit(turn)).alias("h"), "gid", "n_shingles")).alias("l")
    sizes = open_.groupBy("bk", "comp").agg(F.count("*").alias("n"), of)
    main = sizes.groupBy("bk").agg(F.max(F.struct("n", (-F.col("comp")).alias("z"), "comp", "l")).alias("m"), F.sum("n").alias("c"))
    main = main.select("bk", "c", F.col("m.comp").alias("main"), F.col("m.l.gid").alias("lead"), F.col("m.l.n_shingles").alias("n_lead"))
    return cut(with_one(open_, main, ["bk"], most))


def sets_for(source: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(gid, set) of the documents named in ``ids`` (doc_id)."""
    # an id that stands before several texts has several sets, and all their links
    texts = source.filter("doc_id is not null").join(ids.distinct(), "doc_id", "left_semi")
    return cut(texts.select("doc_id", "text").mapInArrow(sets_of(k), "gid long, set binary"))


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), the smaller id as ``a``, whose full sets are similar enough."""
    with_b = sets.select(F.col("gid").alias("b"), F.col("set").alias("sb"))
    with_a = sets.select(F.col("gid").alias("a"), F.col("set").alias("sa"))
    hot = None
    if pairs.count() > HOT:
        hot = cut(pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("a"))
        hot = cut(with_a.join(hot, "a", "left_semi")) if not hot.isEmpty() else None
    if hot is not None and hot.agg(F.sum(F.length("sa") + 32)).first()[0] <= BROADCAST:
        # leaders of very many pairs are not shuffled to one task each
        cold = pairs.join(F.broadcast(hot.select("a").distinct()), "a", "left_anti").join(with_a, "a")
        both = cold.unionByName(pairs.join(F.broadcast(hot), "a")).join(with_b, "b")
    else:
        both = pairs.join(with_a, "a").join(with_b, "b")
    found = both.select("a", "b", "sa", "sb").mapInArrow(_overlaps(percent), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Documents and shingles of one side of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 500_000


def block_links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components which a link of two of a lead's members joins.

    ``groups`` has (lead, gid, n_shingles, comp, main). A lead's stragglers, those outside
    its largest component ``main``, are held against all the lead's members of other
    components, block against block: members and stragglers are dealt into chunks of
    bounded size, and a task sees one chunk of each. Only members of components that aren't
    joined yet and that share one of a straggler's rarest shingles, as many as a similar
    set can't all miss, are compared in full. A block gives out at most one link fewer than
    it has components, never the compared pairs.
    """
    lost = F.col("comp") != F.col("main")
    sizes = cut(
        groups.groupBy("lead").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("ni"),
            F.greatest(
                F.ceil(F.sum(lost.cast("long")) / BLOCK_DOCS),
                F.ceil(F.sum(F.when(lost, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES),
            ).alias("nj"),
        )
    )
    dealt = groups.join(sizes, "lead")
    member = dealt.select(
        "lead", "gid", "comp", F.pmod(F.xxhash64("gid"), "ni").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"), F.lit(0).alias("role"),
    )
    straggler = dealt.filter(lost).select(
        "lead", "gid", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"),
        F.pmod(F.xxhash64("gid"), "nj").alias("j"), F.lit(1).alias("role"),
    )
    rows = (
        member.unionByName(straggler)
        .join(sets, "gid")
        .select("lead", "i", "j", "role", "gid", "comp", "set")
        .repartition("lead", "i", "j")
        .sortWithinPartitions("lead", "i", "j", "role")
    )
    return rows.mapInArrow(_block_links(percent), "a long, b long").distinct()


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] of them, then those of the next."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _block_links(percent: int):
    def links(block: list[tuple]) -> tuple[list[int], list[int]]:
        members = [r for r in block if r[3] == 0]
        if not members:
            return [], []
        sets = [np.frombuffer(r[6].as_buffer(), _U64) for r in members]
        size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sets)), size)[order]
        comp = np.array([r[5] for r in members])
        gid = np.array([r[4] for r in members])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (above := up.get(c, c)) != c:
                up[c] = up.get(above, above)
                c = above
            return c

        a: list[int] = []
        b: list[int] = []
        for r in block:
            if r[3] == 0:
                continue
            x = np.frombuffer(r[6].as_buffer(), _U64)
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            # a set that is similar enough has one of the rarest shingles, as many as this
            rare = np.argsort(hi - lo, kind="stable")[: len(x) - (percent * len(x) + 99) // 100 + 1]
            own = root(r[5])
            near = np.unique(owner[_spread(lo[rare], hi[rare] - lo[rare])])
            near = near[[root(c) != own for c in comp[near].tolist()]] if len(near) else near
            if not len(near):
                continue
            both = np.bincount(owner[_spread(lo, hi - lo)], minlength=len(sets))[near]
            near = near[100 * both >= percent * (size[near] + len(x) - both)]
            for c, k in zip(*(z.tolist() for z in np.unique(comp[near], return_index=True)), strict=True):
                if root(c) != root(r[5]):  # one link for each component that is joined
                    up[root(c)] = root(r[5])
                    other = int(gid[near[k]])
                    a.append(min(other, r[4]))
                    b.append(max(other, r[4]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for r in zip(*cols, batch.column(6), strict=True):
                if r[:3] != key:
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links(block)], ["a", "b"])
                    key, block = r[:3], []
                block.append(r)
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links(block)], ["a", "b"])

    return run
