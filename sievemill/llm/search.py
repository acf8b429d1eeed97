"""Exact top-k BM25 search: an inverted index in shards with block-max WAND pruning.

The indexing job writes shards of about ``POSTINGS`` postings. Within a shard documents are
ordered by cluster and length and cut into blocks, so that documents that use the same
words are in few blocks. Document frequencies are summed over the shards, so scores are
global; bounds are made of the impacts, once the average length is known.

Queries are written to files of about ``CHUNK`` queries, and every chunk is held against
every shard: first against the few largest ones, which gives each query a score that its
k-th best reaches for sure, then a task takes some chunks through a group of the other
shards, shard by shard, and carries each query's best along. In a shard the bounds of a
query's terms are added up by spans of a block, and a query visits blocks in descending
order of bounds, and only those that can still reach its k-th best score so far, which is
exact. In a block short documents are bounded in groups; terms that many of its groups have
are multiplied as a matrix of impacts, others are added up from their postings. What the
tasks found is merged by one ranking for each query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm import spans as sp
from sievemill.llm import textbuf
from sievemill.llm.common import cut, shared_dir
from sievemill.llm.token_files import filesystem, settle

K1, B = 1.2, 0.75
#: Most groups of documents of a block, most clusters of a shard, and the terms they are told
#: by (fewer where documents are many); documents less alike to every cluster's centre are
#: kept apart.
BLOCK, CLUSTERS, CLUSTER_TERMS, ALIKE = 1024, 8, 512, 0.4
#: Words of a group of documents that are bounded together, about, and its most documents.
TOGETHER, MOST_TOGETHER = 400, 4
#: Groups of a span, for which bounds are added up first, and most spans of a shard, about.
SPAN, SPANS = 96, 512
#: The product of its shares of the block's groups and of the shard's documents that makes a
#: term frequent in a block: there its impacts are multiplied as a matrix.
FREQUENT = 0.002
#: Queries that are scored at once; queries and their terms in a chunk, about.
TILE, CHUNK, CHUNK_TERMS = 512, 8000, 3_000_000
#: Least and most shards that are searched before the others; most chunks and shards that a
#: task takes, and how many shards it takes at least, even if there are fewer tasks than cores.
AHEAD, MOST_AHEAD, CHUNKS, GROUP, LEAST_GROUP = 2, 8, 4, 48, 6
#: Postings of a shard, about: what a task holds in memory.
POSTINGS = 4_000_000
_U64 = np.uint64
_TERM = sp.byte_class(sp.DIGITS + sp.UPPER + sp.LOWER)
_TERM[0x80:] = True


def terms(texts: textbuf.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term: a run of ASCII letters and digits (A-Z lower-cased) and
    of characters outside of ASCII."""
    start, end = sp.runs(_TERM[texts.bytes], texts.offsets)
    h = textbuf.segment_hashes(textbuf._LOWER[texts.bytes], start, end)
    return np.searchsorted(texts.offsets, start, "right") - 1, h


def _counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency), by row and term."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(~textbuf.equal_to_last(row, h))
    return row[new], h[new], np.diff(np.append(new, len(h)))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] of them, then those of the next."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _impact(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1.0) / (tf + K1 * (1 - B + B * length / average))


class Shard:
    """Arrays of one shard. Documents stand in blocks (``starts``, one more than blocks), and
    within them in groups (``groups``, one more than groups, where each begins).
    A term's entries are the blocks that have it: ``entry_at`` begins a term's entries and
    ``posting_at`` an entry's postings, each with one element more. ``doc`` counts from its
    block's start."""

    NAMES = ("ids", "lengths", "starts", "groups", "terms", "entry_at", "block", "posting_at", "doc", "tf")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.NAMES, arrays, strict=True):
            setattr(self, name, a)

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Shard:
        """``doc``: positions in ``ids``."""
        terms_, place = np.unique(term, return_inverse=True)
        cluster = _clusters(len(ids), len(terms_), doc, place, tf)
        like = np.bincount(doc, weights=(place * 2_654_435_761 % 65_521 * tf), minlength=len(ids))  # copies stand together
        order = np.lexsort((ids, like, lengths, cluster))
        filled = np.floor(np.cumsum(np.clip(lengths[order] / TOGETHER, 1 / MOST_TOGETHER, 1)))
        groups = np.flatnonzero(~textbuf.equal_to_last(cluster[order], filled))
        sizes = np.bincount(cluster[order][groups], minlength=1)
        cuts = [np.linspace(0, n, -(-n // BLOCK) + 1).astype(np.int64)[1:] + before for n, before in zip(sizes, np.cumsum(sizes) - sizes, strict=True) if n]
        groups = np.append(groups, len(ids))
        starts = groups[np.concatenate([[0], *cuts]).astype(np.int64)]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        ids, lengths, doc = ids[order], lengths[order], rank[doc]
        order = np.argsort(place * len(ids) + doc, kind="stable") if len(doc) else np.zeros(0, np.int64)
        doc, place, tf = doc[order], place[order], tf[order]
        block = np.searchsorted(starts, doc, "right") - 1
        entry = np.flatnonzero(~textbuf.equal_to_last(place, block))
        first = np.searchsorted(place[entry], np.arange(len(terms_) + 1))
        return cls(ids, lengths, starts, groups, terms_, first, block[entry], np.append(entry, len(doc)), doc - starts[block], tf)

    def save(self, out) -> None:
        _save(out, [getattr(self, n) for n in self.NAMES])

    @classmethod
    def load(cls, data: bytes, names: tuple[str, ...] = NAMES) -> Shard:
        """Only the arrays ``names``; the others are None."""
        return cls(*_load_arrays(data, [n in names for n in cls.NAMES]))


def _clusters(n: int, n_terms: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """A cluster for every document of a shard, by its most frequent terms: spherical
    k-means from seeds that are far apart. Only the speed of searches depends on it."""
    many = min(CLUSTERS, n // (BLOCK // 2))
    if many < 2 or not len(doc):
        return np.zeros(n, np.int64)
    top = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[: min(CLUSTER_TERMS, max(128, 2**24 // n))]
    column = np.full(n_terms, -1)
    column[top] = np.arange(len(top))
    at = column[term]
    x = np.zeros((n, len(top)), np.float32)
    x[doc[at >= 0], at[at >= 0]] = tf[at >= 0]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    rng = np.random.default_rng(7)
    some = x[rng.permutation(n)[: 200 * many]]
    centres = some[:1]
    for _ in range(many - 1):
        far = np.maximum(1 - (some @ centres.T).max(1), 0) ** 2
        centres = np.concatenate([centres, some[[rng.choice(len(some), p=far / far.sum()) if far.sum() else 0]]])
    for _ in range(4):
        label = (x @ centres.T).argmax(1)
        order = np.argsort(label, kind="stable")
        here, first = np.unique(label[order], return_index=True)
        centres = np.add.reduceat(x[order], first, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    near = x @ centres.T
    return np.where(near.max(1) < ALIKE, len(centres), near.argmax(1))


def _smallest(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a


def _save(out, arrays: list[np.ndarray]) -> None:
    """Each array: its kind (8 bytes), the bytes of its compressed form, that form."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    for a in arrays:
        if a.dtype.kind == "i" and len(a) and a.min() >= 0 and a.max() < 2**32:
            a = _smallest(a)
        data = press(np.ascontiguousarray(a).tobytes())
        out.write(a.dtype.str.encode().ljust(8) + len(data).to_bytes(8, "little") + data)


def _load_arrays(data: bytes, wanted: list[bool]) -> list[np.ndarray | None]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    at, out = 0, []
    for want in wanted:
        kind, size = data[at : at + 8].decode().strip(), int.from_bytes(data[at + 8 : at + 16], "little")
        at += 16
        out.append(np.frombuffer(expand(data[at : at + size]), kind) if want else None)
        at += size
    return out


class Block:
    """A block of a shard, ready to be searched: ``n`` groups of documents from ``first`` on,
    with the largest impact that each term has in a group.

    ``seat`` has, for every term of the shard, its row in ``dense`` (impacts of the terms
    that many of the block's groups have), or that number of rows and more for the
    others, -1 where the block doesn't have it. Postings of the others are ordered by their
    number: ``lists`` has for each number the first seat, the groups and the impacts,
    a row for each term.
    """

    def __init__(self, first: int, n: int, terms: int, lo: np.ndarray, count: np.ndarray, term: np.ndarray, share: np.ndarray, group: np.ndarray, impact: np.ndarray):
        """The term of an entry has ``count`` postings (group, impact), from ``lo`` on."""
        self.first, self.n = first, n
        many = (count > 1) & (count / n * share[term] >= FREQUENT)
        self.rows = int(many.sum())
        order = np.argsort(np.where(many, 0, np.minimum(count, 65_535)).astype(np.uint16), kind="stable")
        self.seat = np.full(terms, -1, np.int32)
        self.seat[term[order]] = np.arange(len(order))
        lo, count = lo[order], count[order]
        index = _spread(lo[: self.rows], count[: self.rows])
        self.dense = np.zeros((self.rows, n), np.float32)
        self.dense[np.repeat(np.arange(self.rows), count[: self.rows]), group[index]] = impact[index]
        index = _spread(lo[self.rows :], count[self.rows :])
        doc, impact = group[index].astype(np.int32), impact[index]
        self.size = count
        self.lists, at = {}, 0
        sizes, first = np.unique(count[self.rows :], return_index=True)
        for c, seat, last in zip(sizes.tolist(), first.tolist(), np.append(first[1:], len(count) - self.rows).tolist(), strict=False):
            end = at + c * (last - seat)
            self.lists[c] = self.rows + seat, doc[at:end].reshape(-1, c), impact[at:end].reshape(-1, c)
            at = end

    def scores(self, n: int, q: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of queries 0 to n - 1, which have the rows (q, at, weight), by group; in single
        precision. No document of a group scores more, and the only one of a group has this
        score."""
        seat = self.seat[at]
        common, rare = np.flatnonzero((seat >= 0) & (seat < self.rows)), np.flatnonzero(seat >= self.rows)
        used = np.zeros(self.rows, bool)
        used[seat[common]] = True
        column = np.cumsum(used) - 1
        w = np.zeros((n, int(used.sum())), np.float32)
        w[q[common], column[seat[common]]] = weight[common]
        out = w @ (self.dense if used.all() else self.dense[used])
        size = self.size[seat[rare]]
        order = np.argsort(np.minimum(size, 65_535).astype(np.uint16), kind="stable")
        rare, size = rare[order], size[order]
        first, row = (q[rare] * self.n).astype(np.int32)[:, None], seat[rare]
        key, value = np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.float32)
        start = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else size
        at = 0
        for x, y in zip(start.tolist(), np.append(start[1:], len(size)).tolist(), strict=False):
            c = int(size[x])
            seat_, docs, impacts = self.lists[c]
            here = slice(at, at + c * (y - x))
            np.take(docs, row[x:y] - seat_, axis=0, out=key[here].reshape(-1, c), mode="clip")
            np.take(impacts, row[x:y] - seat_, axis=0, out=value[here].reshape(-1, c), mode="clip")
            key[here].reshape(-1, c)[...] += first[x:y]
            value[here].reshape(-1, c)[...] *= weight[rare[x:y], None]
            at = here.stop
        np.add.at(out.reshape(-1), key, value)
        return out


class Searcher:
    """A shard, with the corpus' average length."""

    def __init__(self, shard: Shard, average: float):
        self.shard, self.average = shard, average
        counts = np.diff(shard.entry_at.astype(np.int64))
        term = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        block = shard.block.astype(np.int32)
        posts = np.diff(shard.posting_at.astype(np.int64))
        place = np.repeat(shard.starts.astype(np.int32)[block], posts) + shard.doc.astype(np.int32)
        impact = _impact(shard.tf.astype(np.float32), shard.lengths.astype(np.float32)[place], np.float32(average))
        blocks = len(shard.starts) - 1
        groups = shard.groups.astype(np.int64)
        self.groups, self.sizes = groups, np.diff(groups)
        of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[place]
        entry = np.repeat(np.arange(len(block), dtype=np.int32), posts)
        new = np.flatnonzero(~textbuf.equal_to_last(entry, of)).astype(np.int32)  # by entry and group
        lo = np.searchsorted(new, shard.posting_at.astype(np.int64))
        lo, count = lo[:-1], np.diff(lo)
        first = np.searchsorted(groups, shard.starts.astype(np.int64))
        most = np.maximum.reduceat(impact, new) if len(new) else impact
        entry = entry[new]
        group = of[new] - first.astype(np.int32)[block[entry]]
        del of
        # by term and span
        wide = max(SPAN, -(-len(self.sizes) // SPANS))
        n_spans = -(-np.diff(first) // wide)
        self.span_first = np.cumsum(n_spans) - n_spans
        span = self.span_first.astype(np.int32)[block[entry]] + group // np.int32(wide)
        start = np.flatnonzero(~textbuf.equal_to_last(term[entry], span))
        far = np.searchsorted(start, np.searchsorted(new, shard.posting_at[shard.entry_at].astype(np.int64)))
        high = np.maximum.reduceat(most, start) if len(start) else most
        span = span[start]
        del entry, new, start
        order = np.argsort(block.astype(np.uint16) if blocks < 65_536 else block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        share = np.diff(shard.posting_at[shard.entry_at].astype(np.int64)) / len(shard.ids)
        self.blocks = [
            Block(int(first[b]), int(first[b + 1] - first[b]), len(shard.terms), lo[own], count[own], term[own], share, group, most)
            for b, own in enumerate(np.split(order, cuts[1:-1]))
        ]
        self.spans = Block(0, int(n_spans.sum()), len(shard.terms), far[:-1], np.diff(far), np.arange(len(counts)), share, span, high)
        del group, most, span, high
        # by document: where its terms begin, the terms, their frequencies and impacts
        order = np.argsort(place.astype(np.uint16) if len(shard.ids) < 65_536 else place, kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(shard.ids)))])
        self.term, self.tf, self.impact = np.repeat(term, posts)[order], shard.tf[order], impact[order]
        self.weights, self.asked = np.zeros(len(counts)), np.zeros(len(counts), bool)
        self.single = np.zeros(len(counts), np.float32)

    def bounds(self, first: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """[query, block]: no document of the block scores more. Rows of a query begin at
        ``first`` (one more than queries)."""
        out = np.zeros((len(first) - 1, len(self.blocks)))
        for lo in range(0, len(out), TILE):
            own = first[lo : lo + TILE + 1]
            rows = slice(own[0], own[-1])
            q = np.repeat(np.arange(len(own) - 1), np.diff(own))
            high = self.spans.scores(len(own) - 1, q, at[rows], weight[rows].astype(np.float32))
            out[lo : lo + TILE] = np.maximum.reduceat(high, self.span_first, axis=1)
        return out * (1 + 1e-3) + 1e-5  # sums of single precision, and scores are rounded

    def exact(self, at: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents, which all have a term of the query, rounded. Equal documents
        have equal ones, as terms are added in their order."""
        self.weights[at], self.asked[at] = weight, True
        lo, hi = self.begin[docs].tolist(), self.begin[docs + 1].tolist()
        term = np.concatenate([self.term[x:y] for x, y in zip(lo, hi, strict=True)])
        tf = np.concatenate([self.tf[x:y] for x, y in zip(lo, hi, strict=True)])
        some = np.flatnonzero(self.asked[term])
        own = np.searchsorted(np.cumsum(np.subtract(hi, lo)), some, "right")
        value = self.weights[term[some]] * _impact(tf[some], self.shard.lengths[docs][own], self.average)
        self.weights[at], self.asked[at] = 0, False
        return np.round(np.add.reduceat(value, np.searchsorted(own, np.arange(len(docs)))), 6)

    def opened(self, at: np.ndarray, weight: np.ndarray, groups: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores in single precision) of what is in ``groups`` and has terms; the
        bound of a group is the score of its only document."""
        size = self.sizes[groups]
        alone = self.groups[groups[size == 1]], bounds[size == 1]
        if len(alone[0]) == len(groups):
            return alone
        docs = _spread(self.groups[groups[size > 1]], size[size > 1])
        count = self.begin[docs + 1] - self.begin[docs]
        docs, count = docs[count > 0], count[count > 0]
        if not len(docs):
            return alone
        index = _spread(self.begin[docs], count)
        self.single[at] = weight
        value = self.single[self.term[index]]
        value *= self.impact[index]
        self.single[at] = 0
        return np.append(alone[0], docs), np.append(alone[1], np.add.reduceat(value, np.cumsum(count) - count))

    def search(
        self, first: np.ndarray, at: np.ndarray, weight: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int,
        floor: np.ndarray | None = None,
    ) -> int:
        """Puts into ``best``, (ids, scores) of every query, all that is among its best
        ``k``, and returns how many (query, block) pairs were scored.

        Rows (at, weight) of a query begin at ``first`` (one more than queries); ``at`` are
        places in the shard's terms. Queries whose highest bounds are in the same block go
        together, ``TILE`` at a time, through the blocks in descending order of bounds; a
        query skips a block whose bound doesn't reach its k-th best score so far. Groups
        that can reach it by a bound of single precision are opened; their documents that
        can get an exact score. A query that has no k-th best score yet gets one from the
        groups of highest bounds in its first block. ``floor`` are scores that ``k`` other
        documents reach.
        """
        scored = 0
        at_least = np.zeros(len(best)) if floor is None else floor
        bound = self.bounds(first, at, weight)
        queries = np.lexsort((-bound.max(1), bound.argmax(1)))
        for lo in range(0, len(queries), TILE):
            tile = queries[lo : lo + TILE]
            count = first[tile + 1] - first[tile]
            index = _spread(first[tile], count)
            q, t, w = np.repeat(np.arange(len(tile)), count), at[index], weight[index].astype(np.float32)
            error = 1e-7 * (count + 20)  # relative, of sums of so many terms in single precision
            top = np.repeat(at_least[tile, None], k, axis=1)  # of every query, k scores that are reached for sure
            for n, i in enumerate(tile.tolist()):
                if len(best[i][1]):
                    top[n] = np.sort(np.concatenate([top[n], best[i][1]]))[-k:]
            new = top[:, 0] == 0
            found = []
            for b in np.argsort(-bound[tile].max(0), kind="stable").tolist():
                rows = np.flatnonzero(bound[tile, b] >= np.maximum(top[:, 0], 2e-5))
                if not len(rows):
                    continue
                scored += len(rows)
                block = self.blocks[b]
                if len(rows) < len(tile):
                    seat = np.full(len(tile), -1)
                    seat[rows] = np.arange(len(rows))
                    own = seat[q]
                    ok = np.flatnonzero(own >= 0)
                    s = block.scores(len(rows), own[ok], t[ok], w[ok])
                else:
                    s = block.scores(len(rows), q, t, w)
                slack = error[rows]
                for n in np.flatnonzero(new[rows]).tolist():
                    some = np.argpartition(s[n], block.n - 2 * k)[-2 * k :] if block.n > 2 * k else np.arange(block.n)
                    mine = slice(first[tile[rows[n]]], first[tile[rows[n]] + 1])
                    sure = self.opened(at[mine], weight[mine], some + block.first, s[n, some])[1] * (1 - 2 * slack[n]) - 2e-6
                    top[rows[n]] = np.sort(np.concatenate([top[rows[n]], np.maximum(sure, 0)]))[-k:]
                low = np.maximum((top[rows, 0] - 1e-6) * (1 - slack), 1e-12).astype(np.float32)
                flat = np.flatnonzero(s >= low[:, None])
                r, group = np.divmod(flat, block.n)
                score = s.ravel()[flat]
                # a group's best document has its bound's share at least
                least = score / self.sizes[group + block.first]
                self._raise(top, rows, ~new[rows], r, least * (1 - 2 * slack[r]) - 2e-6, k)
                new[rows] = False
                found.append((rows[r], group + block.first, score))
            if not found:
                continue
            r, group, score = (np.concatenate(x) for x in zip(*found, strict=True))
            near = np.flatnonzero(score >= (top[r, 0] - 1e-6) * (1 - error[r]))
            if not len(near):
                continue
            near = near[np.lexsort((-score[near], r[near]))]
            changed, begin = np.unique(r[near], return_index=True)
            for n, x, y in zip(changed.tolist(), begin.tolist(), [*begin[1:].tolist(), len(near)], strict=True):
                i = int(tile[n])
                mine = slice(first[i], first[i + 1])
                self._take(at[mine], weight[mine], group[near[x:y]], score[near[x:y]], float(error[n]), float(top[n, 0]), best, i, k)
        return scored

    @staticmethod
    def _raise(top: np.ndarray, rows: np.ndarray, which: np.ndarray, r: np.ndarray, sure: np.ndarray, k: int) -> None:
        """Scores ``sure`` of the rows ``r`` (ascending) come into ``top`` where they raise it."""
        up = np.flatnonzero(which[r] & (sure > top[rows[r], 0]))
        if not len(up):
            return
        up = up[np.lexsort((-sure[up], r[up]))]
        at, begin, n = np.unique(r[up], return_index=True, return_counts=True)
        place = np.arange(len(up)) - np.repeat(begin, n)
        more = np.zeros((len(at), k))
        keep = place < k
        more[np.repeat(np.arange(len(at)), n)[keep], place[keep]] = sure[up[keep]]
        top[rows[at]] = np.sort(np.concatenate([top[rows[at]], more], axis=1), axis=1)[:, k:]

    def _take(self, at: np.ndarray, weight: np.ndarray, groups: np.ndarray, bounds: np.ndarray, error: float, least: float, best: list, i: int, k: int) -> None:
        """Puts what is among the best ``k`` of query ``i`` in ``groups``, which are in
        descending order of their bounds, into ``best``."""
        ids, scores = best[i]
        docs, got, done, step = [], [], 0, 4 * k
        while True:
            end = int(np.searchsorted(-bounds, -(least - 1e-6) * (1 - error), "right"))
            if done >= end:
                break
            last = min(end, done + step)
            d, s = self.opened(at, weight, groups[done:last], bounds[done:last])
            docs.append(d)
            got.append(s)
            done, step = last, 4 * step
            sure = np.concatenate([scores, *(x * (1 - 2 * error) - 2e-6 for x in got)])
            if len(sure) >= k:
                least = max(least, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
        if not docs:
            return
        d, s = np.concatenate(docs), np.concatenate(got)
        d = d[(s > 0) & (s >= (least - 1e-6) * (1 - error))]
        if not len(d):
            return
        scores = np.concatenate([scores, self.exact(at, weight, d)])
        ids = np.concatenate([ids, self.shard.ids[d]])
        order = np.lexsort((ids, -scores))[:k]
        order = order[scores[order] > 0]
        best[i] = ids[order], scores[order]

def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, postings, made = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids, lengths, docs, words, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = Shard.build(ids, lengths, docs, words, tfs)
            number = TaskContext.get().partitionId() * 100_000 + made
            _write(folder, f"index-{number}", shard.save)
            row = {"shard": number, "documents": n, "words": int(lengths.sum())}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in row.items()})

        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                row, h = terms(textbuf.of(part, "text"))
                doc, word, tf = _counted(row, h)
                lengths = np.bincount(row, minlength=part.num_rows)
                held.append((part.column(0).to_numpy(zero_copy_only=False), lengths, doc + n, word, tf))
                n += part.num_rows
                postings += len(doc)
                if postings >= POSTINGS:
                    yield flush()
                    held, n, postings, made = [], 0, 0, made + 1
        if n:
            yield flush()

    return run


def build(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the index of ``docs`` (doc_id, text) to ``folder``, which all executors
    share, and returns its manifest: (shard, documents, words). Rows without an id can't be
    results and are left out."""
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.filter("doc_id is not null").mapInArrow(_index(folder), "shard long, documents long, words long"))


def _read(folder: str, name: str) -> bytes:
    fs, at = filesystem(folder)
    with fs.open_input_stream(f"{at}/{name}") as f:
        return f.read()


def _write(folder: str, name: str, save) -> None:
    """Under a name of its own, then renamed: a task that is lost or runs twice leaves one
    whole file."""
    fs, at = filesystem(folder)
    own = f"{at}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        save(out)
    settle(fs, own, f"{at}/{name}")


def _vocabulary(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard = Shard.load(_read(folder, f"index-{number}"), ("terms", "entry_at", "posting_at"))
                df = np.diff(shard.posting_at[shard.entry_at].astype(np.int64))
                for lo in range(0, len(df), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.terms[part].view(np.int64)), pa.array(df[part])], ["term", "df"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textbuf.pieces(batch, "text"):
            row, word, _ = _counted(*terms(textbuf.of(part, "text")))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(word.view(np.int64))], ["query_id", "term"])


def _write_queries(folder: str):
    """Rows (chunk, query_id, term, w), ordered, to a file for each chunk: its terms, its
    queries, where their rows begin, and the rows' terms (by place) and weights."""

    def close(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        ids, term, weight = (np.concatenate(c) for c in zip(*held, strict=True))
        terms_, at = np.unique(term.view(_U64), return_inverse=True)
        first = np.flatnonzero(~textbuf.equal_to_last(ids))
        _write(folder, f"queries-{chunk}", lambda out: _save(out, [terms_, ids[first], np.append(first, len(ids)), at, weight]))
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, *cols = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True):
                if chunk[lo] != key:
                    if held:
                        yield close(key, held)
                    key, held = int(chunk[lo]), []
                held.append(tuple(c[lo:hi] for c in cols))
        if held:
            yield close(key, held)

    return run


def _search(folder: str, k: int, average: float, ahead: bool):
    """Rows (chunks, shards): what the shards have for the chunks' queries. Those that go
    ahead write the k-th best score of each query, which the others begin with."""

    def held(chunk: int, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chunk's rows that the shard has: where those of each query begin, their
        places in its terms, their weights."""
        terms_, _, first, rows, weight = _load_arrays(_read(folder, f"queries-{chunk}"), [True, False, True, True, True])
        at = np.minimum(np.searchsorted(shard.terms, terms_), len(shard.terms) - 1)
        at = np.where(shard.terms[at] == terms_, at, -1).astype(np.int32)[rows]
        there = at >= 0
        before = np.concatenate([[0], np.cumsum(there)])
        return before[first.astype(np.int64)], at[there], weight[there]

    def answer(chunks: list[int], shards: list[int]) -> Iterator[pa.RecordBatch]:
        ids = [_load_arrays(_read(folder, f"queries-{c}"), [False, True, False, False, False])[1] for c in chunks]
        floors = [None if ahead else _load_arrays(_read(folder, f"floor-{c}"), [True])[0] for c in chunks]
        bests = [[(np.zeros(0, np.int64), np.zeros(0))] * len(x) for x in ids]
        for number in sorted(shards):
            shard = Shard.load(_read(folder, f"index-{number}"))
            if not len(shard.terms):
                continue
            searcher = Searcher(shard, average)
            for chunk, best, floor in zip(chunks, bests, floors, strict=True):
                searcher.search(*held(chunk, shard), best, k, floor)
            del searcher, shard
            textbuf.release()
        for chunk, own, best in zip(chunks, ids, bests, strict=True):
            if ahead:
                reached = np.array([s[k - 1] if len(s) == k else 0.0 for _, s in best])
                _write(folder, f"floor-{chunk}", lambda out, reached=reached: _save(out, [reached]))
            found = np.array([len(s) for _, s in best])
            got = [np.concatenate(x) if len(own) else np.zeros(0) for x in zip(*best, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found).astype(np.int64)), pa.array(got[0].astype(np.int64)), pa.array(got[1])], ["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunks, shards in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from answer(chunks, shards)
                textbuf.release()

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, max_terms: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): for every query (query_id, text) the ``k`` documents
    of highest BM25 score over 0, ties by doc_id; scores are rounded to 6 decimals.

    A query is its text's distinct terms. With ``max_terms`` it is formulated, from its
    whole text, of that many terms of highest inverse document frequency among those that
    two documents or more have; the search for it is exact. Texts that are null, empty or
    have no term give no rows. A document that stands in several rows is a result for each;
    rows without an id are neither documents nor queries. Very long texts are documents and
    queries as a whole; an empty table gives an empty result. Other columns are not looked
    at.
    """
    folder = f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    manifest = build(docs, folder)
    total = manifest.agg(F.sum("documents").alias("n"), F.sum("words").alias("w"), F.count("*").alias("s")).first()
    n, words, shards = total["n"] or 0, total["w"] or 0, total["s"]
    average = max(words / n, 1e-9) if n else 1.0
    spread = manifest.repartitionByRange(max(1, min(shards, 10_000)), "shard").select("shard")
    vocabulary = spread.mapInArrow(_vocabulary(folder), "term long, df long")

    ids = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))
    asked = cut(ids.filter("query_id is not null and text is not null").mapInArrow(_query_terms, "query_id long, term long").distinct())
    known = asked.select("term").distinct()
    idf = F.log(1 + (F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    df = vocabulary.join(known, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n"))
    weighed = asked.join(cut(df.select("term", idf.alias("w"), "n")), "term")
    if max_terms is not None:
        by_weight = Window.partitionBy("query_id").orderBy(F.desc("w"), "term")
        weighed = weighed.filter("n > 1").withColumn("r", F.row_number().over(by_weight)).filter(F.col("r") <= max_terms)
    weighed = cut(weighed.select("query_id", "term", "w"))
    chunks = max(1, -(-queries.count() // CHUNK), -(-weighed.count() // CHUNK_TERMS))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("long").alias("chunk")
    written = cut(
        weighed.select(chunk, "query_id", "term", "w")
        .repartitionByRange(min(4 * chunks, 10_000), "chunk")  # so many that sampled bounds part all chunks
        .sortWithinPartitions("chunk", "query_id", "term")
        .mapInArrow(_write_queries(folder), "chunk long")
    )
    ahead = min(MOST_AHEAD, max(AHEAD, shards // 16))
    rest = max(0, shards - ahead)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-rest // GROUP), min(-(-2 * cores // chunks), -(-rest // LEAST_GROUP)))
    parts = -(-chunks // min(CHUNKS, max(1, chunks * groups // (2 * cores))))
    rows = "query_id long, doc_id long, score double"
    # the queries are few beside the documents, and every chunk is held against every shard
    largest = [r["shard"] for r in manifest.orderBy(F.desc("words"), "shard").select("shard").limit(ahead).collect()]
    some = manifest.filter(F.col("shard").isin(largest)).agg(F.collect_list("shard").alias("shards"))
    found = cut(
        written.crossJoin(some)
        .repartitionByRange(min(4 * chunks, 10_000), "chunk")
        .select(F.array("chunk").alias("chunks"), "shards")
        .mapInArrow(_search(folder, k, average, ahead=True), rows)
    )
    if rest:
        group = F.pmod(F.row_number().over(Window.orderBy("words", "shard")), F.lit(groups)).alias("group")
        members = manifest.filter(~F.col("shard").isin(largest)).withColumn("group", group).groupBy("group").agg(F.collect_list("shard").alias("shards"))
        asked_of = written.groupBy(F.pmod("chunk", F.lit(parts)).alias("part")).agg(F.collect_list("chunk").alias("chunks"))
        blocks = asked_of.crossJoin(members).repartitionByRange(min(4 * parts * groups, 10_000), "part", "group").select("chunks", "shards")
        found = found.unionByName(blocks.mapInArrow(_search(folder, k, average, ahead=False), rows))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    )
