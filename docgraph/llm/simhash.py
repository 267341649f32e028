"""SimHash near-dedup: every pair of fingerprints within the radius is found, with BK-trees over parts of them.

Every document gets a 128-bit SimHash over its folded word pairs (with end markers, so that one word is enough). Two
documents are near copies where their fingerprints differ in at most ``radius`` bits.

A BK-tree over whole fingerprints prunes nothing at 30 of 128 bits: strangers differ in about 64 bits, and so do the
distances to any node. So fingerprints are cut into parts whose tolerances and ones add up to ``radius`` + 1: a pair
within the radius is within the tolerance in at least one part (pigeonhole). For each part the distinct values are
looked up in a BK-tree with that tolerance, and the fingerprints of two values so found are compared in full, each with
each, in numpy. No link is left out. Parts are fewer and longer the larger the corpus is, so that a value keeps enough
fingerprints to be compared at once; the share of all pairs that is compared falls from a half to a thirteenth.

There is one way at every size: for each part, fingerprints travel to the cells of the groups of values that they meet,
16 bytes and the cell's number a row. A cell keeps the components that it knows, and what is of one component is
not compared again, so that a large family of near copies costs little more than its size.

``sampled_pairs`` is the cheaper way by sampled bits, which leaves out a share of the links; no query uses it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import cut, groups

BITS = 128
RADIUS = 30
RECALL = 0.92
#: Unrelated fingerprints in a shard, if all bits were even: a power of two.
SHARD = 512
#: Larger shards are searched with regard to what is linked already. Rows of a task, about, and of those searched at once.
HOT, TASK_ROWS, AT_ONCE = 8192, 1 << 20, 1 << 17
#: Fingerprints of a group of values, about; pairs that are compared at once; links that are held before they are joined.
GROUP, TILE, HELD = 1 << 20, 1 << 17, 1 << 18
#: _LANES[b] has the bits of b in the eight bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(n, 2) uint64: the SimHash of each text; texts without a word have 0, 0."""
    w = tk.words(texts, folded=True)
    n_docs, counts = len(w.bounds) - 1, np.diff(w.bounds)
    # word pairs with a marker at both ends: text d has counts[d] + 1 of them
    has = counts > 0
    at = np.cumsum(np.where(has, counts + 1, 0))
    first = at - np.where(has, counts + 1, 0)
    total = int(at[-1]) if n_docs else 0
    if not total:
        return np.zeros((n_docs, 2), np.uint64)
    left, right = np.full(total, np.uint64(1)), np.full(total, np.uint64(2))
    place = np.arange(len(w.hash)) + np.repeat(first - w.bounds[:-1], counts)
    left[place + 1], right[place] = w.hash, w.hash
    pair = tk.mix(left * np.uint64(3) + np.uint64(5) ^ tk.mix(right, 3), 4)
    bytes_ = np.empty((total, 2), np.uint64)
    bytes_[:, 0], bytes_[:, 1] = tk.mix(pair, 11), tk.mix(pair, 12)
    bytes_ = bytes_.view(np.uint8)
    # sums in byte lanes of at most 255 pairs, then over the lanes of each text
    size = np.where(has, counts + 1, 0)[has]
    begin = first[has]
    parts = -(-size // 255)
    chunk = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    lanes = np.empty((len(chunk), BITS), np.uint8)
    for k in range(BITS // 8):
        lanes[:, 8 * k : 8 * k + 8] = np.add.reduceat(_LANES[bytes_[:, k]], chunk).view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(lanes, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    out = np.zeros((n_docs, 2), np.uint64)
    out[has] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of the rows of two (n, 2) arrays."""
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int16) + np.bitwise_count(a[:, 1] ^ b[:, 1])


class Trees:
    """BK-trees of many shards. Items of a shard enter in order; the first is the root.

    ``parent`` and ``edge`` give each item's parent and its distance to that, -1 for roots. Two children of a node
    never have the same distance to it.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray) -> None:
        n = len(prints)
        self.prints, self.parent, self.edge = prints, np.full(n, -1), np.full(n, -1)
        _, root, self.shard = np.unique(shard, return_index=True, return_inverse=True)
        self.root = root
        at = root[self.shard]
        todo = np.flatnonzero(at != np.arange(n))
        while len(todo):
            key = at[todo].astype(np.int64) * (BITS + 1) + distance(prints[todo], prints[at[todo]])
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]  # todo is in order: the earliest item becomes the child
            self.parent[child], self.edge[child] = at[child], key[first] % (BITS + 1)
            at[todo] = child[group]
            todo = todo[todo != at[todo]]
        kids = np.flatnonzero(self.parent >= 0)
        self._kids = kids[np.argsort(self.parent[kids], kind="stable")]
        self._first = np.searchsorted(self.parent[self._kids], np.arange(n + 1))

    def _down(self, q: np.ndarray, node: np.ndarray, d: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, child) for the children of the nodes that the items must go on to; an item's descendants are later items."""
        lo = self._first[node]
        n = self._first[node + 1] - lo
        total = int(n.sum())
        kid = self._kids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)]
        at = np.repeat(np.arange(len(q)), n)
        q = q[at]
        keep = (np.abs(self.edge[kid] - d[at]) <= radius) & (kid <= q)
        return q[keep], kid[keep]

    def pairs(self, radius: int, limit: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j), i < j, of one shard within the radius: each item is looked up from its shard's root."""
        step = max(1, limit // 64)
        for low in range(0, len(self.prints), step):
            stack = [(q := np.arange(low, min(low + step, len(self.prints))), self.root[self.shard[q]])]
            while stack:
                q, node = stack.pop()
                if len(q) > limit:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = distance(self.prints[q], self.prints[node])
                hit = (d <= radius) & (node < q)
                if hit.any():
                    yield node[hit], q[hit]
                q, kid = self._down(q, node, d, radius)
                if len(q):
                    stack.append((q, kid))

    def linked(self, radius: int, limit: int = 500_000) -> np.ndarray:
        """The least item of each item's component: as forest() of pairs(), for one shard with many links.

        Items are looked up block by block. A subtree whose items of earlier blocks are all linked to the looked-up item,
        and which has none of its own block, holds no news.
        """
        n = len(self.prints)
        root, step = np.arange(n), max(1024, int(1.6 * math.sqrt(n)))
        levels, at = [], np.zeros(min(n, 1), np.int64)
        while len(at := np.flatnonzero(np.isin(self.parent, at))):
            levels.insert(0, at)
        for low in range(0, n, step):
            high = min(low + step, n)
            same, new = np.where(np.arange(n) < low, root, -1), np.zeros(n, bool)
            most = same.copy()
            least = np.where(same < 0, n, same)
            new[low:high] = True
            for level in levels:
                up = self.parent[level]
                np.maximum.at(most, up, most[level])
                np.minimum.at(least, up, least[level])
                np.logical_or.at(new, up, new[level])
            stack = [(q := np.arange(low, high), np.zeros(high - low, np.int64))]
            while stack:
                q, node = stack.pop()
                if len(q) > limit:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                known = (least[node] >= n) | ((most[node] == least[node]) & (_top(root, most[node]) == root[q]))
                keep = new[node] | ~known
                q, node = q[keep], node[keep]
                d = distance(self.prints[q], self.prints[node])
                hit = (d <= radius) & (node < q)
                link(root, node[hit], q[hit])
                q, kid = self._down(q, node, d, radius)
                if len(q):
                    stack.append((q, kid))
        return root


def _top(root: np.ndarray, item: np.ndarray) -> np.ndarray:
    return root[np.maximum(item, 0)]


def link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the pairs; ``root`` has the least item of each item's component, before and after."""
    while True:
        ra, rb = root[a], root[b]
        todo = ra != rb
        if not todo.any():
            return
        a, b, ra, rb = a[todo], b[todo], ra[todo], rb[todo]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (item, least item of its component) that connect what the pairs connect: at most n - 1."""
    root = np.arange(n)
    for a, b in pairs:
        link(root, a, b)
    found = np.flatnonzero(root != np.arange(n))
    return found, root[found]


def sampling(n: float, radius: int = RADIUS, recall: float = RECALL, seed: int = 1) -> list[np.ndarray]:
    """The bit places of each table for a corpus of n distinct fingerprints."""
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2)) - math.log2(SHARD))))
    found = math.comb(BITS - radius, bits) / math.comb(BITS, bits)  # none of the places is among the differing ones
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def shard_keys(prints: np.ndarray, places: np.ndarray, t: int) -> np.ndarray:
    """The shard of each fingerprint in table t: the chosen bits, mixed with t."""
    key = np.zeros(len(prints), np.uint64)
    for i, p in enumerate(places):
        key |= ((prints[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)) << np.uint64(i)
    return tk.mix(key, 1000 + t)


def print_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2): the fingerprint of every document that has an id and at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                f = fingerprints(part.column("text"))
                keep = (f != 0).any(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(keep)), pa.array(tk.signed(f[keep, 0])), pa.array(tk.signed(f[keep, 1]))], names=["id", "h1", "h2"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return chosen.mapInArrow(run, "id long, h1 long, h2 long")


def shard_edges(prints: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that connect what is within the radius in each shard, whole shards of at most about AT_ONCE rows at once."""
    order = np.lexsort((prints[:, 1], prints[:, 0], shard))
    first = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    for s, n in zip(first[size > HOT].tolist(), size[size > HOT].tolist(), strict=True):
        rows = order[s : s + n]
        root = Trees(prints[rows], np.zeros(n, np.uint64)).linked(radius)
        item = np.flatnonzero(root != np.arange(n))
        yield rows[item], rows[root[item]]
    of = np.repeat(size, size)
    rest = order[(of > 1) & (of <= HOT)]
    while len(rest):
        end = min(AT_ONCE, len(rest))
        while end < len(rest) and shard[rest[end]] == shard[rest[end - 1]]:
            end += 1
        rows, rest = rest[:end], rest[end:]
        a, b = forest(len(rows), Trees(prints[rows], shard[rows]).pairs(radius))
        yield rows[a], rows[b]


@dataclass(frozen=True)
class Part:
    """The bits of a fingerprint from ``low`` of word ``word`` on, and in how many of them a pair may differ."""

    word: int
    low: int
    width: int
    tolerance: int

    def values(self, prints: np.ndarray) -> np.ndarray:
        return (prints[:, self.word] >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)


def cut_parts(count: int, radius: int) -> list[Part]:
    """``count`` parts, an even number, none across words. Any two fingerprints within the radius meet in one of them."""
    half = count // 2
    edges = np.linspace(0, 64, half + 1).round().astype(int).tolist()
    places = [(word, edges[i], edges[i + 1] - edges[i]) for word in (0, 1) for i in range(half)]
    least, more = divmod(radius + 1, count)
    wide = sorted(range(count), key=lambda i: -places[i][2])
    tolerance = {i: least - 1 + (k < more) for k, i in enumerate(wide)}
    return [Part(*places[i], tolerance[i]) for i in range(count) if tolerance[i] >= 0]


def parts_for(n: int, radius: int = RADIUS) -> list[Part]:
    """The parts that cost least for n even fingerprints: in comparisons, and in values, which cost about 150,000 of them each (measured)."""

    def price(parts: list[Part]) -> float:
        return sum(n * n / 2 * sum(math.comb(p.width, k) for k in range(p.tolerance + 1)) / 2**p.width + 150_000 * min(n, 2**p.width) for p in parts)

    return min((cut_parts(count, radius) for count in range(8, 18, 2)), key=price)


class Linker:
    """The components of the rows of ``prints`` by what is within the radius among the rows that are compared."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.h1, self.h2 = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
        self.radius, self.root = radius, np.arange(len(prints))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def join(self) -> None:
        if self.count:
            link(self.root, *(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.count = [], 0

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Each of the rows with each of the columns, but those known to be of one component."""
        high = max(1, min(len(rows), 64))
        wide = max(1, TILE // high)
        for low in range(0, len(rows), high):
            a = rows[low : low + high]
            for left in range(0, len(cols), wide):
                b = cols[left : left + wide]
                of = self.root[a]
                same = of == of[0]
                self._tile(a[same], b[self.root[b] != of[0]])
                if not same.all():
                    self._tile(a[~same], b)

    def _tile(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        d = np.bitwise_count(self.h1[a][:, None] ^ self.h1[b])
        d += np.bitwise_count(self.h2[a][:, None] ^ self.h2[b])
        if d.min() > self.radius:
            return
        i, j = np.nonzero(d <= self.radius)
        i, j = a[i], b[j]
        new = self.root[i] != self.root[j]
        self.held.append((i[new], j[new]))
        self.count += int(new.sum())
        if self.count >= HELD:
            self.join()


def cell_edges(prints: np.ndarray, part: Part, group_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (item, least of its component) by all pairs within the tolerance of the part, of one group or of two different ones."""
    value = part.values(prints)
    order = np.argsort(value, kind="stable")
    values, first = np.unique(value[order], return_index=True)
    last = np.append(first[1:], len(order))
    group = values >> np.uint64(part.width - group_bits)
    two = len(values) and group[0] != group[-1]
    found = [np.empty((2, 0), np.int64)] if two else [np.tile(np.arange(len(values)), (2, 1))]
    shuffled = np.random.default_rng(1).permutation(len(values))
    tree = Trees(np.stack([values[shuffled], np.zeros_like(values)], axis=1), np.zeros(len(values), np.uint64))
    for i, j in tree.pairs(part.tolerance):
        i, j = shuffled[i], shuffled[j]
        keep = group[i] != group[j] if two else slice(None)
        found.append(np.stack([np.minimum(i, j)[keep], np.maximum(i, j)[keep]]))
    near = np.concatenate(found, axis=1)
    near = near[:, np.lexsort((near[1], near[0]))]
    at = np.flatnonzero(np.concatenate([[True], near[0][1:] != near[0][:-1]])) if near.shape[1] else np.empty(0, np.int64)
    linker = Linker(prints[order], radius)
    for s, e in zip(at.tolist(), np.append(at, near.shape[1])[1:].tolist(), strict=True):
        to = near[1, s:e]
        size = last[to] - first[to]
        cols = np.repeat(first[to] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        linker.compare(np.arange(first[near[0, s]], last[near[0, s]]), cols)
    linker.join()
    item = np.flatnonzero(linker.root != np.arange(len(order)))
    return order[item], order[linker.root[item]]


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (id, h1, h2) within the radius."""
    n = prints.count()
    parts = parts_for(n, radius)
    bits = max(1, math.ceil(math.log2(max(n, 1) / GROUP)))
    # a cell for two groups of a part that can hold values within its tolerance
    cells = [(p, i, j) for p in range(len(parts)) for i in range(1 << bits) for j in range(i, 1 << bits) if (i ^ j).bit_count() <= parts[p].tolerance]
    number = np.full((len(parts), 1 << bits, 1 << bits), -1, np.int32)
    for c, (p, i, j) in enumerate(cells):
        number[p, i, j] = number[p, j, i] = c

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1).view(np.uint64)
            for p, part in enumerate(parts):
                group = (part.values(marks) >> np.uint64(part.width - bits)).astype(np.int64)
                for other in range(1 << bits):
                    cell = number[p, group, other]
                    to = pa.array(cell >= 0)
                    yield pa.RecordBatch.from_arrays([x.filter(to) for x in (pa.array(cell), *batch.columns)], names=["cell", "h1", "h2"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cell, h1, h2 = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("cell", "h1", "h2"))
        held.clear()
        for c in np.unique(cell).tolist():
            own = np.flatnonzero(cell == c)
            a, b = cell_edges(np.stack([h1[own], h2[own]], axis=1).view(np.uint64), parts[cells[c][0]], bits, radius)
            a, b = own[a], own[b]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[a], h2[a], h1[b], h2[b])], names=["a1", "a2", "b1", "b2"])

    placed = prints.select("h1", "h2").mapInArrow(spread, "cell int, h1 long, h2 long").repartitionById(len(cells), F.col("cell"))
    return _named(prints, placed.mapInArrow(search, "a1 long, a2 long, b1 long, b2 long"))


def _named(prints: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): the ids of the fingerprints of edges."""
    edges = cut(found.distinct())
    end = lambda c: prints.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), F.col("id").alias(c))
    return edges.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("a", "b").distinct()


def sampled_pairs(prints: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (id, h1, h2) within the radius that share a shard.

    Shards are made by several sampled sets of bits, each with a BK-tree over whole fingerprints. As many samplings are
    made as find a pair at ``radius`` bits with probability ``recall``; the other links are left out.
    """
    n = prints.count()
    tables = sampling(n, radius, recall)
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(tables) // TASK_ROWS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1).view(np.uint64)
            for t, places in enumerate(tables):
                part = (shard_keys(marks, places, t) % np.uint64(64 * parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(marks), t, np.int32)), *batch.columns], names=["part", "t", "h1", "h2"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t, h1, h2 = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("t", "h1", "h2"))
        held.clear()
        marks = np.stack([h1, h2], axis=1).view(np.uint64)
        shard = np.empty(len(t), np.uint64)
        for k in np.unique(t).tolist():
            own = np.flatnonzero(t == k)
            shard[own] = shard_keys(marks[own], tables[k], k)
        for a, b in shard_edges(marks, shard, radius):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[a], h2[a], h1[b], h2[b])], names=["a1", "a2", "b1", "b2"])

    placed = prints.select("h1", "h2").mapInArrow(spread, "part int, t int, h1 long, h2 long").repartition(parts, "part")
    return _named(prints, placed.mapInArrow(search, "a1 long, a2 long, b1 long, b2 long"))


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, class_id): every document with an id and a word, once, and the least id of its class."""
    prints = cut(print_docs(docs, id_col, text_col))
    heads = cut(prints.groupBy("h1", "h2").agg(F.min("id").alias("id"))).select("id", "h1", "h2")
    held = prints.join(heads.withColumnRenamed("id", "head"), ["h1", "h2"]).groupBy("id").agg(F.min("head").alias("head"), F.collect_set("head").alias("heads"))
    held = cut(held)
    # an id that stands at several texts joins their classes
    same = held.where(F.size("heads") > 1).select(F.col("head").alias("a"), F.explode("heads").alias("b"))
    joined = groups(near_pairs(heads, radius).unionByName(same))
    return held.join(joined, held["head"] == joined["node"], "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "head").alias("class_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, class_id): one row for every document that has an id; the class is named by its least id.

    Classes are the connected components of the near-copy relation, with no link left out. Equal texts have equal
    fingerprints, so exact copies are of one class, as are rows that repeat an id. Null, empty and wordless texts are a
    class of their own each. Very long texts are read whole; other columns are not read. An empty table gives no rows.
    """
    found = _members(docs, id_col, text_col, radius)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, keep_id): every document that repeats another, and the least id of its class, which stays.

    These are the rows of classes() whose document isn't the first of its class.
    """
    return _members(docs, id_col, text_col, radius).where("doc_id <> class_id").withColumnRenamed("class_id", "keep_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without those that repeat another: one of each group stays, with all columns.

    Rows without an id, a text or a word stay, as do all rows of the id that stays. An empty table stays empty.
    """
    gone = near_duplicates(docs, radius=radius).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
