"""Exact repeated word windows, found from anchors.

An anchor is chosen for every window of ``LENGTH`` words, from the window's own words alone, so that equal windows have
equal anchors at the same place. Consecutive windows of one anchor form a run. Three shuffles follow:

1. anchors by their hash: those that occur once in the whole corpus are dropped, with all their windows;
2. texts by document, to those with an anchor left;
3. runs by anchor, each with its windows' digits: four 32-bit hashes of the window's consecutive words. The windows of
   an anchor are ordered by one digit after another, most significant first, and groups of one are dropped after each.

What is left after the last digit are exactly the repeated windows; none is sampled.

The first and the third shuffle are read in their order, and no task holds more than HOT rows of one anchor: the windows
of an anchor with more go by their own digits instead, each a row, so that equal windows come one after another, the
one with the least id first, and two rows tell what becomes of all. A header that a third of all documents share is such
an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk

LENGTH = 50
#: Rows of an anchor from which on its windows are shuffled by all their digits.
HOT = 1 << 16
DIGITS = (0, 13, 26, 38, 50)
_POS = np.uint64((1 << 26) - 1)
_NONE = np.uint64(2**64 - 1)

#: Of a slice's words: a hash where a candidate starts and which words those are, and the first and last place in a window at which one may start.
Candidates = Callable[[tk.Words], tuple[np.ndarray, np.ndarray, int, int]]


def runs(w: tk.Words, candidates: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's word, anchor's hash) of each run; a window is named by its first word."""
    n, none = len(w.hash), np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.empty(0, np.uint64)
    hashes, has, lo, hi = candidates(w)
    key = np.where(has, (tk.mix(hashes, 99) & ~_POS) | np.arange(n, dtype=np.uint64), _NONE)
    width, have, best = hi - lo + 1, 1, key
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    doc = w.doc
    p = np.arange(n - LENGTH + 1)
    p = p[doc[p] == doc[p + LENGTH - 1]]
    if not len(p):
        return none, none, none, np.empty(0, np.uint64)
    anchor = (best[p + lo] & _POS).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    return p[first], np.diff(np.append(first, len(p))), anchor[first], hashes[anchor[first]]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def repeated_hashes(anchors: DataFrame, most: int | None = None) -> DataFrame:
    """The rows (h, id) whose h occurs more than once, and whether it has more than ``most`` rows (HOT)."""
    limit = HOT if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        h_held, id_held, hot_now = none, none, None  # the last anchor's rows, unless it is known to be hot

        def rows(h: np.ndarray, ids: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(hot)], names=["h", "id", "hot"])

        def whole(h: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else none
            n = np.diff(np.append(first, len(h)))
            n = np.repeat(n, n)
            return rows(h[n > 1], ids[n > 1], (n > limit)[n > 1])

        for batch in batches:  # sorted by anchor
            if not batch.num_rows:
                continue
            h, ids = np.concatenate([h_held, batch.column(0).to_numpy()]), np.concatenate([id_held, batch.column(1).to_numpy()])
            if hot_now is not None:
                n = int(np.searchsorted(h, hot_now, "right"))
                if n:
                    yield rows(h[:n], ids[:n], np.ones(n, bool))
                h, ids = h[n:], ids[n:]
                h_held, id_held = none, none
                if not len(h):
                    continue
                hot_now = None
            last = int(np.searchsorted(h, h[-1]))
            yield whole(h[:last], ids[:last])
            h_held, id_held = h[last:], ids[last:]
            if len(h_held) > limit:
                yield rows(h_held, id_held, np.ones(len(h_held), bool))
                hot_now, h_held, id_held = h_held[0], none, none
        yield whole(h_held, id_held)

    return anchors.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, id long, hot boolean")


class Stream:
    """Equal windows one after another, sorted by anchor, digits and document: all but single ones, with the least document."""

    def __init__(self) -> None:
        self.key, self.first, self.single = None, 0, None

    def __call__(self, h: np.ndarray, digits: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, start, end, first_doc) of what is known to be repeated now."""
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (digits[1:] != digits[:-1]).any(axis=1)
        key = (int(h[0]), digits[0].tobytes())
        goes_on = key == self.key
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(h)))
        first, size = doc[begin], n.copy()
        out = []
        if goes_on:
            first[0], size[0] = self.first, n[0] + 1
            if self.single is not None:
                out.append(self.single)
        keep = np.repeat(size > 1, n)
        self.key, self.first = (int(h[-1]), digits[-1].tobytes()), int(first[-1])
        self.single = (int(doc[-1]), int(pos[-1])) if size[-1] == 1 else None
        docs, at, least = doc[keep], pos[keep], np.repeat(first, n)[keep]
        if out:
            docs, at, least = np.append(docs, out[0][0]), np.append(at, out[0][1]), np.append(least, first[0])
        return docs, at, at + LENGTH, least


def equal_windows(anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, rel: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, end, first_doc) of the repeated windows of whole anchor groups.

    Of each run: document, first window, windows, the anchor's place in its first window; digits has a row a window.
    """
    total = int(n.sum())
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    _, a = np.unique(anchor, return_inverse=True)
    group = a[run].astype(np.uint64) * np.uint64(LENGTH) + (rel[run] - within).astype(np.uint64)
    rows = np.arange(total)
    for k in range(-1, digits.shape[1]):
        if k >= 0:
            group = group << np.uint64(32) | digits[rows, k].astype(np.uint64)
        _, group, count = np.unique(group, return_inverse=True, return_counts=True)
        keep = count[group] > 1
        rows, group = rows[keep], group[keep].astype(np.uint64)
    if not len(rows):
        return (np.empty(0, np.int64),) * 4
    _, g = np.unique(group, return_inverse=True)
    least = np.full(int(g.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, g, doc[run[rows]])
    first = least[g]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1] + 1) | (run[rows[1:]] != run[rows[:-1]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(rows)) - 1
    at = pos[run[rows]] + within[rows]
    return doc[run[rows[begin]]], at[begin], at[last] + LENGTH, np.minimum.reduceat(first, begin)


def repeated_spans(docs: DataFrame, candidates: Candidates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): see suffix.repeated_passages."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                w = tk.words(part.column("text"), folded=False)
                _, _, at, h = runs(w, candidates)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h)), part.column("id").take(pa.array(doc))], names=["h", "id"])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                w = tk.words(part.column("text"), folded=False)
                p, n, at, h = runs(w, candidates)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                marks = part.column("marks")
                flat = marks.flatten()
                known, of = flat.field("h").to_numpy().view(np.uint64), np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
                of_hot = flat.field("hot").to_numpy(zero_copy_only=False)
                own, known = tk.mix(h ^ tk.mix(doc.astype(np.uint64), 5), 6), tk.mix(known ^ tk.mix(of.astype(np.uint64), 5), 6)
                keep = np.isin(own, known)
                hot = np.isin(own[keep], known[of_hot])
                p, n, at, h, doc = p[keep], n[keep], at[keep], h[keep], doc[keep]
                windows = _spread(p, n)
                digits = np.empty((len(windows), 4), np.uint32)
                if len(windows):
                    up, down = tk.powers(tk.WORD_BASE, len(w.hash) + 1)
                    sums = np.zeros(len(w.hash) + 1, np.uint64)
                    np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
                    for k in range(4):
                        s, e = windows + DIGITS[k], windows + DIGITS[k + 1]
                        digits[:, k] = (tk.mix((sums[e] - sums[s]) * down[s]) >> np.uint64(32)).astype(np.uint32)
                # hot anchors: each window goes by its own digits and its place
                single = np.repeat(hot, n)
                within = np.arange(len(windows)) - np.repeat(np.cumsum(n) - n, n)
                rel = at - p
                one = np.flatnonzero(single)
                run = np.repeat(np.arange(len(n)), n)[one]
                key = tk.mix(h[run] ^ tk.mix((rel[run] - within[one]).astype(np.uint64), 7), 8)
                for k in range(4):
                    key = tk.mix(key ^ digits[one, k].astype(np.uint64), 60 + k)
                local = p - w.bounds[doc]
                cold = ~hot
                yield batch_of(h[cold], part.column("id").take(pa.array(doc[cold])), local[cold], rel[cold], n[cold], digits[~single], False)
                if len(one):
                    yield batch_of(key, part.column("id").take(pa.array(doc[run])), local[run] + within[one], rel[run] - within[one], np.ones(len(one), np.int64), digits[one], True)

    def batch_of(h: np.ndarray, ids: pa.Array, pos: np.ndarray, rel: np.ndarray, n: np.ndarray, digits: np.ndarray, hot: bool) -> pa.RecordBatch:
        ends = np.append(0, np.cumsum(n)) * 16
        digits = np.ascontiguousarray(digits)
        blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(digits.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), hot)), pa.array(tk.signed(h)), ids, pa.array(pos), pa.array(rel), blob.cast(pa.binary())], names=["hot", "h", "id", "pos", "rel", "digits"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        stream = Stream()

        def found(parts: list[pa.RecordBatch], hot: bool = False) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            col = {c: t.column(c).to_numpy() for c in ("h", "id", "pos", "rel")}
            blobs = t.column("digits").combine_chunks().cast(pa.large_binary())
            off = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
            digits = np.frombuffer(blobs.buffers()[2], np.uint32)[off[0] // 4 : off[-1] // 4].reshape(-1, 4)
            out = stream(col["h"], digits, col["id"], col["pos"]) if hot else equal_windows(col["h"], col["id"], col["pos"], np.diff(off) // 16, col["rel"], digits)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "s", "e", "first_doc"])

        size = 0
        for batch in batches:  # sorted by anchor, hot ones last
            hot = int(np.count_nonzero(batch.column("hot").to_numpy(zero_copy_only=False)))
            rest, batch = batch.slice(batch.num_rows - hot), batch.slice(0, batch.num_rows - hot)
            if hot:
                if held or batch.num_rows:
                    yield found([*held, batch])
                    held = []
                yield found([rest], True)
                continue
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last and size + batch.nbytes > (8 << 20):
                yield found([*held, batch.slice(0, last)])
                held, batch, size = [], batch.slice(last), 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield found(held)

    marks = repeated_hashes(chosen.mapInArrow(anchors, "h long, id long")).groupBy("id").agg(F.collect_set(F.struct("h", "hot")).alias("marks"))
    pieces = (
        chosen.join(marks, "id")
        .mapInArrow(survivors, "hot boolean, h long, id long, pos long, rel long, digits binary")
        .repartition("h")
        .sortWithinPartitions("hot", "h", "digits", "id")
        .mapInArrow(grouped, "doc_id long, s long, e long, first_doc long")
    )
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("first_doc").alias("first_doc")).drop("island")


def oracle(docs: str = "documents") -> str:
    """The same by listing every window."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, unnest(list_transform(range(len(w) - {LENGTH - 1}), lambda i: {{'s': i, 'h': md5(array_to_string(w[i + 1:i + {LENGTH}], ' '))}})) AS x FROM t WHERE len(w) >= {LENGTH}),
g AS (SELECT x.h AS h, min(doc_id) AS first_doc FROM win GROUP BY x.h HAVING count(*) > 1),
p AS (SELECT doc_id, x.s AS s, x.s + {LENGTH} AS e, first_doc FROM win JOIN g ON win.x.h = g.h),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, min(s) AS start_word, max(e) AS end_word, min(first_doc) AS first_doc FROM i GROUP BY doc_id, island"""
