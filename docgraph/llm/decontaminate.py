"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of the documents' folded words, hashed to TERMS terms and weighted by inverse document frequency.
A randomised singular value decomposition of the matrix of all passages gives RANK latent directions: with a seeded
random matrix R, one distributed pass forms A'(A R) from each task's passages, and its left singular vectors span the
directions (a randomised range finder with one power step). Items and windows are compared there by cosine: every
window, STEP words on from the last, of the width nearest to the item's is a candidate where the cosine reaches the
item's own threshold. That is COSINE or less, the cosine which all but MISSED of the weakest passages that have to be accepted reach:
copies in which only SHARE of the words are left, the rest replaced, dropped, or replaced with other words put in
between, drawn for each item in the corpus' own words. Items over MAX_WIDTH words are searched by parts. Candidates are
then checked by their words: the longest common subsequence of the item and the words around the window must hold SHARE
of the item's words, or LOW_SHARE of them along with the item's answer, its last ANSWER words, in their order and
without a gap. Where the answer stands is found by its words, without the latent space, and all windows around it are
candidates. Candidates that hold too few of the item's rarer words to pass are left out before, by a count that can't
be less than what the comparison would find.

A window is given only the items that it can be a candidate of: each item is listed under its rarest words, as many as
a passage that is accepted by SHARE can't wholly lack, and windows of the item stand only where enough of these come
close together. The time of a search so follows the rare words that are met, not the number of items. The list drops
nothing that would be accepted.

Items are prepared by the executors and travel in chunks of at most ITEMS of at most ITEM_WORDS words in all, each by
broadcast, so that a benchmark of any size can be searched.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import cut, map_rows

TERMS, RANK, STEP, MAX_WIDTH = 1 << 15, 48, 4, 64
COSINE, MISSED, SHARE, LOW_SHARE, ANSWER = 0.72, 0.01, 0.7, 0.5, 5
#: Words around a window that are compared along with it, at least.
AROUND = 8
#: Passages drawn for an item's threshold, of each of the three ways; windows whose cosine is taken, and whose words are
#: compared, at once.
_DRAWN, _AT_ONCE, _COMPARED = 48, 4096, 1 << 14
ITEMS, ITEM_WORDS = 50_000, 1 << 22
_BLOCKS = 64
#: Words of a passage of the matrix.
_PASSAGE = 32
_SLICE = tk.SLICE_BYTES // 2


def lcs(item: list[int], text: list[int]) -> int:
    """The length of the longest common subsequence, bit-parallel (Hyyrö 2004)."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for t in text:
        m = masks.get(t)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


def has_run(run: list[int], text: list[int]) -> bool:
    return any(text[i : i + len(run)] == run for i in range(len(text) - len(run) + 1))


def accepted(item: list[int], text: list[int], common: int) -> bool:
    """Whether a passage that shares ``common`` words in order is a copy or a paraphrase of the item."""
    return common >= SHARE * len(item) or (common >= LOW_SHARE * len(item) and has_run(item[-ANSWER:], text))


@dataclass
class Space:
    """The latent space: a row of RANK numbers for each term, times its weight; the weights; how often each term occurs,
    None for equally often."""

    basis: np.ndarray
    idf: np.ndarray
    occurs: np.ndarray | None = None

    @cached_property
    def padded(self) -> np.ndarray:
        """The basis, and a row of zeros for no term."""
        return np.vstack([self.basis, np.zeros((1, RANK), np.float32)])


def _terms(w: tk.Words) -> np.ndarray:
    return (w.hash % np.uint64(TERMS)).astype(np.int64)


def _summed(df: DataFrame, kind: str, width: int) -> np.ndarray:
    """The sum of all tasks' arrays, which come in _BLOCKS blocks."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, kind).astype(np.float64) for b in pdf["data"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [np.asarray(total).tobytes()]})

    out = np.zeros(TERMS * width)
    for r in df.groupBy("block").applyInPandas(add, "block long, data binary").collect():
        part = np.frombuffer(r["data"], np.float64)
        out[r["block"] * len(part) : (r["block"] + 1) * len(part)] = part
    return out.reshape(TERMS, width) if width > 1 else out


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS)), pa.array([p.tobytes() for p in np.split(total.reshape(-1), _BLOCKS)], pa.binary())], names=["block", "data"])


def _summed_rows(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sums of the rows table[index[:, 0]] + table[index[:, 1]] + ..., one column of the index after another."""
    columns = np.ascontiguousarray(index.T)
    out = table[columns[0]]
    for c in columns[1:]:
        out += table[c]
    return out


def _add_by_term(total: np.ndarray, term: np.ndarray, rows: np.ndarray, row: np.ndarray) -> None:
    """total[term] += rows[row] for every entry: the first of every term at once, then the second, and so on."""
    order = np.argsort(term.astype(np.uint16), kind="stable")
    term, row = term[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    n = np.diff(np.append(first, len(term)))
    by_size = np.argsort(-n, kind="stable")
    term, first, n = term[first[by_size]], first[by_size], n[by_size]
    sums = rows[row[first]]
    k, more = 1, int(np.searchsorted(-n, -1, "left"))
    while more and k < 40:
        sums[:more] += rows[row[first[:more] + k]]
        k += 1
        more = int(np.searchsorted(-n, -k, "left"))
    for j in range(more):
        sums[j] += rows[row[first[j] + k : first[j] + n[j]]].sum(axis=0)
    total[term] += sums


def latent_space(texts: DataFrame, seed: int = 23) -> Space:
    """Inverse document frequencies and latent directions from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, 3))
        for batch in batches:
            total[0, 2] += batch.num_rows
            for part in tk.slices(batch, limit=_SLICE):
                w = tk.words(part.column("text"), folded=True)
                t = _terms(w)
                total[:, 0] += np.bincount(tk.distinct(w.doc * TERMS + t) % TERMS, minlength=TERMS)
                total[:, 1] += np.bincount(t, minlength=TERMS)
        yield _blocks(total)

    held, occurs, rows = _summed(texts.mapInArrow(count, "block long, data binary"), "<f8", 3).T
    n = max(1.0, float(rows[0]))
    idf = np.log((n + 1) / (held + 1)) + 0.05
    random = np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32)
    random *= idf[:, None].astype(np.float32)
    sent = texts.sparkSession.sparkContext.broadcast((np.vstack([random, np.zeros((1, RANK), np.float32)]), idf))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, weight = sent.value
        total = np.zeros((TERMS, RANK), np.float32)
        for batch in batches:
            for part in tk.slices(batch, limit=_SLICE):
                w = tk.words(part.column("text"), folded=True)
                if not len(w.hash):
                    continue
                t = _terms(w)
                place = np.arange(len(t)) - w.bounds[w.doc]
                passage = np.cumsum(place % _PASSAGE == 0) - 1
                terms = np.full((passage[-1] + 1, _PASSAGE), TERMS)
                terms[passage, place % _PASSAGE] = t
                y = _summed_rows(left, terms)
                y /= np.bincount(passage, weight[t] ** 2)[:, None].astype(np.float32)
                _add_by_term(total, t, y, passage)  # A'(A R)
        yield _blocks(total)

    z = _summed(texts.mapInArrow(sketch, "block long, data binary"), "<f4", RANK) * idf[:, None]
    directions = np.linalg.svd(z, full_matrices=False)[0] if z.any() else np.zeros((TERMS, RANK))
    return Space((directions * idf[:, None]).astype(np.float32), idf.astype(np.float32), occurs)


@dataclass
class Item:
    """An item as it is searched for.

    ``width`` is that of its windows, in words; ``pieces`` has the width, the unit vector and the threshold of each of
    its parts. ``rare`` are its words but for the SHARE / 2 that are commonest in the corpus, sorted, and ``need`` how
    many of a passage's words must be among these if it is to be accepted by SHARE; ``keys`` are its rarest words, and
    ``least`` how many of a passage's words must be among those.
    """

    id: int
    words: np.ndarray
    width: int
    pieces: list[tuple[int, np.ndarray, float]]
    rare: np.ndarray
    need: int
    keys: np.ndarray
    least: int
    answer: np.uint64

    @property
    def reach(self) -> int:
        """How far around a window the words are compared."""
        n = len(self.words)
        return max(AROUND, n - self.width if n > MAX_WIDTH else 0) + n // 4


@dataclass
class Items:
    """Items, and the lists by which words lead to them: sorted words and, of each word, a stretch of numbers of items."""

    items: list[Item]
    #: Of each item: how many of its keys a passage must have, and within how many words.
    least: np.ndarray
    extent: np.ndarray
    met: np.ndarray
    keys: tuple[np.ndarray, np.ndarray, np.ndarray]
    answers: tuple[np.ndarray, np.ndarray, np.ndarray]


def _width(n: int) -> int:
    return min(MAX_WIDTH, max(STEP, STEP * round(n / STEP)))


def _run_keys(words: np.ndarray) -> np.ndarray:
    """A key of every ANSWER words in a row."""
    n = max(0, len(words) - ANSWER + 1)
    key = np.zeros(n, np.uint64)
    for j in range(ANSWER):
        key = tk.mix(key ^ words[j : j + n], 50 + j)
    return key


def least_cosine(piece: np.ndarray, vector: np.ndarray, space: Space, chances: np.ndarray, rng: np.random.Generator) -> float:
    """The cosine that all but MISSED of the weakest passages to be accepted reach, in the way that is hardest to find.

    ``piece`` has the terms of an item, ``vector`` its unit vector, ``chances`` the summed chances of the corpus' terms.
    """
    n, width = len(piece), _width(len(piece))
    kept = math.ceil(SHARE * n)
    reached = []
    for way in ("replaced", "dropped", "spread"):
        middle = n if way == "replaced" else kept if way == "dropped" else n + n // 4
        edge = width // 2
        long = 2 * edge + max(middle, width) + 2 * STEP
        text = np.minimum(np.searchsorted(chances, rng.random((_DRAWN, long))), TERMS - 1)
        # which of the item's words are left, and where: in their order
        left = np.sort(np.argsort(rng.random((_DRAWN, n)), axis=1)[:, :kept], axis=1)
        place = left if way == "replaced" else np.sort(np.argsort(rng.random((_DRAWN, middle)), axis=1)[:, :kept], axis=1)
        np.put_along_axis(text, edge + rng.integers(0, STEP, (_DRAWN, 1)) + place, piece[left], axis=1)
        sums = np.zeros((_DRAWN, long + 1, RANK), np.float32)
        np.cumsum(space.basis[text], axis=1, out=sums[:, 1:])
        begin = np.arange(0, long - width + 1, STEP)
        window = sums[:, begin + width] - sums[:, begin]
        cosine = window @ vector / np.maximum(np.linalg.norm(window, axis=2), 1e-9)
        reached.append(np.quantile(cosine.max(axis=1), MISSED))
    return min(COSINE, *map(float, reached))


def prepare_item(item: int, text: str, space: Space, chances: np.ndarray) -> Item | None:
    """None for items with fewer than ANSWER words: they are too short to be recognised."""
    w = tk.words(pa.array([text]), folded=True)
    if len(w.hash) < ANSWER:
        return None
    t = _terms(w)
    # a passage accepted by SHARE has ``least`` of the item's words: leave out the commonest, and at least the rest are among the others
    least, order = math.ceil(SHARE * len(t)), np.argsort(space.idf[t], kind="stable")

    def others(left_out: int) -> tuple[np.ndarray, int]:
        common = w.hash[order[:left_out]]
        return np.setdiff1d(w.hash, common), least - int(np.isin(w.hash, common).sum())

    rare, need = others(least // 2)
    keys, least_keys = others(least - max(1, min(4, least // 4)))
    if least_keys < 1:  # the words left out stand at other places too: leave out fewer
        keys, least_keys = np.unique(w.hash), least
    pieces = []
    rng = np.random.default_rng(int(tk.mix(w.hash[:1], len(t))[0]))
    parts = np.array_split(t, -(-len(t) // MAX_WIDTH))
    for piece in parts:
        v = space.basis[piece].sum(axis=0)
        if norm := float(np.linalg.norm(v)):
            pieces.append((_width(len(piece)), v / norm, least_cosine(piece, v / norm, space, chances, rng)))
    return Item(item, w.hash, _width(len(parts[0])), pieces, rare, need, keys, least_keys, _run_keys(w.hash[-ANSWER:])[0])


def _chances(space: Space) -> np.ndarray:
    chances = np.cumsum((np.ones(TERMS) if space.occurs is None else space.occurs) + 1e-9)
    return chances / chances[-1]


def _lists(pairs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct words, where each word's stretch begins, numbers of items in the order of the stretches)."""
    if not pairs:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int64)
    words, of = np.concatenate([w for w, _ in pairs]), np.repeat([i for _, i in pairs], [len(w) for w, _ in pairs])
    order = np.argsort(words, kind="stable")
    words, of = words[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return words[first], np.append(first, len(words)), of


def gather(items: list[Item]) -> Items:
    keys, answers = _lists([(x.keys, i) for i, x in enumerate(items)]), _lists([(np.array([x.answer], np.uint64), i) for i, x in enumerate(items)])
    met = np.zeros(1 << max(16, (16 * len(keys[0])).bit_length()), bool)
    met[(keys[0] & np.uint64(len(met) - 1)).astype(np.int64)] = True
    return Items(items, np.array([x.least for x in items], np.int64), np.array([x.width + 2 * x.reach for x in items], np.int64), met, keys, answers)


def prepare_items(rows: list[tuple[int, str]], space: Space) -> Items:
    chances = _chances(space)
    return gather([x for i, t in rows if (x := prepare_item(i, t, space, chances)) is not None])


def _stretches(found: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``found``, number of an item) for all items that the words of ``found`` lead to."""
    words, first, of = lists
    if not len(words) or not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    place = np.flatnonzero(words[at] == found)
    at = at[place]
    n = first[at + 1] - first[at]
    return np.repeat(place, n), of[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _union(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers in any of the stretches low .. high - 1, sorted; stretches come sorted by low."""
    low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1]]))
    n = np.maximum(0, high - low)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def search(texts: pa.Array, space: Space, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, common words) of the best passage of each text and item that is accepted."""
    w = tk.words(texts, folded=True)
    if not len(w.hash):
        return []
    n = np.diff(w.bounds)
    blocks = -(-n // STEP)
    first_block = np.cumsum(blocks) - blocks
    begin = np.repeat(w.bounds[:-1], blocks) + STEP * (np.arange(blocks.sum()) - np.repeat(first_block, blocks))
    doc = np.repeat(np.arange(len(n)), blocks)
    last = (first_block + blocks)[doc]
    candidates: list[tuple[Item, np.ndarray, np.ndarray]] = []

    def windows_with(x: Item, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Windows of the item whose compared words hold all words low .. high - 1 of one text."""
        b = (lambda d: first_block[d] + (low - w.bounds[d]) // STEP)(np.searchsorted(w.bounds, low, "right") - 1)
        d = doc[b]
        # begin - reach <= low and high <= begin + width + reach; begin is a multiple of STEP in its text
        lo = first_block[d] + np.maximum(0, -((w.bounds[d] + x.width + x.reach - high) // STEP))
        hi = first_block[d] + np.minimum(blocks[d], (low + x.reach - w.bounds[d]) // STEP + 1)
        return _union(lo, hi)

    def compare(x: Item, at: np.ndarray, need: int) -> None:
        if need > 0 and len(at):  # candidates without enough of the item's rarer words can't be accepted
            low, high = np.maximum(w.bounds[doc[at]], begin[at] - x.reach), np.minimum(w.bounds[doc[at] + 1], begin[at] + x.width + x.reach)
            start = int(low.min())
            held = np.concatenate([[0], np.cumsum(np.isin(w.hash[start : int(high.max())], x.rare))])
            at = at[held[high - start] - held[low - start] >= need]
        if len(at):
            candidates.append((x, np.maximum(w.bounds[doc[at]], begin[at] - x.reach), np.minimum(w.bounds[doc[at] + 1], begin[at] + x.width + x.reach)))

    def near(x: Item, at: np.ndarray) -> np.ndarray:
        """Those of the windows that reach a threshold of the item by their cosine."""
        yes = np.zeros(len(at), bool)
        for width, vector, least in x.pieces:
            for lo in range(0, len(at), _AT_ONCE):
                part = at[lo : lo + _AT_ONCE]
                word = begin[part][:, None] + np.arange(width)
                term = np.where(word < w.bounds[doc[part] + 1][:, None], (w.hash[np.minimum(word, len(w.hash) - 1)] % np.uint64(TERMS)).astype(np.int64), TERMS)
                window = _summed_rows(basis, term)
                yes[lo : lo + _AT_ONCE] |= window @ vector.astype(np.float32) >= least * np.maximum(np.linalg.norm(window, axis=1), 1e-9)
        return at[yes]

    basis = space.padded
    hit = np.flatnonzero(items.met[(w.hash & np.uint64(len(items.met) - 1)).astype(np.int64)])
    place, of = _stretches(w.hash[hit], items.keys)
    place = hit[place]
    order = np.argsort(of * len(w.hash) + place)
    place, of = place[order], of[order]
    other = np.arange(len(of)) + items.least[of] - 1  # the last of as many words as the item asks for
    low = np.flatnonzero(other < len(of))
    high = other[low]
    close = (of[low] == of[high]) & (place[high] - place[low] < items.extent[of[low]])
    low, high = low[close], high[close]
    same = np.searchsorted(w.bounds, place[low], "right") == np.searchsorted(w.bounds, place[high], "right")
    low, high = low[same], high[same]
    starts = np.flatnonzero(np.concatenate([[True], of[low[1:]] != of[low[:-1]]])) if len(low) else np.empty(0, np.int64)
    for s, e in zip(starts.tolist(), np.append(starts, len(low))[1:].tolist(), strict=True):
        x = items.items[of[low[s]]]
        compare(x, near(x, windows_with(x, place[low[s:e]], place[high[s:e]] + 1)), x.need)
    run = _run_keys(w.hash)
    place, of = _stretches(run, items.answers)
    inside = place + ANSWER <= w.bounds[np.searchsorted(w.bounds, place, "right")]
    for i in tk.distinct(of[inside]).tolist():  # all windows whose compared words hold the answer
        x = items.items[i]
        p = place[inside & (of == i)]
        fewer = math.ceil(SHARE * len(x.words)) - math.ceil(LOW_SHARE * len(x.words))  # words that LOW_SHARE asks less than SHARE
        compare(x, windows_with(x, p, p + ANSWER), x.need - fewer)
    return keep_best(w, candidates)


def common_words(words: np.ndarray, of: list[tuple[Item, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (item, low, high): the longest common subsequences of the item and the words low .. high - 1.

    lcs() for all windows of all items at once, one word of every window after another; items of more words than a
    machine word has bits go one by one.
    """
    out = [np.array([lcs(x.words.tolist(), words[a:b].tolist()) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.int64) if len(x.words) > 64 else None for x, low, high in of]
    short = [k for k, o in enumerate(out) if o is None]
    if not short:
        return out
    n = np.concatenate([of[k][2] - of[k][1] for k in short])
    masks = np.zeros((int(n.max()), len(n)), np.uint64)
    at = 0
    for k in short:
        x, low, high = of[k]
        names, inverse = np.unique(x.words, return_inverse=True)
        bits = np.zeros(len(names) + 1, np.uint64)
        np.bitwise_or.at(bits, inverse, np.uint64(1) << np.arange(len(x.words), dtype=np.uint64))
        place = low + np.arange(int((high - low).max()))[:, None]
        text = words[np.minimum(place, len(words) - 1)]
        found = np.minimum(np.searchsorted(names, text), len(names) - 1)
        masks[: len(place), at : at + len(low)] = bits[np.where((names[found] == text) & (place < high), found, len(names))]
        at += len(low)
    row = np.full(len(n), ~np.uint64(0))
    for m in masks:
        u = row & m
        row = (row + u) | (row - u)
    size = np.repeat([len(of[k][0].words) for k in short], [len(of[k][1]) for k in short])
    full = ~np.uint64(0) >> (np.uint64(64) - size.astype(np.uint64))
    ends = np.cumsum([len(of[k][1]) for k in short])
    for k, part in zip(short, np.split(np.bitwise_count(~row & full).astype(np.int64), ends[:-1]), strict=True):
        out[k] = part
    return out


def keep_best(w: tk.Words, of: list[tuple[Item, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, common words) of the best passage accepted, of each text and item, among those given."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    groups: list[list[tuple[Item, np.ndarray, np.ndarray]]] = [[]]
    size = 0
    for x, low, high in of:
        for k in range(0, len(low), _COMPARED):
            if size > _COMPARED:
                groups.append([])
                size = 0
            groups[-1].append((x, low[k : k + _COMPARED], high[k : k + _COMPARED]))
            size += len(groups[-1][-1][1])
    for (x, low, high), common in ((y, c) for g in groups for y, c in zip(g, common_words(w.hash, g), strict=True)):
        n, answer = len(x.words), x.words[-ANSWER:].tolist()
        for i in np.flatnonzero(common >= LOW_SHARE * n).tolist():
            a, c = int(low[i]), int(common[i])
            if c >= SHARE * n or has_run(answer, w.hash[a : high[i]].tolist()):
                d = int(np.searchsorted(w.bounds, a, "right")) - 1
                now = best.get((d, x.id))
                if now is None or (-c, a) < (-now[0], now[1]):
                    best[d, x.id] = c, a
    return [(d, i, low - int(w.bounds[d]), common) for (d, i), (common, low) in sorted(best.items())]


def _chunks(docs: DataFrame, benchmark: DataFrame) -> Iterator[object]:
    """Broadcast (space, items), one for each chunk of the benchmark."""
    space = latent_space(docs.select("text").where("text IS NOT NULL"))
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(space)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = _chances(sent.value)
        for batch in batches:
            made = [prepare_item(i, t, sent.value, chances) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x.words) for x in made if x], pa.int64()), pa.array([pickle.dumps(x) for x in made if x], pa.binary())], names=["n", "item"])

    chosen = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    held: list[Item] = []
    words = 0
    for r in cut(chosen.mapInArrow(prepare, "n long, item binary")).toLocalIterator():
        if held and (len(held) == ITEMS or words + r["n"] > ITEM_WORDS):
            yield sc.broadcast((space, gather(held)))
            held, words = [], 0
        held.append(pickle.loads(r["item"]))
        words += r["n"]
    if held:
        yield sc.broadcast((space, gather(held)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, common_words): documents that hold a benchmark item, or most of one.

    start_word is where the compared words begin, common_words the length of the longest common subsequence; there is
    one row for each document and item, the best passage. Null texts, null item ids, null items and items of fewer than
    ANSWER words match nothing; a null doc_id gives rows with a null id; rows that repeat an id or a text are searched
    each. Very long texts and items are searched whole. Other columns are not read. Empty tables give no rows.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    out = None
    for sent in _chunks(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.slices(batch, limit=_SLICE):
                    found = search(part.column("text"), *sent.value)
                    d, i, s, c = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(i), pa.array(s), pa.array(c)], names=["doc_id", "item_id", "start_word", "common_words"])

        part = chosen.mapInArrow(run, "doc_id long, item_id long, start_word long, common_words long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, common_words long")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, without those that contaminated() reports."""
    out = docs
    for sent in _chunks(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.slices(batch, limit=_SLICE):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in search(part.column("text"), *sent.value)]] = False
                    yield part.filter(pa.array(keep))

        out = map_rows(out, run)
    return out
