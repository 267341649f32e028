"""Toxicity by a support vector machine over the string subsequence kernel.

The kernel of two words is the sum, over all subsequences of three characters, gaps allowed, of the products of their
weights DECAY ** (stretch of the subsequence) in either word, normalised (Lodhi et al. 2002). A word is taken with a
mark at both ends. A missing or an inserted character so only costs the subsequences that it cuts or stretches.

Units of a text are its words; its space-free runs with inner punctuation taken out ("id-iot"); three or more single
characters in a row, joined ("i d i o t"); and its pairs of neighbouring words, for insults that only a phrase makes.
The kernel of two pairs is the mean of the kernels of their first and of their second words. A sentence is as toxic as
its worst unit and a text as its worst sentence, as in multiple-instance learning.

``fit`` learns from at most ``per_class`` labelled documents of either class. Which unit makes a labelled text toxic
isn't given. First guesses, the witnesses, are units of toxic texts in many different contexts and hardly ever in clean
ones; copies of one document share their contexts and so don't make witnesses. Linear machines, one for single units and
one for pairs, are then trained on Nyström features: kernels with landmarks (witnesses and the clean units nearest to
them), whitened by the landmarks' own kernel matrix. Every labelled text takes part as it is labelled: round by round a
toxic text that a machine can explain adds its worst unit to the positives, with the text's weight, and the worst units
of clean texts join the negatives. Witnesses with characters inserted are further positives. Pairs are learned from the
toxic texts that no single unit explains; where these have no witness, the likeliest pair of each is the first guess.
The threshold rejects at most WRONG of the clean labelled texts.

The decision is linear in the kernel's feature space, so that all landmarks collapse into one weight for each three
characters, and a unit is scored by the sum over its own subsequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import map_rows

DECAY = 0.6
#: Longer units are scored in overlapping windows of so many characters, of which two are the marks at its ends.
WIDTH = 24
ROOM = WIDTH - 2
PER_CLASS = 1500
#: Landmarks of either machine. Witnesses are taken first, evenly where there are more.
LANDMARKS = 160
#: Clean units that a machine trains on at first: those nearest to the witnesses, and others by chance; those that are
#: added in a round; and the rounds.
NEAR, DRAWN, HARD, ROUNDS = 800, 1200, 400, 3
#: Cost of an error with a witness, with a varied witness and with a clean unit; copies of a witness with a character inserted.
COSTS, VARIED = (200.0, 20.0, 20.0), 4
#: Share of the clean labelled texts that the threshold may reject.
WRONG = 0.02
A = 64
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:] = 39 + np.arange(128) % 25
_CODE[0xC2:0xF5] = 0  # lead bytes say nothing; the byte after them tells the letter
BEGIN, END = 37, 38


def _triples(n: int) -> Iterator[tuple[int, int, int]]:
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            for k in range(j + 1, n):
                yield i, j, k


def linear(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the subsequences of each row of ``codes`` of their weight in it times their row of ``weights``."""
    cols = codes.T.astype(np.int64)
    out = np.zeros((codes.shape[0], *weights.shape[1:]))
    n = len(cols)
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            ij = cols[i] * (A * A) + cols[j] * A
            for k in range(j + 1, n):
                out += DECAY ** (k - i + 1) * weights[ij + cols[k]]
    return out


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by Lodhi's recurrence."""
    rows, n = codes.shape
    same = [[codes[:, a] == codes[:, b] for b in range(n)] for a in range(n)]
    prime = np.ones((n + 1, n + 1, rows))
    for level in range(1, 3):
        nxt = np.zeros((n + 1, n + 1, rows))
        for a in range(level, n + 1):
            run = np.zeros(rows)
            for b in range(level, n + 1):
                run = DECAY * run + np.where(same[a - 1][b - 1], DECAY**2 * prime[a - 1, b - 1], 0)
                nxt[a, b] = DECAY * nxt[a - 1, b] + run
        prime = nxt
    out = np.zeros(rows)
    for a in range(3, n + 1):
        for b in range(3, n + 1):
            out += np.where(same[a - 1][b - 1], DECAY**2 * prime[a - 1, b - 1], 0)
    return out


def score_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """The product of the weights with the normalised features of each span of folded bytes, ``floor`` at least.

    Spans over WIDTH characters count by the best of their overlapping windows; spans under two characters have the
    floor. ``weights`` may have several columns, and so has the result then.
    """
    out = np.full((len(start), *weights.shape[1:]), floor)
    codes = _CODE[data]
    kept = np.concatenate([[0], np.cumsum(codes > 0)])
    codes, first, size = codes[codes > 0], kept[start], kept[end] - kept[start]
    of, at, n = [], [], []
    short = np.flatnonzero((size >= 2) & (size <= ROOM))
    of.append(short), at.append(first[short]), n.append(size[short])
    for i in np.flatnonzero(size > ROOM).tolist():
        places = _windows(int(size[i]))
        of.append(np.full(len(places), i)), at.append(first[i] + places), n.append(np.full(len(places), ROOM))
    of, at, n = np.concatenate(of), np.concatenate(at), np.concatenate(n)
    for size_ in np.unique(n).tolist():
        group = np.flatnonzero(n == size_)
        step = max(64, 1_500_000 // (size_ + 2) ** 2)  # self_kernel holds two arrays of this many values
        for low in range(0, len(group), step):
            g = group[low : low + step]
            c = np.empty((len(g), size_ + 2), np.uint8)
            c[:, 0], c[:, -1] = BEGIN, END
            c[:, 1:-1] = codes[at[g][:, None] + np.arange(size_)]
            value = linear(c, weights)
            some = np.flatnonzero((value > floor) if value.ndim == 1 else (value != 0).any(axis=1))  # else the norm doesn't matter
            if len(some):
                norm = np.sqrt(self_kernel(c[some]))
                value[some] /= norm if value.ndim == 1 else norm[:, None]
            np.maximum.at(out, of[g], value)
    return out


def _windows(size: int) -> np.ndarray:
    """Where the overlapping windows of a unit of so many characters begin."""
    return np.unique(np.append(np.arange(0, max(1, size - ROOM), WIDTH // 2), max(0, size - ROOM)))


def windows(unit: bytes) -> list[bytes]:
    """The unit, or its overlapping windows where it is long, without characters that say nothing."""
    raw = np.frombuffer(unit, np.uint8)
    raw = raw[_CODE[raw] > 0]
    return [raw[a : a + ROOM].tobytes() for a in _windows(len(raw)).tolist()]


def score_units(units: list[bytes], weights: np.ndarray, floor: float = 0.0) -> np.ndarray:
    ends = np.cumsum([len(u) for u in units], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if units else ends
    return score_spans(np.frombuffer(b"".join(units), np.uint8), starts, ends, weights, floor)


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    ijk = np.array(list(_triples(n))).T
    return ijk, DECAY ** (ijk[2] - ijk[0] + 1.0)


def tensor(unit: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The normalised feature vector of one unit of at most ROOM characters: places and values."""
    c = _CODE[np.frombuffer(unit, np.uint8)]
    c = np.concatenate([[BEGIN], c[c > 0], [END]]).astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0)
    (i, j, k), v = _places(len(c))
    places, inverse = np.unique(c[i] * A * A + c[j] * A + c[k], return_inverse=True)
    values = np.bincount(inverse, v)
    return places, values / np.linalg.norm(values)


def kernel(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The kernel matrix of two lists of feature vectors."""
    known = np.unique(np.concatenate([p for p, _ in b]))
    column = np.full(A**3, len(known))
    column[known] = np.arange(len(known))
    dense = np.zeros((len(known) + 1, len(b)))
    for j, (p, v) in enumerate(b):
        dense[column[p], j] = v
    return np.stack([v @ dense[column[p]] for p, v in a])


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the rows that violate the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(z), bool)
    for _ in range(rounds):
        za = z[active] * cost[active, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


@dataclass
class Units:
    """Units but pairs of several texts: a hash, the place in ``data`` and the text of each, in the order of the texts.

    ``word`` is the number of the word that a unit begins with; ``single`` tells words from what is joined.
    """

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    single: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the first and of the second units of all pairs of neighbouring words of a text."""
        return _neighbours(self.doc, self.single)

    def bytes(self, i: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.start[i].tolist(), self.end[i].tolist(), strict=True)]


def units(texts: pa.Array) -> Units:
    w = tk.words(texts, folded=True)
    data, found = w.data, [(w.start, w.end, w.hash, w.doc, np.arange(len(w.hash)), np.ones(len(w.hash), bool))]
    # space-free runs without their inner punctuation; only those of two or more words are new
    inside = tk.WORD[data]
    if len(w.hash) > 1:
        doc = w.doc
        gap_spaces = np.cumsum(tk.SPACE[data]).astype(np.int64)
        before = np.concatenate([[0], gap_spaces])
        spaced = before[w.start[1:]] - before[w.end[:-1]]
        near = (doc[1:] == doc[:-1]) & (spaced == 0)
        one = (w.end - w.start) == 1
        lone = (doc[1:] == doc[:-1]) & one[1:] & one[:-1] & (spaced <= 1)
        for link, least in ((near, 2), (lone, 3)):
            new = np.concatenate([[True], ~link])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(w.hash)))
            first, n = first[n >= least], n[n >= least]
            if not len(first):
                continue
            pieces = [data[s:e][inside[s:e]] for s, e in zip(w.start[first].tolist(), w.end[first + n - 1].tolist(), strict=True)]
            sizes = np.array([len(p) for p in pieces])
            joined = np.concatenate(pieces)
            ends = np.cumsum(sizes)
            h = tk.span_hash(joined, ends - sizes, ends)
            found.append((ends - sizes + len(data), ends + len(data), h, doc[first], first, np.zeros(len(first), bool)))
            data = np.concatenate([data, joined])
    start, end, h, doc, word, single = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(doc, kind="stable")
    return Units(data, h[order], start[order], end[order], doc[order], word[order], single[order])


def units_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The units of many texts, found in small slices, without their places: (names, strings, of, doc, single).

    ``names`` are the hashes of the distinct units in order and ``strings`` these units; each unit has the place of its
    name, its text and whether it is a word. So the driver holds about 13 bytes a unit.
    """
    strings: dict[int, bytes] = {}
    names, parts, docs = np.empty(0, np.uint64), [], 0
    batches = (pa.record_batch({"text": pa.array(texts[low : low + 64], pa.string())}) for low in range(0, len(texts), 64))
    for piece in (part for batch in batches for part in tk.slices(batch, limit=tk.SLICE_BYTES // 4)):
        u = units(piece.column("text"))
        own, at = np.unique(u.hash, return_index=True)
        new = ~np.isin(own, names)
        strings.update(zip(own[new].tolist(), u.bytes(at[new]), strict=True))
        names = np.union1d(names, own[new])
        parts.append((u.hash, (u.doc + docs).astype(np.int32), u.single))
        docs += piece.num_rows
    doc, single = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    of = np.concatenate([np.searchsorted(names, p[0]).astype(np.int32) for p in parts])
    return names, [strings[n] for n in names.tolist()], of, doc, single


def _neighbours(doc: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first and of the second units of all pairs of neighbouring words of a text."""
    at = np.flatnonzero(single)
    same = doc[at[1:]] == doc[at[:-1]]
    return at[:-1][same], at[1:][same]


@dataclass
class Model:
    """``weights`` has a column for single units and one for the first and the second words of pairs; -9 as the bias of
    pairs means that there is no machine for them."""

    weights: np.ndarray
    bias: float
    pair_bias: float
    threshold: float

    @property
    def used(self) -> np.ndarray:
        return self.weights[:, 0] if self.pair_bias == -9.0 else self.weights


def _distinct(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each a under n, how many different b there are with it."""
    if not len(a):
        return np.zeros(n, np.int64)
    _, first = np.unique(tk.mix(a.astype(np.uint64) ^ tk.mix(b.astype(np.uint64), 21), 22), return_index=True)
    return np.bincount(a[first], minlength=n)


def _witnesses(names: np.ndarray, doc: np.ndarray, context: np.ndarray, toxic: np.ndarray, clean: np.ndarray, covered: np.ndarray, sure: bool) -> np.ndarray:
    """Hashes of the witnesses among units of these names, which stand in these texts and contexts; texts with one become covered.

    Sure ones are those that are very unlikely to be in toxic texts only by chance; else each that is in three or more
    texts not yet covered, and hardly ever in clean ones, is taken, in the order of how many it covers.
    """
    is_tox, is_clean = toxic[doc], clean[doc]
    n_tox, n_clean = max(1, int(toxic.sum())), max(1, int(clean.sum()))
    vocabulary, index = np.unique(names, return_inverse=True)
    size = len(vocabulary)
    support = np.minimum(_distinct(index[is_tox], context[is_tox], size), _distinct(index[is_tox], doc[is_tox], size))
    known = _distinct(index[is_clean], doc[is_clean], size)
    pure = (support >= 3) & (support >= 20 * known * n_tox / n_clean) & (known <= 0.002 * n_clean + 0.05 * support)
    # the chance that ``support`` holders of a unit are all toxic, against the size of the vocabulary
    chance = support * math.log(n_tox / (n_tox + n_clean))
    likely = pure & (chance < math.log(1e-6 / max(1, size)))
    own = is_tox & pure[index]
    cw, cd, ctx = index[own], doc[own], context[own]
    if sure:
        covered[cd[likely[cw]]] = True
        return vocabulary[likely]
    chosen: list[int] = []
    while True:
        open_ = ~covered[cd]
        gain = np.minimum(_distinct(cw[open_], ctx[open_], size), _distinct(cw[open_], cd[open_], size))
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] < 3:
            return vocabulary[sorted(chosen)]
        chosen.append(best)
        covered[cd[cw == best]] = True


#: A unit, as one string, or a pair, as two.
Parts = tuple[bytes, ...]


def _collapse(alpha: np.ndarray, vectors: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """The weights of each part from the landmarks' factors."""
    weights = np.zeros((A**3, len(vectors)))
    for k, landmarks in enumerate(vectors):
        for a, (p, v) in zip(alpha, landmarks, strict=True):
            weights[p, k] += a * v
    return weights


class Machine:
    """A linear machine over units of one or two parts; the value of a unit is the mean over its parts, plus the bias.

    ``pool`` are the clean units; the parts of all are at most ROOM characters long.
    """

    def __init__(self, witnesses: list[Parts], pool: list[Parts], rng: np.random.Generator) -> None:
        self.witnesses, self.pool, self.rng, self.parts = witnesses, pool, rng, len(witnesses[0])
        self.vectors = [self._vectors(w) for w in witnesses]
        self.varied = [self._vectors(v) for w in witnesses for v in self._vary(w)]
        self.weights = np.zeros((A**3, self.parts))
        for v in self.vectors:
            for k, (p, x) in enumerate(v):
                self.weights[p, k] += x / len(witnesses)
        self.bias = -0.5
        near = np.argsort(-self.values(pool), kind="stable")
        even = np.unique(np.linspace(0, len(witnesses) - 1, min(LANDMARKS, len(witnesses))).astype(int))
        self.landmarks = [self.vectors[i] for i in even] + [self._vectors(pool[i]) for i in near[: max(40, LANDMARKS - len(witnesses))]]
        values, basis = np.linalg.eigh(self._kernel(self.landmarks))
        good = values > 1e-6 * values[-1]
        self.whiten = basis[:, good] / np.sqrt(values[good])
        self.negatives = dict.fromkeys([*near[:NEAR].tolist(), *rng.permutation(len(pool))[:DRAWN].tolist()])
        self.found: list[tuple[list, float]] = []

    def _vectors(self, unit: Parts) -> list[tuple[np.ndarray, np.ndarray]]:
        return [tensor(p) for p in unit]

    def _vary(self, unit: Parts) -> Iterator[Parts]:
        letters = np.frombuffer(b"aeiounrtlsx1", np.uint8)
        for n in range(VARIED):
            part = n % len(unit)
            p = unit[part]
            k = int(self.rng.integers(1, len(p))) if len(p) > 1 else 1
            yield (*unit[:part], windows(p[:k] + bytes([int(self.rng.choice(letters))]) + p[k:])[0], *unit[part + 1 :])

    def _kernel(self, units: list) -> np.ndarray:
        return sum(kernel([u[k] for u in units], [x[k] for x in self.landmarks]) for k in range(self.parts)) / self.parts

    def values(self, units: list[Parts]) -> np.ndarray:
        if not units:
            return np.empty(0)
        return sum(score_units([u[k] for u in units], self.weights[:, k], -9.0) for k in range(self.parts)) / self.parts + self.bias

    def train(self) -> None:
        neg = [self._vectors(self.pool[i]) for i in self.negatives]
        x = self._kernel([*self.vectors, *self.varied, *(u for u, _ in self.found), *neg]) @ self.whiten
        y = np.concatenate([np.ones(len(x) - len(neg)), -np.ones(len(neg))])
        cost = np.concatenate([np.full(len(self.vectors), COSTS[0]), np.full(len(self.varied), COSTS[1]), [c for _, c in self.found], np.full(len(neg), COSTS[2])])
        w, self.bias = squared_hinge(x, y, cost)
        self.weights = _collapse(self.whiten @ w, [[u[k] for u in self.landmarks] for k in range(self.parts)])

    def add_clean(self) -> bool:
        """The worst clean units join the negatives; false if all have."""
        before = len(self.negatives)
        self.negatives |= dict.fromkeys(np.argsort(-self.values(self.pool), kind="stable")[:HARD].tolist())
        return len(self.negatives) > before

    def explain(self, worst: list[tuple[Parts, int]]) -> None:
        """Units that make toxic texts toxic, by the machine as it is, and how many texts they do so."""
        self.found = [(self._vectors(u), COSTS[2] * n) for u, n in worst]


def _explanations(values: np.ndarray, doc: np.ndarray, toxic: np.ndarray, name: np.ndarray) -> list[tuple[int, int]]:
    """(place of a unit, number of toxic texts): the worst unit of every toxic text whose value is positive."""
    order = np.lexsort((-values, doc))
    first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
    first = first[toxic[doc[first]] & (values[first] > 0)]
    _, at, n = np.unique(name[first], return_index=True, return_counts=True)
    return list(zip(first[at].tolist(), n.tolist(), strict=True))


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model:
    """The machines from labelled texts. Without an example of both classes there is nothing to learn, and nothing is rejected.

    Of equal texts with different labels the toxic one counts.
    """
    toxic = np.asarray(toxic, bool)
    label: dict[str, bool] = {}
    for t, bad in zip(texts, toxic.tolist(), strict=True):
        label[t] = label.get(t, False) or bad
    texts, toxic = list(label), np.array(list(label.values()), bool)
    model = Model(np.zeros((A**3, 3)), -9.0, -9.0, 0.0)
    if not toxic.any() or toxic.all():
        return model
    rng = np.random.default_rng(seed)
    names, strings, inverse, unit_doc, single = units_of(texts)
    clean = ~toxic
    context = np.zeros(len(inverse), np.uint64)
    context[1:] = np.where(unit_doc[1:] == unit_doc[:-1], names[inverse[:-1]], 0)
    worst = np.full(len(texts), -9.0)

    def pieces(unit: bytes) -> list[Parts]:
        return [(p,) for p in windows(unit)]

    # sure words first, then sure pairs for what these leave open, and less sure words only for the rest
    left, right = _neighbours(unit_doc, single)
    pair = tk.mix(names[inverse[left]] * np.uint64(3) ^ tk.mix(names[inverse[right]], 31), 32)
    doc, covered = unit_doc[left], np.zeros(len(texts), bool)
    chosen = _witnesses(names[inverse], unit_doc, context, toxic, clean, covered, True)
    chosen_pairs = _witnesses(pair, doc, context[left], toxic & ~covered, clean, covered, True)
    chosen = np.unique(np.concatenate([chosen, _witnesses(names[inverse], unit_doc, context, toxic, clean, covered, False)]))
    if len(chosen):
        good = np.searchsorted(names, chosen)
        seen_clean = np.zeros(len(names), bool)
        seen_clean[inverse[clean[unit_doc]]] = True
        seen_clean[good] = False
        pool = list(dict.fromkeys(p for i in np.flatnonzero(seen_clean).tolist() for p in pieces(strings[i])))
        m = Machine([p for i in good.tolist() for p in pieces(strings[i])], pool, rng)
        for _ in range(ROUNDS):
            m.train()
            value = score_units(strings, m.weights[:, 0], 0.0) + m.bias
            m.explain([(pieces(strings[inverse[i]])[0], n) for i, n in _explanations(value[inverse], unit_doc, toxic, inverse)])
            if not m.add_clean():
                break
        model.weights[:, 0], model.bias = m.weights[:, 0], m.bias
        np.maximum.at(worst, unit_doc, score_units(strings, m.weights[:, 0], 0.0)[inverse] + m.bias)
    open_ = toxic & (worst <= 0)
    if open_.sum() >= 3 and len(left):
        pair_names, pair_at, pair_of = np.unique(pair, return_index=True, return_inverse=True)
        chosen = np.searchsorted(pair_names, chosen_pairs)
        if not len(chosen) and model.bias == -9.0:  # no witness at all: the likeliest pair of each text
            odds = np.log1p(_distinct(pair_of[open_[doc]], doc[open_[doc]], len(pair_names))) - np.log1p(_distinct(pair_of[clean[doc]], doc[clean[doc]], len(pair_names)))
            chosen = np.unique([pair_of[i] for i, _ in _explanations(odds[pair_of] + 1e-9, doc, open_, pair_of)]).astype(np.int64)
        both = lambda i: tuple(windows(strings[inverse[x[pair_at[i]]]])[0] for x in (left, right))
        seen_clean = np.zeros(len(pair_names), bool)
        seen_clean[pair_of[clean[doc]]] = True
        seen_clean[chosen] = False
        pool_at = np.flatnonzero(seen_clean)
        if len(chosen) and len(pool_at):
            m = Machine([both(i) for i in chosen.tolist()], [both(i) for i in pool_at.tolist()], rng)
            for _ in range(ROUNDS):
                m.train()
                value = _pair_values(score_units(strings, m.weights), inverse[left], inverse[right], m.bias)
                m.explain([(both(pair_of[i]), n) for i, n in _explanations(value, doc, open_, pair_of)])
                if not m.add_clean():
                    break
            model.weights[:, 1:], model.pair_bias = m.weights, m.bias
            np.maximum.at(worst, doc, _pair_values(score_units(strings, m.weights), inverse[left], inverse[right], m.bias))
    # the threshold with the best F1 over the labelled texts within WRONG, as far from either class as it can be
    order = np.argsort(-worst, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    f1[np.arange(1, len(order) + 1) - hits > max(1, WRONG * clean.sum())] = 0
    best = int(np.argmax(f1))
    below = worst[order[best + 1]] if best + 1 < len(order) else worst[order[best]] - 1
    model.threshold = float((worst[order[best]] + below) / 2)
    return model


def _pair_values(values: np.ndarray, first: np.ndarray, second: np.ndarray, bias: float) -> np.ndarray:
    return (values[first, 0] + values[second, 1]) / 2 + bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on the at most ``per_class`` labelled documents of either class that come first by the hash of their id."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = [marked.where(F.col("toxic") > 0 if t else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (1, 0)]
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(of[0].unionByName(of[1])), "doc_id")
    rows = chosen.select("doc_id", "text", "toxic").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in rows], np.array([r["toxic"] > 0 for r in rows], bool))


class Scorer:
    """Scores texts by the worst unit; a worker keeps the values of the units it has met."""

    KEPT = 3_000_000

    def __init__(self, model: Model) -> None:
        self.model, self.keys = model, np.empty(0, np.uint64)
        self.weights = model.used
        self.values = np.empty((0, *self.weights.shape[1:]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, worst unit's first word's number in its text); -9 and -1 for a text without a unit."""
        u = units(texts)
        n = len(texts)
        score, word = np.full(n, -9.0), np.full(n, -1)
        if not len(u.hash):
            return score, word
        names, at, inverse = np.unique(u.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, names), max(0, len(self.keys) - 1))
        known = self.keys[place] == names if len(self.keys) else np.zeros(len(names), bool)
        value = np.empty((len(names), *self.weights.shape[1:]))
        value[known] = self.values[place[known]]
        fresh = at[~known]
        value[~known] = score_spans(u.data, u.start[fresh], u.end[fresh], self.weights)
        if not known.all():
            keys, values = (names, value) if len(self.keys) > self.KEPT else (np.concatenate([self.keys, names[~known]]), np.concatenate([self.values, value[~known]]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
        pairs = value.ndim == 2
        each = (value[:, 0] if pairs else value)[inverse] + self.model.bias
        doc, begins = u.doc, u.word
        if pairs:
            left, right = u.pairs()
            each = np.concatenate([each, _pair_values(value[:, 1:], inverse[left], inverse[right], self.model.pair_bias)])
            doc, begins = np.concatenate([doc, doc[left]]), np.concatenate([begins, begins[left]])
        np.maximum.at(score, doc, each)
        top = np.flatnonzero(each == score[doc])
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, doc[top], begins[top])
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, u.doc, u.word)
        some = score > -9.0
        word[some] = least[some] - first[some]
        return score, word


def _score(docs: DataFrame, model: Model, keep_toxic: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in tk.slices(batch, limit=2 * tk.SLICE_BYTES):
                score, word = scorer(part.column("text"))
                bad = score > sent.value.threshold
                if keep_toxic:
                    keep = pa.array(bad)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(keep), pa.array(np.round(score[bad], 6)), pa.array(word[bad])], names=["doc_id", "score", "worst_word"])
                else:
                    yield part.filter(pa.array(~bad))

    if not keep_toxic:
        return map_rows(docs, run)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_word long")


def toxic_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, worst_word): the documents that the machine rejects; worst_word counts folded words from 0.

    Null, empty and wordless texts are never rejected; ties go to the first of the worst words; a score that equals the
    threshold is not rejected. Labels of one class only reject nothing. Rows that repeat an id or a text get one row each. Very long
    texts are read whole. Labels with a null are not used; contradicting labels of an id count as toxic. Other columns
    are not read. Empty tables give no rows.
    """
    model = fit(docs, labels, per_class)
    return _score(docs, model, True)


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents without those that toxic_documents has, with all their columns."""
    return _score(docs, fit(docs, labels, per_class), False)
