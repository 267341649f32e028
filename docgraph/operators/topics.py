"""Latent Dirichlet allocation with a vocabulary of any size: no table of words is in one place, the driver's least of all.

Online variational Bayes as in pyspark.ml's LDA, with its defaults (Hoffman, Blei and Bach 2010). A word goes by its 64-bit
hash. Its weight in a topic is A * (draw + S) + E: the draw comes from the hash, A and E are the same for all words, and S,
what the texts have added so far, is a row of a table for the words that have been in a sample. Texts are held in blocks
with the list of their different words; a block is joined to the rows of its words and worked on in one call.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.operators.lineage import cut

#: Words, with repeats, to a block, if no text is longer.
BLOCK = 1_000_000
FRACTION, TAU, KAPPA, SHAPE = 0.05, 1024, 0.51, 100.0


def mixed(x: np.ndarray, *salts: int) -> np.ndarray:
    """64 bits for each number, others for other salts (splitmix64)."""
    z = x.view(np.uint64)
    for s in (*salts, 0):
        z = z + np.array([(s + 1) * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def uniform(x: np.ndarray, *salts: int) -> np.ndarray:
    """In (0, 1), for each number."""
    return ((mixed(x, *salts) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def draws(words: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """(words, topics): a gamma variate of shape 100 and mean 1 for each word and topic (Marsaglia and Tsang)."""
    d = SHAPE - 1 / 3
    out = np.zeros((len(words), topics))
    for k in range(topics):
        left, turn = np.arange(len(words)), 0
        while len(left):
            h = words[left]
            x = np.sqrt(-2 * np.log(uniform(h, seed, k, turn, 0))) * np.cos(2 * np.pi * uniform(h, seed, k, turn, 1))
            v = np.maximum(1 + x / np.sqrt(9 * d), 1e-9) ** 3
            good = np.log(uniform(h, seed, k, turn, 2)) < 0.5 * x**2 + d - d * v + d * np.log(v)
            out[left[good], k] = d * v[good] / SHAPE
            left, turn = left[~good], turn + 1
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    z = 1 / y**2
    out = np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    for i in range(8):
        out = out - 1 / (x + i)
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    z = 1 / y**2
    out = 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
    for i in range(8):
        out = out + 1 / (x + i) ** 2
    return out


def expectation(x: np.ndarray) -> np.ndarray:
    """Of the logarithms under Dirichlet distributions, one a row."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def infer(ends: np.ndarray, at: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gamma, stats) of texts that end at ``ends`` and have n times the word ``at``; beta: exp(E log) for words and topics.

    Each text's loop ends when its gamma moves by 0.001 or less.
    """
    size = np.diff(ends, prepend=0)
    gamma = np.tile(start, (len(ends), 1))
    theta = np.exp(expectation(gamma))
    doc, b = np.repeat(np.arange(len(ends)), size), beta[at]
    live = np.arange(len(ends))
    l_size, l_n, l_b = size, n, b
    while len(live):
        t = theta[live]
        share = l_n / (np.einsum("ij,ij->i", l_b, np.repeat(t, l_size, axis=0)) + 1e-100)
        first = np.cumsum(l_size) - l_size
        new = t * np.add.reduceat(l_b * share[:, None], first, axis=0) + alpha
        more = np.abs(new - gamma[live]).mean(axis=1) > 1e-3
        gamma[live], theta[live] = new, np.exp(expectation(new))
        if not more.all():
            kept = np.repeat(more, l_size)
            live, l_size, l_n, l_b = live[more], l_size[more], l_n[kept], l_b[kept]
    share = n / (np.einsum("ij,ij->i", b, theta[doc]) + 1e-100)
    stats = np.stack([np.bincount(at, theta[doc, k] * share, len(beta)) for k in range(beta.shape[1])], axis=1)
    return gamma, stats * beta


def blocks(words: DataFrame, seed: int, rounds: int) -> DataFrame:
    """(round, block, id, d, at, n, words) of texts (id, d, w): the rows of a block point into the ``words`` of its first row.

    All texts in round 0, and in each round from 1 those of its sample, by ``d``.
    """
    kind = words.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, d, some = batch.column("id"), batch.column("d").to_numpy(), batch.column("w").value_lengths().fill_null(0).to_numpy() > 0
            for r in range(rounds + 1):
                rows = np.flatnonzero(some & (uniform(d, seed, 1, r) < FRACTION) if r else some)
                lists = batch.column("w").take(pa.array(rows))
                size = lists.value_lengths().to_numpy().astype(np.int64)
                cell = np.cumsum(size) // BLOCK
                for lo, hi in zip(first := [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist()] if len(rows) else [], [*first[1:], len(rows)], strict=False):
                    hashes, place = np.unique(lists.slice(lo, hi - lo).flatten().to_numpy(), return_inverse=True)
                    pair, n = np.unique(np.repeat(np.arange(hi - lo), size[lo:hi]) * len(hashes) + place, return_counts=True)
                    begin = pa.array(np.searchsorted(pair, np.arange(hi - lo + 1) * len(hashes)).astype(np.int32))
                    own = [pa.ListArray.from_arrays(begin, pa.array(x.astype(np.int32))) for x in (pair % len(hashes), n)]
                    listed = pa.array([hashes, *[None] * (hi - lo - 1)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, r, np.int32)), pa.array(np.full(hi - lo, block)), ids.take(pa.array(rows[lo:hi])), pa.array(d[rows[lo:hi]]), *own, listed], ["round", "block", "id", "d", "at", "n", "words"])
                    block += 1

    return words.mapInArrow(run, f"round int, block bigint, id {kind}, d bigint, at array<int>, n array<int>, words array<bigint>")


class Topics:
    """A model over ``topics`` topics of texts (id, d, w): d is a hash of the row, w the hashes of its words. Texts without one don't count."""

    def __init__(self, words: DataFrame, topics: int = 3, seed: int = 1, terms: int = 5, rounds: int = 10) -> None:
        self.k, self.seed, self.terms, self.words, self.names = topics, seed, terms, words, [f"s{i}" for i in range(topics)]
        self.spark = words.sparkSession
        both = cut(blocks(words, seed, rounds))  # words are found once
        self.texts, sampled = both.where("round = 0"), cut(both.where("round > 0"))
        every = self.texts.select(F.explode("words").alias("h")).distinct().select("h", *[F.lit(0.0).alias(s) for s in self.names])
        self.size, self.drawn, self.highest = self._tops(every)
        self.alpha, self.a, self.e, self.added = np.full(topics, 1 / topics), 1.0, 0.0, np.zeros(topics)
        self.start = np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, topics)
        self.sums = self.spark.createDataFrame([], "h bigint, " + ", ".join(f"{s} double" for s in self.names))
        count = self.texts.count()
        self.scale = count / max(1, math.ceil(FRACTION * count))
        held = {r["round"] for r in sampled.select("round").distinct().collect()}
        for done, r in enumerate(sorted(held), 1):
            self._learn(sampled.where(F.col("round") == r), (TAU + done) ** -KAPPA)

    def _beta(self, words: np.ndarray, added: np.ndarray) -> np.ndarray:
        """exp(E log) of the words' weights."""
        weight = self.a * (draws(words, self.k, self.seed) + added) + self.e
        return np.exp(digamma(weight) - digamma(self.a * (self.drawn + self.added) + self.size * self.e))

    def _worked(self, texts: DataFrame, out: Any, schema: str) -> DataFrame:
        """out(ids, words, gamma, stats) for every block."""
        asked = texts.where("words IS NOT NULL").select(F.col("block").alias("of"), F.explode("words").alias("h")).join(self.sums, "h", "left").select("of", "h", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in self.names])
        beta, alpha, start, names = _Weights(self), self.alpha.copy(), self.start, self.names

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            h = right.column("h").to_numpy()
            order = np.argsort(h)
            added = np.stack([right.column(s).to_numpy()[order] for s in names], axis=1)
            at, n = (left.column(c).combine_chunks() for c in ("at", "n"))
            ends = np.cumsum(at.value_lengths().to_numpy().astype(np.int64))
            found = infer(ends, at.flatten().to_numpy(), n.flatten().to_numpy().astype(float), beta(h[order], added), alpha, start)
            return out(left.column("id"), h[order], *found)

        return texts.select("block", "id", "at", "n").groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(run, schema)

    def _learn(self, texts: DataFrame, rho: float) -> None:
        k, names = self.k, self.names
        factor = rho * self.scale / (self.a * (1 - rho))

        def out(ids: pa.ChunkedArray, words: np.ndarray, gamma: np.ndarray, stats: np.ndarray) -> pa.Table:
            values = np.vstack([stats * factor, expectation(gamma).sum(axis=0)])
            none = np.append(np.zeros(len(words), bool), True)
            return pa.table([pa.array(np.append(words, 0), mask=none), *[pa.array(values[:, i]) for i in range(k)], pa.array(np.where(none, len(gamma), 0))], ["h", *names, "texts"])

        fresh = self._worked(texts, out, "h bigint, " + ", ".join(f"{s} double" for s in names) + ", texts bigint")
        every = cut(fresh.unionByName(self.sums.withColumn("texts", F.lit(0).cast("bigint"))).groupBy("h").agg(*[F.sum(s).alias(s) for s in names], F.sum("texts").alias("texts")))
        total = {r["own"]: r for r in every.groupBy(F.col("h").isNotNull().alias("own")).agg(*[F.sum(s).alias(s) for s in names], F.sum("texts").alias("texts")).collect()}
        self.sums = every.where("h IS NOT NULL").select("h", *names)
        self.a, self.e = self.a * (1 - rho), self.e * (1 - rho) + rho / k
        self.added = np.array([total[True][s] for s in names])
        self._prior(np.array([total[False][s] for s in names]) / total[False]["texts"], total[False]["texts"], rho)

    def _prior(self, log: np.ndarray, n: int, rho: float) -> None:
        """A Newton step of the texts' prior, if it stays positive."""
        slope, q, z = n * (log - expectation(self.alpha)), -n * trigamma(self.alpha), n * trigamma(self.alpha.sum())
        b = (slope / q).sum() / (1 / z + (1 / q).sum())
        new = self.alpha - rho * (slope - b) / q
        if (new > 0).all():
            self.alpha = new

    def _tops(self, words: DataFrame) -> tuple[int, np.ndarray, list[list[tuple[float, int]]]]:
        """Number, sum of draw + S, and the heaviest words of each topic by it, of words (h, s...)."""
        k, seed, names, n = self.k, self.seed, self.names, self.terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, sums, best = 0, np.zeros(k), [[] for _ in range(k)]
            for batch in batches:
                h = batch.column("h").to_numpy()
                weight = draws(h, k, seed) + np.stack([batch.column(s).to_numpy() for s in names], axis=1)
                size, sums = size + len(h), sums + weight.sum(axis=0)
                for i in range(k):
                    near = np.argsort(-weight[:, i], kind="stable")[:n]
                    best[i] = heaviest(best[i] + list(zip(weight[near, i].tolist(), h[near].tolist(), strict=True)), n)
            rows = [(i, float(sums[i]), size, [w for w, _ in best[i]], [h for _, h in best[i]]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if i < 3 else pa.array(c, pa.list_(pa.float64() if i == 3 else pa.int64())) for i, c in enumerate(zip(*rows, strict=True))], ["topic", "total", "size", "weights", "hashes"])

        size, sums, best = 0, np.zeros(k), [[] for _ in range(k)]
        for r in words.mapInArrow(run, "topic bigint, total double, size bigint, weights array<double>, hashes array<bigint>").toLocalIterator():
            sums[r["topic"]] += r["total"]
            size += r["size"] if r["topic"] == 0 else 0
            best[r["topic"]] = heaviest(best[r["topic"]] + list(zip(r["weights"], r["hashes"], strict=True)), n)
        return size, sums, best

    def heaviest(self) -> list[list[int]]:
        """The hashes of each topic's heaviest words: by weight, then hash.

        A word that was in no sample can only be one of them if its draw is one of the highest of all words.
        """
        out = []
        for own, drawn in zip(self._tops(self.sums)[2], self.highest, strict=True):
            sampled = {r["h"] for r in self.sums.where(F.col("h").isin([h for _, h in drawn])).select("h").collect()}
            out.append([h for _, h in heaviest(own + [(w, h) for w, h in drawn if h not in sampled], self.terms)])
        return out

    def holding(self, words: list[int]) -> DataFrame:
        """(d) of a few texts, among which is one for each of the words: a block of them for each."""
        first = self.texts.select("block", F.explode(F.filter("words", lambda h: h.isin(words))).alias("h")).groupBy("h").agg(F.min("block").alias("block"))
        return self.texts.where(F.col("block").isin(sorted({r["block"] for r in first.collect()}))).select("d")

    def topics(self) -> DataFrame:
        """(id, topic) of every text: its likeliest topic, the first of equal ones."""
        kind = self.words.schema["id"].dataType.simpleString()

        def out(ids: pa.ChunkedArray, words: np.ndarray, gamma: np.ndarray, stats: np.ndarray) -> pa.Table:
            return pa.table([ids, pa.array(gamma.argmax(axis=1).astype(np.int32))], ["id", "topic"])

        return self._worked(self.texts, out, f"id {kind}, topic int")


def heaviest(found: list[tuple[float, int]], n: int) -> list[tuple[float, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:n]


class _Weights:
    """What Topics._beta needs, without the model's tables."""

    def __init__(self, model: Topics) -> None:
        self.k, self.seed, self.a, self.e = model.k, model.seed, model.a, model.e
        self.drawn, self.added, self.size = model.drawn.copy(), model.added.copy(), model.size

    __call__ = Topics._beta
