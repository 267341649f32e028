"""Embedding near-dedup with randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

A vector o of length one is rotated by a seeded random orthogonal matrix and coded by the signs of its coordinates, one
bit each; along with the code goes the correction factor f = <code, rotated o>, code scaled to length one. For another
vector q, <code, rotated q> / f is an unbiased estimate of <o, q>, and the true value lies within
EPSILON * sqrt((1 - f^2) / f^2) / sqrt(d - 1) of it but for a chance that falls off exponentially with EPSILON squared.
As a query a vector has its rotated coordinates, in a byte each, and the length of what that leaves out, which widens
the bounds by as much as it can matter.

Only codes, bytes and factors travel: vectors meet in shards by several sampled sets of code bits, chosen for the
threshold's angle and such that a shard has SHARD unrelated vectors. There the binary codes' bounds leave out almost all
pairs; pairs that they leave open are decided by the bytes of both, whose bounds are certain, and what is still open is
recomputed from the full vectors, which are joined to these few pairs alone. Pairs whose vectors are linked already are
passed over, so that a shard full of copies of one vector costs its size times a block, and gives no list of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import cut, groups

THRESHOLD, EPSILON, RECALL, SEED = 0.95, 3.0, 0.99, 3
#: Unrelated vectors in a shard, if all bits were even; vectors that are compared with one another at once.
SHARD, BLOCK = 512, 1024


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, packed sign bits as bytes, correction factor) of the rows of ``unit``."""
    rotated = unit @ turn.T
    return rotated, np.packbits(rotated > 0, axis=1, bitorder="little"), np.abs(rotated).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(rotated_q: np.ndarray, codes: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: the estimated inner product of a query and a coded vector, and how far it may be off."""
    d = rotated_q.shape[1]
    signs = np.unpackbits(codes, axis=1, bitorder="little", count=d).astype(rotated_q.dtype) * 2 - 1
    f = np.maximum(factor, 1e-9)
    return np.einsum("ij,ij->i", signs, rotated_q) / math.sqrt(d) / f, bound(f, d, epsilon)


def bound(factor: np.ndarray, d: int, epsilon: float = EPSILON) -> np.ndarray:
    f = np.maximum(factor, 1e-9)
    return epsilon * np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(max(1, d - 1))


class Coded:
    """Vectors as they travel: the code's signs, the bytes' values, the factor and the length of what the bytes leave out."""

    def __init__(self, d: int, codes: np.ndarray, levels: np.ndarray, numbers: np.ndarray) -> None:
        self.d = d
        self.signs = np.unpackbits(codes, axis=1, bitorder="little", count=d).astype(np.float32) * 2 - 1
        self.factor, low, step, self.rest = numbers.T
        self.values = low[:, None] + step[:, None] * levels.astype(np.float32)


def pack(rotated: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> list[bytes]:
    """A row of bytes for each vector: its code, its levels, and factor, lowest, step and rest as four floats."""
    low, high = rotated.min(axis=1), rotated.max(axis=1)
    numbers = np.stack([factor, low, np.maximum(high - low, 1e-12) / 255, np.zeros(len(low))], axis=1).astype(np.float32)
    levels = np.clip(np.rint((rotated - numbers[:, 1:2]) / numbers[:, 2:3]), 0, 255).astype(np.uint8)
    shown = numbers[:, 1:2] + numbers[:, 2:3] * levels.astype(np.float32)
    numbers[:, 3] = np.linalg.norm(rotated - shown, axis=1) + 1e-6
    whole = np.concatenate([codes, levels, numbers.view(np.uint8)], axis=1)
    return [r.tobytes() for r in whole]


def unpack(rows: list[bytes], d: int) -> Coded:
    whole = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    c = -(-d // 8)
    return Coded(d, whole[:, :c], whole[:, c : c + d], np.ascontiguousarray(whole[:, c + d :]).view(np.float32).astype(np.float64))


def _find(root: np.ndarray) -> np.ndarray:
    while (up := root[root] != root).any():
        root[up] = root[root[up]]
    return root


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        _find(root)
        ra, rb = root[a], root[b]
        todo = ra != rb
        if not todo.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[todo], np.minimum(ra, rb)[todo])


def shard_links(x: Coded, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, root, a, b) of a shard's rows: items that certain links connect to an earlier one, and the open pairs."""
    m = len(rows)
    root = np.arange(m)
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    error = bound(x.factor[rows], x.d)
    factor = np.maximum(x.factor[rows], 1e-9)

    def compare(i: np.ndarray, j: np.ndarray, same: bool) -> None:
        if not len(i) or not len(j):
            return
        value = x.values[rows[i]].astype(np.float32) @ x.signs[rows[j]].T / math.sqrt(x.d) / factor[j]
        a, b = np.nonzero(value + error[j] + x.rest[rows[i]][:, None] / factor[j] >= threshold)
        a, b = i[a], j[b]
        keep = (root[a] != root[b]) & ((a < b) if same else True)
        a, b = a[keep], b[keep]
        if not len(a):
            return
        value = np.einsum("ij,ij->i", x.values[rows[a]], x.values[rows[b]])
        ra, rb = x.rest[rows[a]], x.rest[rows[b]]
        off = ra * (1 + rb) + rb + 1e-6
        yes = value - off >= threshold
        maybe = ~yes & (value + off >= threshold)
        _link(root, a[yes], b[yes])
        if maybe.any():
            open_.append((a[maybe], b[maybe]))

    starts = range(0, m, BLOCK)
    for s in starts:
        i = np.arange(s, min(s + BLOCK, m))
        compare(i, i, True)
        for t in range(s + BLOCK, m, BLOCK):
            j = np.arange(t, min(t + BLOCK, m))
            # the largest component of the block need not meet its own members
            names, count = np.unique(root[i], return_counts=True)
            own = names[np.argmax(count)]
            in_i, in_j = root[i] == own, root[j] == own
            compare(i[~in_i], j, False)
            compare(i[in_i], j[~in_j], False)
    _find(root)
    item = np.flatnonzero(root != np.arange(m))
    a, b = (np.concatenate(z) for z in zip(*open_, strict=True)) if open_ else (np.empty(0, np.int64), np.empty(0, np.int64))
    still = root[a] != root[b]
    return item, root[item], a[still], b[still]


def bit_tables(n: float, d: int, threshold: float, recall: float = RECALL, seed: int = SEED) -> list[np.ndarray]:
    """The code bits of each table: as many tables as find a pair at the threshold with this chance, at every size."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(d, 60, max(4, math.ceil(math.log2(max(n, 2)) - math.log2(SHARD))))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(d, bits, replace=False)) for _ in range(tables)]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, keep_id): every vector that repeats another, and the least id of its group, which stays.

    Vectors repeat one another where their cosine reaches the threshold; groups are the connected components. Equal
    vectors are one for the search. The dimension is that of most vectors; vectors of another dimension, null vectors,
    vectors with a null, NaN or infinite part, zero vectors and null ids belong to no group and are kept. Rows that
    repeat an id count once each as vectors and once as members. Other columns are not read. An empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    part = F.col("v")
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = chosen.where(~F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e18)) & F.exists(part, lambda x: x != 0))
    found = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if found is None:
        return spark.createDataFrame([], "vec_id long, keep_id long")
    d = found["d"]
    marked = sound.where(F.size("v") == d).withColumn("h", F.sha2(F.to_json("v"), 256))
    heads = cut(marked.groupBy("h").agg(F.min("id").alias("id"), F.first("v").alias("v")))
    exact = marked.select("id", "h").join(heads.select("h", F.col("id").alias("head")), "h").select("id", "head").distinct()
    tables = bit_tables(heads.count(), d, threshold)
    turn = rotation(d)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("v").flatten().to_numpy().reshape(-1, d).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rotated, codes, factor = encode(unit(batch), turn)
            packed = pa.array(pack(rotated, codes, factor), pa.binary())
            bits = np.unpackbits(codes, axis=1, bitorder="little", count=d)
            for t, places in enumerate(tables):
                key = np.zeros(len(bits), np.uint64)
                for i, p in enumerate(places):
                    key |= bits[:, p].astype(np.uint64) << np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(tk.mix(key, 2000 + t))), batch.column("id"), packed], names=["shard", "id", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            shard, ids = t.column("shard").to_numpy(), t.column("id").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            n = np.diff(np.append(first, len(shard)))
            first, n = first[n > 1], n[n > 1]
            if not len(first):
                return
            x = unpack(t.column("code").to_pylist(), d)
            for s, m in zip(first.tolist(), n.tolist(), strict=True):
                own = np.arange(s, s + m)
                item, root, a, b = shard_links(x, own, threshold)
                left, right = np.concatenate([own[item], own[a]]), np.concatenate([own[root], own[b]])
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right]), pa.array(np.arange(len(left)) < len(item))], names=["a", "b", "sure"])

        size = 0
        for batch in batches:  # sorted by shard
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            last = int(np.searchsorted(shard, shard[-1]))
            if last and size + batch.num_rows > 20_000:
                yield from edges([*held, batch.slice(0, last)])
                held, batch, size = [], batch.slice(last), 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from edges(held)

    placed = heads.select("id", "v").mapInArrow(spread, "shard long, id long, code binary")
    links = cut(placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long, sure boolean").groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))
    vector = heads.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    both = links.where("NOT sure").join(vector.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vector.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    verified = both.where(dot("va", "vb") >= threshold * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))).select("a", "b")
    joined = groups(links.where("sure").select("a", "b").unionByName(verified))
    return (
        exact.join(joined, exact["head"] == joined["node"], "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("root", "head").alias("keep_id"))
        .where("vec_id <> keep_id")
    )


def perturbed(vectors: DataFrame) -> DataFrame:
    """The table with a near copy of every tenth vector, under an id of -1 less its own."""
    scaled = F.transform("embedding", lambda x, i: (x.cast("double") * (1 + 0.03 * ((F.col("vec_id") * 31 + i * 17) % 11 - 5))).cast("float"))
    return vectors.select("vec_id", "embedding").unionByName(vectors.where("vec_id % 10 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), scaled.alias("embedding")))


PERTURBED = "(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: (x::DOUBLE * (1 + 0.03 * ((vec_id * 31 + (i - 1) * 17) % 11 - 5)))::FLOAT) FROM embeddings WHERE vec_id % 10 = 0)"


def oracle(vectors: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """Brute force over all pairs, for tables of sound vectors."""
    return f"""
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM {vectors}),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding, b.embedding) >= {threshold}),
reach(v, r) AS (SELECT a, a FROM pairs UNION SELECT p.b, reach.r FROM reach JOIN pairs p ON p.a = reach.v)
SELECT v AS vec_id, min(r) AS keep_id FROM reach GROUP BY v HAVING min(r) <> v"""
