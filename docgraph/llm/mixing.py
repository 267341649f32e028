"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source, shard by shard and in a seeded order within each, are one row of tokens, which is cut into
blocks of equal size: blocks run on from one shard into the next, so that no token is lost to sharding and only the last
block of a source may be short. Shards are for parallel work: a source has one for every SHARD_TOKENS of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm import tokens as tk
from docgraph.llm.common import cut

BLOCK_TOKENS, FRACTION, SEED = 256, 0.5, 17
SHARD_TOKENS = 1 << 20
#: Tables of sources of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000


def apportion(seats: int, weights: dict, capacity: dict) -> dict:
    """Sainte-Laguë quotas: the ``seats`` highest quotients weight / (2k + 1), k below the key's capacity.

    Equal quotients go to the lesser key first. Keys without a positive weight get nothing; where all capacity is used
    up the rest of the seats stay empty. A bisection over the quotient does most of the work, so that the time hardly
    depends on the number of seats.
    """
    keys = sorted(k for k, w in weights.items() if w > 0 and capacity.get(k, 0) > 0)

    def above(k: object, low: float) -> int:
        w, cap = weights[k], capacity[k]
        n = min(cap, max(0, int((w / low - 1) // 2) + 1))
        while n < cap and w / (2 * n + 1) > low:
            n += 1
        while n and w / (2 * n - 1) <= low:
            n -= 1
        return n

    if sum(capacity[k] for k in keys) <= seats:
        return {k: capacity[k] for k in keys}
    if not keys or seats <= 0:
        return dict.fromkeys(keys, 0)
    high, low = max(weights[k] for k in keys), min(weights[k] / (2 * capacity[k] + 1) for k in keys) / 2
    for _ in range(200):
        mid = (high + low) / 2
        if mid in (high, low):
            break
        if sum(above(k, mid) for k in keys) <= seats:
            high = mid
        else:
            low = mid
    quota = {k: above(k, high) for k in keys}
    heap = [(-weights[k] / (2 * quota[k] + 1), k) for k in keys if quota[k] < capacity[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(quota.values())):
        _, k = heapq.heappop(heap)
        quota[k] += 1
        if quota[k] < capacity[k]:
            heapq.heappush(heap, (-weights[k] / (2 * quota[k] + 1), k))
    return quota


def _hash(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def _by_rows(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, t, n): words of each document and a hash of its text, which tells apart rows that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                n = tk.count_words(part.column("text"))
                has = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(has) for c in ("doc_id", "source", "t")), pa.array(n[n > 0])], names=["doc_id", "source", "t", "n"])

    return _rows(docs).mapInArrow(run, "doc_id long, source string, t long, n long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.xxhash64("text").alias("t"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def _spans(docs: DataFrame, weights: dict[str, float] | None, fraction: float, block_tokens: int, seed: int, shard_tokens: int) -> DataFrame:
    spark = docs.sparkSession
    counted = cut(_counted(docs))
    totals = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    shards = spark.createDataFrame([(s, -(-n // shard_tokens)) for s, n in totals.items()], "source string, shards long")
    placed = counted.join(_by_rows(shards, len(totals)), "source").withColumn("h", _hash(seed, "doc_id"))
    placed = placed.withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards")).drop("shards")
    sizes = sorted((r["source"], r["shard"], r["n"]) for r in placed.groupBy("source", "shard").agg(F.sum("n").alias("n")).collect())
    # of each source and shard: its first token in the source's row, and the blocks that begin in it
    at, blocks = dict.fromkeys(totals, 0), {}
    begins = []
    for s, shard, n in sizes:
        begins.append((s, shard, at[s]))
        first, end = -(-at[s] // block_tokens), -(-(at[s] + n) // block_tokens)
        blocks.setdefault(s, {})[shard] = (first, end - first)
        at[s] += n
    capacity = {s: sum(n for _, n in own.values()) for s, own in blocks.items()}
    quota = apportion(int(fraction * sum(capacity.values())), weights or dict.fromkeys(capacity, 1.0), capacity)
    rows = []
    for s, n in quota.items():
        own = {shard: k for shard, (_, k) in blocks[s].items() if k}
        rows += [(s, shard, *blocks[s][shard], q) for shard, q in apportion(n, {k: float(m) for k, m in own.items()}, own).items() if q]
    seated = spark.createDataFrame(rows, "source string, shard long, first_block long, n_blocks long, quota long")
    cell = Window.partitionBy("source", "shard")
    chosen = (
        seated.withColumn("block", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("n_blocks") - 1)))
        .withColumn("r", F.row_number().over(cell.orderBy(_hash(seed, "source", "shard", "block"), "block")))
        .where("r <= quota")
        .select("source", "shard", "block")
    )
    placed = placed.join(_by_rows(spark.createDataFrame(begins, "source string, shard long, shard_begin long"), len(begins)), ["source", "shard"])
    ends = placed.withColumn("end", F.col("shard_begin") + F.sum("n").over(cell.orderBy("h", "doc_id", "n", "t").rowsBetween(Window.unboundedPreceding, 0)))
    spans = ends.withColumn("begin", F.col("end") - F.col("n")).withColumn("block", F.explode(F.sequence(F.expr(f"begin DIV {block_tokens}"), F.expr(f"(end - 1) DIV {block_tokens}"))))
    return spans.drop("shard").join(chosen, ["source", "block"]).select(
        "source",
        "shard",
        "block",
        "doc_id",
        "t",
        F.greatest(F.lit(0).cast("long"), F.col("block") * block_tokens - F.col("begin")).alias("start_token"),
        F.least(F.col("n"), (F.col("block") + 1) * block_tokens - F.col("begin")).alias("end_token"),
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    fraction: float = FRACTION,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(source, shard, block, doc_id, start_token, end_token): the parts of documents in the chosen blocks.

    The documents of a source are cut into blocks of exactly ``block_tokens`` words, but for the source's last one.
    ``fraction`` of all blocks are apportioned to the sources by ``weights`` (equal if not given; a source not named
    gets none), each source's seats to its shards by the blocks that begin there, and each shard's seats to its blocks
    in a seeded order. Only the counts by source and shard reach the driver: a row for each source and one for each
    ``shard_tokens`` words.

    A null source counts as "unknown". Documents without a word, null texts and null ids are in no block. Rows that
    repeat an id are separate documents. Very long texts run through many blocks. Equal quotients go to the lesser
    source or shard, equal hashes to the lesser block, id and text. Other columns are not read. An empty table gives no
    rows.
    """
    return _spans(docs, weights, fraction, block_tokens, seed, shard_tokens).drop("t")


def mixed_texts(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    fraction: float = FRACTION,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """mix_sources() with the text of each part, from its first word's first to its last word's last character.

    Every text is shuffled once, to its parts; parts of one document travel in lists of those of 1024 blocks. Odd rows
    fare as in mix_sources().
    """
    spans = _spans(docs, weights, fraction, block_tokens, seed, shard_tokens)
    key = ["doc_id", "source", "t"]
    parts = spans.groupBy(*key, F.expr("block DIV 1024").alias("__part")).agg(F.collect_list(F.struct("shard", "block", "start_token", "end_token")).alias("__spans")).drop("__part")
    texts = _rows(docs).groupBy(*key).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                w = tk.words(part.column("text"), folded=False)
                spans = part.column("__spans")
                of = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                field = {c: flat.field(c) for c in ("shard", "block", "start_token", "end_token")}
                first = w.bounds[of] + field["start_token"].to_numpy()
                last = w.bounds[of] + field["end_token"].to_numpy() - 1
                raw = w.data.tobytes()
                text = pa.array([raw[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)], pa.string())
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("source").take(take), field["shard"], field["block"], part.column("doc_id").take(take), field["start_token"], field["end_token"], text],
                    names=["source", "shard", "block", "doc_id", "start_token", "end_token", "text"],
                )

    return parts.join(texts, key).mapInArrow(run, "source string, shard long, block long, doc_id long, start_token long, end_token long, text string")


def oracle(docs: str = "documents", fraction: float = FRACTION, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> str:
    """The same by quotients: every seat's quotient is listed and ranked."""
    token = "'[^ \\t\\n\\x0B\\f\\r]+'"
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, text, len(regexp_extract_all(text, {token}))::BIGINT AS n, md5('{seed}|' || doc_id) AS h
  FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
kept AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM counted WHERE n > 0),
placed AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % ((total + {shard_tokens - 1}) // {shard_tokens})::BIGINT AS own FROM kept),
ends AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY own, h, doc_id, n, md5(text) ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM placed),
cells AS (SELECT source, own AS shard, min(e - n) AS b, max(e) AS e FROM ends GROUP BY ALL),
avail AS (SELECT source, shard, (b + {block_tokens - 1}) // {block_tokens} AS first, (e + {block_tokens - 1}) // {block_tokens} AS past FROM cells),
by_source AS (SELECT source, max(past) AS blocks FROM avail GROUP BY ALL),
seats AS (SELECT floor({fraction} * sum(blocks))::BIGINT AS seats FROM by_source),
ranked AS (SELECT source, row_number() OVER (ORDER BY 1.0::DOUBLE / (2 * k + 1) DESC, source) AS r FROM (SELECT source, unnest(range(blocks)) AS k FROM by_source)),
quota AS (SELECT source, count(*) AS q FROM ranked, seats WHERE r <= seats GROUP BY ALL),
ranked2 AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY (past - first)::DOUBLE / (2 * k + 1) DESC, shard) AS r FROM (SELECT source, shard, past, first, unnest(range(past - first)) AS k FROM avail)),
quota2 AS (SELECT source, shard, count(*) AS q FROM ranked2 JOIN quota USING (source) WHERE r <= q GROUP BY ALL),
chosen AS (SELECT source, shard, block FROM (
  SELECT source, shard, block, q, row_number() OVER (PARTITION BY source, shard ORDER BY md5('{seed}|' || source || '|' || shard || '|' || block), block) AS r
  FROM (SELECT source, shard, unnest(range(first, past)) AS block FROM avail) JOIN quota2 USING (source, shard)) WHERE r <= q),
spans AS (SELECT source, doc_id, n, e - n AS b, unnest(range((e - n) // {block_tokens}, (e - 1) // {block_tokens} + 1)) AS block FROM ends)
SELECT source, shard, block, doc_id, greatest(0, block * {block_tokens} - b) AS start_token, least(n, (block + 1) * {block_tokens} - b) AS end_token
FROM spans JOIN chosen USING (source, block)"""
