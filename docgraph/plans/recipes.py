"""Recipes: sources to graphs in one plan. A recipe runs nothing but the cuts of ``structure``; the caller's writes do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import chunk, graph, refine
from docgraph.sources import office

Graph = tuple[DataFrame, DataFrame]


def normal(texts: DataFrame, size: int = 1000, overlap: int = 100, steps: list[str] | str = "ALL") -> Graph:
    """(nodes, edges) of texts (doc_id, content): cleaned, deduplicated, chunked; each chunk belongs to its document's first."""
    blocks = refine.dedup_blocks(refine.chain(texts.where("content IS NOT NULL"), steps), "content", ["doc_id"])
    parts = chunk.recursive_chunks(blocks, size, overlap)
    key = F.col("doc_id").cast("string")
    chunks = parts.select("chunk_id", key.alias("source"), F.when(F.col("part_index") > 0, F.concat(key, F.lit("_part_0"))).alias("parent_id"), tx.classify_chunk("content").alias("semantic_type"), (F.col("part_index") == 0).alias("is_header"), "content")
    nodes = graph.document_nodes(chunks)
    return nodes, graph.with_reverse(nodes.where("parent_node IS NOT NULL").select(*graph.edge("node_id", "parent_node", "hasParent")))


def standard(files: DataFrame, size: int = 1000, overlap: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of binary office files (path, content); failures are (doc_id, format, error)."""
    parsed = office.parse_documents(files)
    blocks = refine.document_markdown(parsed.where("pages IS NOT NULL")).where("type = 'md'")
    whole = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
    nodes, edges = normal(whole, size, overlap)
    return nodes, edges, parsed.where("error IS NOT NULL").select("doc_id", "format", "error")


def structure(files: DataFrame) -> Graph:
    """(nodes, edges) of source files (source, content)."""
    nodes = graph.code_nodes(chunk.code_chunks(files))
    return nodes, graph.CodeGraph(nodes, held=True).edges()


def transfer(df: DataFrame, write: Callable[[DataFrame], None], refine_by: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Reads, refines if asked, and writes; without ``refine_by`` rows pass as they are."""
    write(refine_by(df) if refine_by else df)
