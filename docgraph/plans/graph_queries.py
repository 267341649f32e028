"""Queries of nodes, edges and graph questions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import chunk, graph, refine
from docgraph.operators.lineage import cut
from docgraph.plans.registry import query, table
from docgraph.plans.text_queries import S_P02, docs


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned, masked, deduplicated documents in chunks of 1000 with an overlap of 100, as children of their documents."""
    cleaned = docs(spark, d).withColumn("content", tx.mask_pii(tx.whitespace("content")))
    kept = refine.dedup_blocks(cleaned, "content", ["doc_id"])
    c = chunk.fixed_chunks(kept, 1000, 100)
    return c.select(F.concat("doc_id", F.lit("_"), "part_index").alias("chunk_id"), "doc_id", "part_index", F.concat(F.lit("doc "), "doc_id").alias("source"), F.when(F.col("part_index") > 0, F.concat("doc_id", F.lit("_0"))).alias("parent_id"), tx.classify_chunk("content").alias("semantic_type"), (F.col("part_index") == 0).alias("is_header"), "content")


S_KEPT = f"SELECT doc_id, content FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace({S_P02}, '{tx.EMAIL}', '[EMAIL]', 'g'), '{tx.PHONE}', '[PHONE]', 'g') AS content FROM documents)) WHERE n = 1 OR length(content) < 5 OR content IS NULL"
S_CHUNKS = f"(SELECT doc_id, s // 900 AS i, substr(content, s + 1, 1000) AS content FROM (SELECT *, unnest(range(0, length(content), 900)) AS s FROM ({S_KEPT})))"
S_ID = "'doc:doc_' || doc_id || ':' || doc_id || '_'"


@query("w01_doc_nodes", f"SELECT {S_ID} || i AS node_id, CASE WHEN i = 0 THEN 'Topic' ELSE 'Text' END AS node_class, content, CASE WHEN i > 0 THEN {S_ID} || '0' END AS parent_node FROM {S_CHUNKS}")
def w01(spark: SparkSession, d: str) -> DataFrame:
    c = doc_chunks(spark, d).withColumn("semantic_type", F.lit("text"))
    return graph.document_nodes(c).drop("friendly_name")


def videos(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.concat(F.lit("v"), "conv_id").alias("video_id"), F.col("role").alias("title"), F.when(F.col("turn") != 1, F.col("turn").cast("double")).alias("start"), (F.col("turn") + 1).cast("double").alias("end"), F.col("turn").cast("string").alias("chunk_id"), F.col("text").alias("content"))


@query(
    "w02_video_nodes",
    "WITH t AS (SELECT 'video:v' || conv_id AS u, * FROM conversations WHERE turn <> 1) SELECT u AS node_id, 'Video' AS node_class, NULL AS parent_node, arg_min(role, turn) AS title, NULL::DOUBLE AS \"start\", NULL::DOUBLE AS \"end\" FROM t GROUP BY u "
    "UNION ALL SELECT u || ':seg:' || turn, 'Segment', u, role, turn::DOUBLE, (turn + 1)::DOUBLE FROM t",
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    return graph.video_nodes(videos(spark, d))


#: A module for document i, which imports that of document j = i + 1; the tables hold no sources.
MODULE = """import abc
from p{q}.m{j} import Base{j}, helper{j}

LIMIT{i} = {n}
__all__ = ['Base{i}', 'run{i}']


class Base{i}(Base{j}):
    @abc.abstractmethod
    def go(self, n: int) -> int:
        raise ValueError(n)

    def step{i}(self):
        global LIMIT{i}
        LIMIT{i} += 1
        return helper{i}(self)


async def later{i}(job: Base{j}):
    job.step{j}()
    return await run{j}(job)


def helper{i}(x):
    return x


def run{i}():
    later{i}(Base{i}())
    return helper{j}(1)
"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(source, content): a module for every document."""
    i, j = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    text = F.lit(MODULE)
    for mark, value in (("i", i), ("j", j), ("q", F.pmod(F.col("doc_id") + 1, F.lit(7)).cast("string")), ("n", F.coalesce(F.col("n_chars").cast("string"), F.lit("0")))):
        text = F.replace(text, F.lit("{" + mark + "}"), value)
    return table(spark, d, "documents").select(F.concat(F.lit("src/p"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("/m"), i, F.lit(".py")).alias("source"), text.alias("content"))


def code_nodes(spark: SparkSession, d: str, *facts: str) -> DataFrame:
    return graph.code_nodes(chunk.code_chunks(sources(spark, d), facts=[*graph.CodeGraph.OF_ALL, *facts]))


S_FILES = "f AS (SELECT doc_id AS i, 'src/p' || (doc_id % 7) || '/m' || doc_id || '.py' AS path, 'code:src/p' || (doc_id % 7) || '/m' || doc_id || '.py' AS u FROM documents), g AS (SELECT a.i, a.u, b.i AS j, b.u AS w FROM f a JOIN f b ON b.i = a.i + 1)"


@query(
    "c17_code_chunks",
    f"WITH {S_FILES}, c(chunk_index, semantic_type, named, class_named, line_start, line_end) AS (VALUES (0, 'code_block', NULL, NULL, 1, 5), (1, 'class', 'Base', NULL, 8, 9), (2, 'method', 'go', 'Base', 9, 11), (3, 'method', 'step', 'Base', 13, 16), (4, 'function', 'later', NULL, 19, 21), (5, 'function', 'helper', NULL, 24, 25), (6, 'function', 'run', NULL, 28, 30)) "
    "SELECT path AS source, 'python' AS language, chunk_index, semantic_type, CASE WHEN named = 'go' THEN named ELSE named || i END AS symbol_name, class_named || i AS class_name, line_end FROM f, c",
)
def c17(spark: SparkSession, d: str) -> DataFrame:
    return chunk.code_chunks(sources(spark, d), facts=["semantic_type", "symbol_name", "class_name", "line_end"]).select("source", "language", "chunk_index", "semantic_type", "symbol_name", "class_name", "line_end")


S_UNITS = "['#CodeBlock_0', '#Base' || i, '#Base' || i || '.go', '#Base' || i || '.step' || i, '#later' || i, '#helper' || i, '#run' || i]"


@query(
    "w03_code_nodes",
    f"WITH {S_FILES} SELECT u AS node_id, 'File' AS node_class, NULL AS parent_node, path AS file_path FROM f UNION ALL SELECT u || x, CASE WHEN x = '#CodeBlock_0' THEN 'CodeBlock' WHEN contains(x, '.') THEN 'Method' WHEN x = '#Base' || i THEN 'Class' ELSE 'Function' END, "
    f"CASE WHEN contains(x, '.') THEN u || '#Base' || i ELSE u END, path FROM (SELECT *, unnest({S_UNITS}) AS x FROM f)",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    return code_nodes(spark, d).select("node_id", "node_class", "parent_node", "file_path")


def code_edges(name: str, rule: str, own: list[tuple[str, str]], other: list[tuple[str, str]]) -> None:
    """A query of one rule's edges over the modules of all documents; in SQL from its own units, and to the module it imports."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(graph.CodeGraph(code_nodes(spark, d, *graph.CodeGraph.READS[rule]), held=True), rule)().select("source", "target", "type")

    def unit(prefix: str, number: str, pattern: str) -> str:
        return f"'{pattern}'" if ":" in pattern else f"{prefix} || '" + pattern.replace("{}", f"' || {number} || '") + "'"

    parts = [f"SELECT {unit('u', 'i', a)} AS source, {unit('u', 'i', b)} AS target, '{rule.upper()}' AS type FROM f" for a, b in own]
    parts += [f"SELECT {unit('u', 'i', a)} AS source, {unit('w', 'j', b)} AS target, '{rule.upper()}' AS type FROM g" for a, b in other]
    query(name, f"WITH {S_FILES} " + " UNION ALL ".join(parts))(run)


code_edges("g08_contains", "contains", [("", x) for x in ("#CodeBlock_0", "#Base{}", "#Base{}.go", "#Base{}.step{}", "#later{}", "#helper{}", "#run{}")], [])
code_edges("g09_imports", "imports", [], [("#CodeBlock_0", "#Base{}"), ("#CodeBlock_0", "#helper{}")])
code_edges("g10_calls", "calls", [("#Base{}.step{}", "#helper{}"), ("#run{}", "#later{}"), ("#run{}", "#Base{}")], [("#later{}", "#run{}"), ("#run{}", "#helper{}")])
code_edges("g11_maybe_calls", "maybe_calls", [], [("#later{}", "#Base{}.step{}")])
code_edges("g12_inherits", "inherits", [], [("#Base{}", "#Base{}")])
code_edges("g13_overrides", "overrides", [], [("#Base{}.go", "#Base{}.go")])
code_edges("g14_uses_type", "uses_type", [], [("#later{}", "#Base{}")])
code_edges("g15_mutates_global", "mutates_global", [("#Base{}.step{}", "#CodeBlock_0")], [])
code_edges("g16_raises", "raises", [("#Base{}.go", "exception:ValueError")], [])
code_edges("g17_exposes", "exposes", [("", "#Base{}"), ("", "#run{}")], [])


@query("w04_vectors")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", graph.hash_vector("content").alias("vector"))


@query("w05_enrich", "SELECT doc_id, substr(text, 1, 20) AS summary, length(text) AS size FROM documents")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return graph.enrich(docs(spark, d), {"summary": lambda _: graph.summary("content"), "size": lambda _: F.length("content").cast("bigint")}).drop("content")


@query("w06_route", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'video' ELSE 'document' END AS adapter FROM documents")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", graph.adapter_route(F.expr("CASE doc_id % 3 WHEN 0 THEN 'Method' WHEN 1 THEN 'segment' ELSE 'text' END")).alias("adapter"))


def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(graph.document_nodes(doc_chunks(spark, d)))


def edges_of(n: DataFrame) -> DataFrame:
    rel = n.where("parent_node IS NOT NULL").select("node_id", F.create_map(F.lit("hasParent"), F.array("parent_node")).alias("relationships"))
    return graph.relation_edges(rel)


@query("g01_nodes", "SELECT 'conv:' || conv_id AS node_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def g01(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").select(F.concat(F.lit("conv:"), "conv_id").alias("node_id"), "role", F.col("turn").alias("ord"))
    return graph.last_nodes(n).select("node_id", "role")


S_EDGES = f"(SELECT {S_ID} || i AS s, {S_ID} || '0' AS t FROM {S_CHUNKS} WHERE i > 0)"


@query("g02_edges", f"SELECT s AS source, t AS target, 'hasParent' AS type, false AS is_reverse FROM {S_EDGES} UNION ALL SELECT t, s, 'hasChild', true FROM {S_EDGES}")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_reverse(chunk_edges(spark, d))


@query("g03_stats", f"SELECT (SELECT count(*) FROM {S_CHUNKS}) AS node_count, (SELECT count(*) FROM {S_EDGES}) AS edge_count")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(graph.document_nodes(doc_chunks(spark, d)), chunk_edges(spark, d))


@query("g04_vector_payload", f"SELECT {S_ID} || i AS node_id, content AS text, 8 AS size FROM {S_CHUNKS} WHERE length(trim(content)) > 0")
def g04(spark: SparkSession, d: str) -> DataFrame:
    p = graph.vector_payload(graph.document_nodes(doc_chunks(spark, d)))
    return p.select("node_id", "text", F.size("vector").alias("size"))


@query("g05_cypher", "SELECT 1 AS step, 'MERGE (n:`Na_tion` {id: ''it\\''s ' || n_name || '''})' AS statement FROM nation UNION ALL SELECT 2, 'MATCH (a {id: ''it\\''s ' || n_name || '''}), (b {id: ''' || r_name || '''}) MERGE (a)-[:`in`]->(b)' FROM nation JOIN region ON n_regionkey = r_regionkey")
def g05(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat(F.lit("it's "), "n_name")
    return graph.cypher(n.select(key.alias("node_id"), F.lit("Na:tion").alias("node_class")), n.select(key.alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("type")))


@query("g06_timeline", "SELECT 'c' || conv_id AS source, 'c' || conv_id || ':' || turn AS target, 'CONTAINS' AS type FROM conversations UNION ALL SELECT * FROM (SELECT 'c' || conv_id || ':' || turn, lead('c' || conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'NEXT' FROM conversations) WHERE n IS NOT NULL")
def g06(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("c"), "conv_id")
    return graph.timeline(table(spark, d, "conversations").select(F.concat(p, F.lit(":"), "turn").alias("node_id"), p.alias("parent_node"), "turn"), ["turn"])


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges from customers and suppliers to nations, and from nations to regions."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return c.unionByName(s).unionByName(n)


S_TRADE = "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
S_HOPS = f"WITH RECURSIVE e AS ({S_TRADE}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), k AS (SELECT 'r0' AS node, 0 AS hop UNION SELECT u.b, k.hop + 1 FROM k JOIN u ON u.a = k.node WHERE k.hop < 2) "


@query("v01_neighbourhood", S_HOPS + "SELECT node, min(hop) AS hop FROM k GROUP BY node")
def v01(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(trade(spark, d), spark.createDataFrame([("r0",)], "node string"), 2)


@query("v01_induced", S_HOPS + "SELECT a AS source, b AS target FROM e WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
def v01_induced(spark: SparkSession, d: str) -> DataFrame:
    t = trade(spark, d)
    return graph.induced(t, graph.neighbourhood(t, spark.createDataFrame([("r0",)], "node string"), 2))


@query(
    "v02_diff",
    "WITH o AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), "
    "j AS (SELECT coalesce(o.k, n.k) AS node_id, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v <> n.v THEN 'modified' ELSE 'normal' END AS status FROM o FULL JOIN n ON o.k = n.k) "
    "SELECT node_id, status, status <> 'modified' AND (node_id + 1) IN (SELECT node_id FROM j WHERE status = 'modified') AS impacted FROM j",
)
def v02(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node_id"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("version"))
    calls = o.select("node_id").distinct().select(F.col("node_id").alias("source"), (F.col("node_id") + 1).alias("target"), F.lit("CALLS").alias("type"))
    return graph.diff(o.where("y = 1995"), o.where("y = 1996"), calls)


@query("v04_phantoms", "SELECT DISTINCT 'c' || o_custkey AS node_id, 'External' AS node_class FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def v04(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"))
    return graph.phantom_nodes(known.unionByName(o.select(F.col("source").alias("node_id"))), o)


@query("v05_showcase", "SELECT doc_id AS node_id, substr(text, 1, 200) AS text, CAST(NULL AS VARCHAR) AS hidden FROM documents")
def v05(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.create_map(F.lit("text"), "text", F.lit("_raw"), "text").alias("attributes"))
    shown, _ = graph.showcase(n, n.select(F.col("node_id").alias("source"), F.col("node_id").alias("target")))
    return shown.select("node_id", F.col("attributes")["text"].alias("text"), F.col("attributes")["_raw"].alias("hidden"))


@query(
    "flagship",
    f"WITH n AS (SELECT {S_ID} || i AS node_id, CASE WHEN i = 0 THEN 'Topic' ELSE 'Text' END AS node_class FROM {S_CHUNKS}), e AS (SELECT s, 'hasParent' AS type FROM {S_EDGES} UNION ALL SELECT t, 'hasChild' FROM {S_EDGES}) "
    "SELECT node_class, type, count(*) AS n FROM n JOIN e ON n.node_id = e.s GROUP BY 1, 2",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to a graph, and its edges counted by the class of their source.

    One shuffle of texts to dedup them. What the graph is made of, without the texts, is then kept by a checkpoint, and
    nodes and edges are two looks at it: one shuffle joins them and one counts.
    """
    kept = cut(graph.document_nodes(doc_chunks(spark, d).withColumn("semantic_type", F.lit("text"))).select("node_id", "node_class", "parent_node"))
    nodes, e = kept.select("node_id", "node_class"), graph.with_reverse(edges_of(kept))
    return nodes.select(F.col("node_id").alias("source"), "node_class").join(e, "source").groupBy("node_class", "type").agg(F.count("*").alias("n"))
