"""Chunks to typed nodes and edges, and questions to the graph.

Nodes have at least (node_id, node_class); edges (source, target, type, confidence, origin).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import col
from docgraph.operators.lineage import cut

EDGE = ["source", "target", "type", "confidence", "origin"]


def safe_name(c: Column | str) -> Column:
    return F.translate(col(c), " :", "_")


def document_nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, node_class, friendly_name, content, parent_node) of chunks (chunk_id, source, parent_id, semantic_type, is_header, content).

    A chunk without an id goes by its content's MD5, one without content either by a random id.
    """
    prefix = F.concat(F.lit("doc:"), safe_name(F.coalesce("source", F.lit("unknown"))), F.lit(":"))
    own = F.coalesce(F.nullif(F.col("chunk_id").cast("string"), F.lit("")), F.when(F.length("content") > 0, F.md5("content")), F.uuid())
    kind = F.when(F.coalesce("is_header", F.lit(False)), "Topic").when(F.col("semantic_type") == "table", "Table").when(F.col("semantic_type") == "code_block", "Code").when(F.col("semantic_type") == "list_item", "ListItem").otherwise("Text")
    parent = F.when(F.col("parent_id").isNotNull(), F.concat(prefix, F.col("parent_id").cast("string")))
    return chunks.select(F.concat(prefix, own).alias("node_id"), kind.alias("node_class"), F.concat(kind, F.lit(" "), F.substring("content", 1, 30)).alias("friendly_name"), "content", parent.alias("parent_node"))


def video_nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, node_class, parent_node, title, start, end): a root per video, by its first chunk, and its segments with a start."""
    timed = chunks.where("start IS NOT NULL AND video_id IS NOT NULL")
    root = timed.groupBy("video_id").agg(F.min_by("title", F.struct("start", "chunk_id")).alias("title"))
    uri = F.concat(F.lit("video:"), F.col("video_id"))
    roots = root.select(uri.alias("node_id"), F.lit("Video").alias("node_class"), F.lit(None).cast("string").alias("parent_node"), "title", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    return roots.unionByName(timed.select(F.concat(uri, F.lit(":seg:"), "chunk_id").alias("node_id"), F.lit("Segment").alias("node_class"), uri.alias("parent_node"), "title", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))


CODE_CLASS = {"class_header": "Class", "class": "Class", "method": "Method", "function": "Function", "class_attributes": "AttributeBlock"}


def code_nodes(chunks: DataFrame) -> DataFrame:
    """Nodes of code chunks (see chunk.code_chunks), with a File node for every source.

    Chunks are cut here, since units and files both read them: sources are parsed once.
    """
    chunks = cut(chunks)
    kind = F.lit("CodeBlock")
    for k, v in CODE_CLASS.items():
        kind = F.when(F.col("semantic_type") == k, v).otherwise(kind)
    file = F.concat(F.lit("code:"), safe_name("source"))
    name = F.when(kind == "Class", F.col("symbol_name")).otherwise(F.concat_ws(".", "class_name", "symbol_name"))
    node = F.concat(file, F.lit("#"), F.when(kind.isin("Class", "Method", "Function"), name).otherwise(F.concat(kind, F.lit("_"), F.col("chunk_index"))))
    parent = F.when(kind.isin("Method", "AttributeBlock") & F.col("class_name").isNotNull(), F.concat(file, F.lit("#"), F.col("class_name"))).otherwise(file)
    units = chunks.where("error IS NULL").select("*", node.alias("node_id"), kind.alias("node_class"), parent.alias("parent_node"), F.col("source").alias("file_path"), F.col("chunk_index").alias("ord"))
    files = units.select("file_path").distinct().select(F.concat(F.lit("code:"), safe_name("file_path")).alias("node_id"), F.lit("File").alias("node_class"), "file_path", F.lit(-1).alias("ord"))
    return units.drop("source", "error").unionByName(files, allowMissingColumns=True)


def enrich(df: DataFrame, functions: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """A metadata column per name. For functions that may fail, use try_ forms of SQL: their failures are null."""
    return df.withColumns({k: f(df) for k, f in functions.items()})


def summary(c: Column | str, n: int = 20) -> Column:
    return F.substring(col(c), 1, n)


def hash_vector(c: Column | str, size: int = 8) -> Column:
    """A vector for a text, without a model: hashes with ``size`` seeds, in [-1, 1); null for no text."""
    text = F.replace(col(c), F.lit("\n"), F.lit(" "))
    each = [(F.pmod(F.xxhash64(F.lit(i), text), F.lit(20001)) / 10000.0 - 1).cast("float") for i in range(size)]
    return F.when(F.length(text) > 0, F.array(*each))


def adapter_route(kind: Column | str) -> Column:
    """Which node adapter fits a chunk's kind."""
    k = F.lower(col(kind))
    return F.when(k.isin("method", "function", "class", "class_header", "code"), "code").when(k.isin("segment", "video"), "video").otherwise("document")


# ---- edges


def edge(source: Column | str, target: Column | str, kind: Column | str, confidence: str = "HIGH", origin: str = "DIRECT") -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [col(source).alias("source"), col(target).alias("target"), kind.alias("type"), F.lit(confidence).alias("confidence"), F.lit(origin).alias("origin")]


def last_nodes(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """One row per id: the last by order."""
    rest = [c for c in nodes.columns if c != "node_id"]
    return nodes.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*[F.col(c) for c in rest if dict(nodes.dtypes)[c][:3] != "map"]))).alias("r")).select("node_id", "r.*")


def relation_edges(nodes: DataFrame) -> DataFrame:
    """Edges of the map ``relationships`` (predicate -> targets)."""
    out = nodes.select("node_id", F.explode("relationships").alias("kind", "targets"))
    return out.select("node_id", "kind", F.explode("targets").alias("t")).select(*edge("node_id", "t", F.col("kind"), origin="node_rel"))


def reverse_type(kind: Column) -> Column:
    return F.when(kind.contains("hasParent"), F.replace(kind, F.lit("hasParent"), F.lit("hasChild"))).when(kind.contains("belongsTo"), F.replace(kind, F.lit("belongsTo"), F.lit("contains"))).when(kind.contains("next"), F.replace(kind, F.lit("next"), F.lit("previous"))).otherwise(F.concat(kind, F.lit("_REV")))


def with_reverse(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, marked by is_reverse; one pass, no shuffle."""
    both = F.array(F.struct("source", "target", "type", F.lit(False).alias("is_reverse")), F.struct(F.col("target").alias("source"), F.col("source").alias("target"), reverse_type(F.col("type")).alias("type"), F.lit(True).alias("is_reverse")))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("node_id").alias("node_count")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))


def vector_payload(nodes: DataFrame, embed: Callable[[Column], Column] = hash_vector, text: str = "content") -> DataFrame:
    """(node_id, text, vector) of the nodes with text."""
    return nodes.where(F.length(F.trim(text)) > 0).select("node_id", F.col(text).alias("text"), embed(F.col(text)).alias("vector"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, statement): a MERGE for every node, then one for every edge, with ids quoted."""
    label = lambda c: F.translate(c, ":`", "_")
    n = nodes.select(F.lit(1).alias("step"), F.concat(F.lit("MERGE (n:`"), label(F.col("node_class")), F.lit("` {id: "), _quoted(F.col("node_id")), F.lit("})")).alias("statement"))
    e = edges.select(F.lit(2).alias("step"), F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("source")), F.lit("}), (b {id: "), _quoted(F.col("target")), F.lit("}) MERGE (a)-[:`"), label(F.col("type")), F.lit("`]->(b)")).alias("statement"))
    return n.unionByName(e)


def timeline(nodes: DataFrame, order: list[str], node: str = "node_id", parent: str = "parent_node") -> DataFrame:
    """(source, target, type): each parent CONTAINS its segments, and each segment's NEXT is its successor."""
    held = nodes.where(F.col(parent).isNotNull())
    contains = held.select(F.col(parent).alias("source"), F.col(node).alias("target"), F.lit("CONTAINS").alias("type"))
    after = F.lead(node).over(Window.partitionBy(parent).orderBy(*order))
    return contains.unionByName(held.select(F.col(node).alias("source"), after.alias("target"), F.lit("NEXT").alias("type")).where("target IS NOT NULL"))


class CodeGraph:
    """Edges of code nodes, rule by rule; each rule is joins on keys, so that Catalyst may pick how.

    A symbol is unique if it has exactly one entry. Where several rules may name a target the order is same class, same
    file, the unique one.
    """

    #: The facts that each rule reads, besides OF_ALL.
    READS = {
        "contains": [], "imports": ["imports"], "calls": ["calls"], "maybe_calls": ["attribute_calls"], "inherits": ["inherits_from"], "overrides": ["inherits_from"],
        "uses_type": ["type_refs"], "mutates_global": ["module_vars", "globals_declared"], "raises": ["raises"], "exposes": ["module_all"],
    }
    OF_ALL = ["semantic_type", "symbol_name", "class_name", "is_async", "decorators"]

    def __init__(self, nodes: DataFrame, held: bool = False) -> None:
        nodes = nodes if held else cut(nodes)  # all rules read them; those of code_nodes are held already
        self.nodes = nodes
        self.symbols = nodes.where("symbol_name IS NOT NULL AND node_class IN ('Class', 'Function', 'Method')").select("node_id", "symbol_name", "file_path", "class_name", "node_class", "is_async", "decorators", "ord")
        self.classes = nodes.where("node_class = 'Class'")

    def _first(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by("node_id", "ord").alias("hit"), F.max_by("is_async", "ord").alias("hit_async"))

    def _unique(self, df: DataFrame) -> DataFrame:
        return df.groupBy("symbol_name").agg(F.count("*").alias("n"), F.first("node_id").alias("hit"), F.first("is_async").alias("hit_async")).where("n = 1").drop("n")

    def contains(self) -> DataFrame:
        files = self.nodes.where("node_class = 'File'").select(F.col("node_id").alias("f"), "file_path")
        return self.nodes.where("node_class <> 'File'").join(files, "file_path").select(*edge("f", "node_id", "CONTAINS"))

    def imports(self, roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
        """Relative by level, absolute by package root, then by path suffix; the imported symbol, else its file.

        The suffix rule is an equi join: each file's path gives all its suffixes.
        """
        files = self.nodes.where("node_class = 'File'").select(F.col("node_id").alias("f"), "file_path", F.regexp_replace("file_path", r"(/__init__)?\.\w+$", "").alias("stem"))
        want = self.nodes.where("imports IS NOT NULL").select("node_id", "file_path", F.explode("imports").alias("i")).select("node_id", "file_path", "i.*").withColumn("uid", F.xxhash64("node_id", "module", "name", "level"))
        path = F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/"))
        dirs = F.split("file_path", "/")
        base = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - F.col("level"), F.lit(0))), "/")
        stem = F.when(F.col("level") > 0, F.ltrim(F.lit("/"), F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(path, F.lit("")))))
        exact = [stem, *[F.when(F.col("level") == 0, F.concat(F.lit(r), path)) for r in roots]]
        tries = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(2 * k).alias("rank"), s.alias("stem"))) for k, s in enumerate(exact)], *[F.when(s.isNotNull() & F.col("name").isNotNull(), F.struct(F.lit(2 * k + 1).alias("rank"), F.concat_ws("/", F.nullif(s, F.lit("")), "name").alias("stem"))) for k, s in enumerate(exact)]))
        first = want.select("*", F.explode(tries).alias("t")).select("uid", "t.*").join(files.select("f", "file_path", "stem").withColumnRenamed("file_path", "target_path"), "stem")
        parts = F.split("stem", "/")
        ends = files.select("f", F.col("file_path").alias("target_path"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("stem"))
        second = want.where("level = 0 AND module IS NOT NULL").select("uid", F.lit(100).alias("rank"), path.alias("stem")).join(ends, "stem")
        found = first.unionByName(second, allowMissingColumns=True).groupBy("uid").agg(F.min_by(F.struct("f", "target_path"), F.struct("rank", "target_path")).alias("t"))
        symbol = self._first(self.symbols.where("node_class <> 'Method'"), "file_path", "symbol_name").select(F.col("file_path").alias("target_path"), F.col("symbol_name").alias("name"), "hit")
        out = want.join(found, "uid").select("node_id", "name", "t.*").join(symbol, ["target_path", "name"], "left")
        return out.select(*edge("node_id", F.coalesce("hit", "f"), "IMPORTS")).distinct()

    def calls(self) -> DataFrame:
        """With async_mismatch where a plain function calls an async one."""
        want = self.nodes.where("calls IS NOT NULL").select("node_id", "file_path", "class_name", F.coalesce("is_async", F.lit(False)).alias("a"), F.explode("calls").alias("symbol_name"))
        own = self._first(self.symbols.where("class_name IS NOT NULL"), "file_path", "class_name", "symbol_name").withColumnsRenamed({"hit": "h1", "hit_async": "a1"})
        file = self._first(self.symbols.where("node_class <> 'Method'"), "file_path", "symbol_name").withColumnsRenamed({"hit": "h2", "hit_async": "a2"})
        unique = self._unique(self.symbols).withColumnsRenamed({"hit": "h3", "hit_async": "a3"})
        out = want.join(own, ["file_path", "class_name", "symbol_name"], "left").join(file, ["file_path", "symbol_name"], "left").join(unique, "symbol_name", "left")
        hit = F.coalesce("h1", "h2", "h3")
        to_async = F.when(F.col("h1").isNotNull(), F.col("a1")).when(F.col("h2").isNotNull(), F.col("a2")).otherwise(F.col("a3"))
        return out.where(hit.isNotNull() & (hit != F.col("node_id"))).select(*edge("node_id", hit, "CALLS"), (~F.col("a") & F.coalesce(to_async, F.lit(False))).alias("async_mismatch"))

    def maybe_calls(self) -> DataFrame:
        """Attribute calls of a unique symbol that is no property."""
        prop = self.symbols.where(F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d == "property")).select("symbol_name").distinct()
        want = self.nodes.where("attribute_calls IS NOT NULL").select("node_id", F.explode("attribute_calls").alias("full")).select("node_id", F.substring_index("full", ".", -1).alias("symbol_name"))
        out = want.join(self._unique(self.symbols), "symbol_name").join(prop, "symbol_name", "left_anti")
        return out.where("hit <> node_id").select(*edge("node_id", "hit", "MAYBE_CALLS", "LOW", "INFERRED"))

    def _to_class(self, column: str) -> DataFrame:
        want = self.nodes.where(F.col(column).isNotNull()).select("node_id", "file_path", F.explode(column).alias("full")).withColumn("symbol_name", F.substring_index("full", ".", -1))
        same = self._first(self.classes, "file_path", "symbol_name").select("file_path", "symbol_name", F.col("hit").alias("h1"))
        unique = self._unique(self.classes).select("symbol_name", F.col("hit").alias("h2"))
        out = want.join(same, ["file_path", "symbol_name"], "left").join(unique, "symbol_name", "left")
        return out.select("node_id", F.coalesce("h1", "h2").alias("hit")).where("hit IS NOT NULL AND hit <> node_id")

    def inherits(self) -> DataFrame:
        return self._to_class("inherits_from").select(*edge("node_id", "hit", "INHERITS"))

    def uses_type(self) -> DataFrame:
        return self._to_class("type_refs").select(*edge("node_id", "hit", "USES_TYPE", "MEDIUM", "INFERRED"))

    def overrides(self) -> DataFrame:
        """Of a method in a class and in the class it inherits from; with ``abstract`` by the parent's decorators."""
        method = self.nodes.where("node_class = 'Method'").select("node_id", "symbol_name", F.col("parent_node").alias("owner"), "decorators")
        child = method.select(F.col("node_id").alias("c"), "symbol_name", F.col("owner").alias("source"))
        parent = method.select(F.col("node_id").alias("p"), "symbol_name", F.col("owner").alias("target"), "decorators")
        out = self.inherits().select("source", "target").join(child, "source").join(parent, ["target", "symbol_name"])
        abstract = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: F.substring_index(d, ".", -1) == "abstractmethod")
        return out.select(*edge("c", "p", "OVERRIDES"), abstract.alias("abstract"))

    def mutates_global(self) -> DataFrame:
        var = self.nodes.where("module_vars IS NOT NULL").select(F.col("node_id").alias("b"), "file_path", F.explode("module_vars").alias("v"), "ord").groupBy("file_path", "v").agg(F.min_by("b", "ord").alias("b"))
        want = self.nodes.where("globals_declared IS NOT NULL").select("node_id", "file_path", F.explode("globals_declared").alias("v"))
        return want.join(var, ["file_path", "v"]).select(*edge("node_id", "b", "MUTATES_GLOBAL"))

    def raises(self) -> DataFrame:
        return self.nodes.where("raises IS NOT NULL").select("node_id", F.explode("raises").alias("x")).select(*edge("node_id", F.concat(F.lit("exception:"), "x"), "RAISES"))

    def exposes(self) -> DataFrame:
        """What ``__all__`` names: a symbol of the same file, else the unique one."""
        want = self.nodes.where("module_all IS NOT NULL").select(F.concat(F.lit("code:"), safe_name("file_path")).alias("f"), "file_path", F.explode("module_all").alias("symbol_name"))
        same = self._first(self.symbols.where("node_class <> 'Method'"), "file_path", "symbol_name").select("file_path", "symbol_name", F.col("hit").alias("h1"))
        unique = self._unique(self.symbols).select("symbol_name", F.col("hit").alias("h2"))
        out = want.join(same, ["file_path", "symbol_name"], "left").join(unique, "symbol_name", "left")
        return out.select("f", F.coalesce("h1", "h2").alias("hit")).where("hit IS NOT NULL").select(*edge("f", "hit", "EXPOSES"))

    def edges(self) -> DataFrame:
        """All rules' edges, as a bag."""
        rules = [self.contains, self.imports, self.calls, self.maybe_calls, self.inherits, self.overrides, self.uses_type, self.mutates_global, self.raises, self.exposes]
        out = rules[0]()
        for r in rules[1:]:
            out = out.unionByName(r(), allowMissingColumns=True)
        return out


# ---- questions


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, hop): nodes within ``depth`` undirected steps of the seeds (node), with the least number of steps.

    Edges are read and made undirected once. Each hop joins the frontier alone to them and ends in a reliable checkpoint,
    so that plans don't grow with the depth.
    """
    both = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    seen = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("a"))
        fresh = front.join(both, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """The edges with both ends among the nodes."""
    keep = nodes.select(F.col(node).alias("__n")).distinct()
    return edges.join(keep, F.col("source") == F.col("__n"), "left_semi").join(keep, F.col("target") == F.col("__n"), "left_semi")


def diff(old: DataFrame, new: DataFrame, edges: DataFrame, key: str = "node_id", version: str = "version") -> DataFrame:
    """(key, status, impacted): added, removed, modified or normal; impacted calls something modified."""
    o, n = old.select(key, F.col(version).alias("__o"), F.lit(1).alias("__a")), new.select(key, F.col(version).alias("__v"), F.lit(1).alias("__b"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__v")), "modified").otherwise("normal")
    out = o.join(n, key, "full_outer").select(key, status.alias("status"))
    calls = edges.where("type = 'CALLS'").join(out.where("status = 'modified'").select(F.col(key).alias("target")), "target", "left_semi")
    hit = calls.select(F.col("source").alias(key)).distinct().withColumn("impacted", F.lit(True))
    return out.join(hit, key, "left").withColumn("impacted", F.coalesce("impacted", F.lit(False)) & (F.col("status") != "modified"))


def phantom_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, node_class) for ends of edges that are no nodes, typed by their ids."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    c = F.col("node_id")
    kind = F.when(c.startswith("exception:"), "Exception").when(c.contains("#"), "Symbol").when(c.startswith("code:"), "File").otherwise("External")
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", kind.alias("node_class"))


def showcase(nodes: DataFrame, edges: DataFrame, attributes: str = "attributes", limit: int = 200, hidden: tuple[str, ...] = ("_", "meta:")) -> tuple[DataFrame, DataFrame]:
    """Nodes with attributes cut at ``limit`` characters and hidden ones left out, and the edges that don't dangle."""
    shown = F.map_filter(F.transform_values(attributes, lambda k, v: F.substring(v, 1, limit)), lambda k, v: ~F.reduce(F.array(*[F.lit(h) for h in hidden]), F.lit(False), lambda a, h: a | k.startswith(h)))
    return nodes.withColumn(attributes, shown), induced(edges, nodes, "node_id")
