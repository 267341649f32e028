"""Chunkers: one row to many, as DataFrame operators."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import kernels
from docgraph.operators.lineage import free_name


def fixed_chunks(df: DataFrame, size: int = 1000, overlap: int = 0, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, part_index, content): windows at 0, step, 2 step and so on, as long as they start within the text."""
    return _windows(df, size, overlap, content, id_col).select(id_col, "part_index", "content")


def _windows(df: DataFrame, size: int, overlap: int, content: str, id_col: str) -> DataFrame:
    kernels.check_sizes(size, overlap)
    at = F.sequence(F.lit(0), F.length(content) - 1, F.lit(size - overlap))
    out = df.where(F.length(content) > 0).select(id_col, F.col(content).alias("__t"), F.posexplode(at).alias("part_index", "__s"))
    return out.select(id_col, "part_index", F.substring("__t", F.col("__s") + 1, F.lit(size)).alias("content"), F.length("__t").alias("original_length"))


def audited_chunks(df: DataFrame, size: int = 1000, overlap: int = 0, version: str = "1.0", content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """fixed_chunks with the text's own length, also where rows repeat an id, a version and the time."""
    return _windows(df, size, overlap, content, id_col).withColumns({"version": F.lit(version), "processed_at": F.current_timestamp()})


def structure_sections(df: DataFrame, separator: str = r"\n\n", content: str = "content", id_col: str = "doc_id", size: int | None = None) -> DataFrame:
    """(id, section, part, content): sections between matches, stripped; empty ones go but count.

    Sections over ``size`` characters are split on, with an overlap of 50.
    """
    out = df.select(id_col, F.posexplode(F.split(content, separator)).alias("section", "content")).withColumn("content", tx.strip("content")).where("content <> ''")
    if size is None:
        return out.withColumn("part", F.lit(0)).select(id_col, "section", "part", "content")
    parts = F.when(F.length("content") <= size, F.array("content")).otherwise(recursive_pieces(size, 50)(F.col("content")))
    return out.select(id_col, "section", F.posexplode(parts).alias("part", "content"))


#: Texts, and bytes of them, whose pieces a Python worker holds at a time.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 20


def slices(batch: Any, texts: pa.Array) -> Iterator[Any]:
    """An Arrow batch or array in slices, so that what is made of it is small, however many texts come at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        end = min(max(end, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


def text_udf(kernel: Callable[[str | None], Any], kind: str) -> Callable[[Column], Column]:
    """An Arrow UDF from texts to what the kernel makes of each, slice by slice."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    made = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], made)
            for part in slices(batch, batch):
                yield pa.array([kernel(t) for t in part.to_pylist()], made)

    return run


def recursive_pieces(size: int = 1000, overlap: int = 100, separators: list[str] | None = None, protected: list[str] | None = None, merge: bool = True) -> Callable[[Column], Column]:
    """A UDF from texts to their chunks."""
    kernels.check_sizes(size, overlap)
    if protected:
        return text_udf(lambda t: kernels.protected_split(t or "", protected, size, overlap), "array<string>")
    return text_udf(lambda t: kernels.recursive_split(t or "", size, overlap, separators, merge), "array<string>")


def recursive_chunks(df: DataFrame, size: int = 1000, overlap: int = 100, content: str = "content", id_col: str = "doc_id", **options: Any) -> DataFrame:
    """(chunk_id, id, part_index, content): greedy packing by ever finer separators."""
    parts = df.select(id_col, F.posexplode(recursive_pieces(size, overlap, **options)(F.col(content))).alias("part_index", "content"))
    return parts.select(F.concat_ws("_part_", F.col(id_col).cast("string"), "part_index").alias("chunk_id"), id_col, "part_index", "content")


def interval_chunks(records: DataFrame, intervals: DataFrame, scope: list[str], time: str, order: list[str], text: str, bins: int = 1000) -> DataFrame:
    """Groups of records by half-open chapters (title, start_time, end_time); records between chapters stay in the open one.

    Both sides are cut into time bins and joined by those, so that a record only meets the chapters of its bin.
    """
    c, inside = F.col, (F.col(time) >= F.col("start_time")) & (F.col(time) < F.col("end_time"))
    low, high = intervals.agg(F.min("start_time"), F.max("end_time")).first()
    low, high = (0.0, 0.0) if low is None or high is None else (float(low), float(high))
    width = max((high - low) / bins, 1e-9)
    at = lambda x: F.floor((x - F.lit(low)) / width)
    a, b = free_name(records, "__a"), free_name(records, "__b")
    cut = intervals.where("start_time < end_time").withColumn(b, F.explode(F.sequence(at(c("start_time")), at(c("end_time")))))
    joined = records.withColumn(a, at(c(time))).join(cut, (c(a) == c(b)) & inside, "left").drop(a, b)
    carried = F.last("title", ignorenulls=True).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return record_groups(joined.withColumn("title", carried), [*scope, "title"], time, order, text)


def window_chunks(records: DataFrame, scope: list[str], time: str, size: float, order: list[str], text: str) -> DataFrame:
    """Groups of records by tumbling windows of ``size``."""
    return record_groups(records.withColumn("bucket", F.floor(F.col(time) / size)), [*scope, "bucket"], time, order, text)


def record_groups(records: DataFrame, keys: list[str], time: str, order: list[str], text: str, duration: str | None = None) -> DataFrame:
    """A chunk per group: texts joined by blanks in order, start, end (the last start and its duration) and count."""
    last = F.max_by(F.col(time) + (F.col(duration) if duration else F.lit(0)), F.struct(*order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"]), " ")
    return records.groupBy(*keys).agg(texts.alias("content"), F.min(time).alias("start"), last.alias("end"), F.count("*").alias("n"))


_MD = "array<struct<index:int,content:string,kind:string,level:int,parent:int,section:string>>"


def markdown_chunks(df: DataFrame, size: int = 1000, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, index, content, kind, level, parent, section) of Markdown texts."""
    split = text_udf(lambda t: kernels.markdown_split(t or "", size), _MD)
    return df.select(id_col, F.explode(split(F.col(content))).alias("c")).select(id_col, "c.*")


def histogram(bins: int = 10) -> Callable[[Column], Column]:
    """A UDF from texts to histograms, of length one, of their character codes modulo ``bins``.

    Built-in functions can count them too, but need an array of all characters for each bin: 80 times the time.
    """

    return text_udf(lambda t: character_histogram(t or "", bins), "array<double>")


def character_histogram(text: str, bins: int = 10) -> np.ndarray:
    n = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % bins, minlength=bins).astype(float)
    return n / max(np.linalg.norm(n), 1e-300)


def semantic_chunks(df: DataFrame, threshold: float = 0.5, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, part_index, content, n): sentences, joined as long as each is like the one before.

    Sentences end at ". " or a newline; two are alike if the cosine of their histograms reaches the threshold.
    """

    def one(text: str | None) -> list[dict[str, Any]]:
        parts = [p for x in (text or "").replace("\n", ". ").split(". ") if (p := x.strip(tx.SPACES))]
        if not parts:
            return []
        v = np.stack([character_histogram(p) for p in parts])
        new = np.append(True, np.round(np.einsum("ij,ij->i", v[1:], v[:-1]), 9) < threshold)
        first = np.flatnonzero(new).tolist()
        return [{"content": ". ".join(parts[a:b]), "n": b - a} for a, b in zip(first, [*first[1:], len(parts)], strict=True)]

    split = text_udf(one, "array<struct<content:string,n:bigint>>")
    out = df.select(id_col, F.posexplode(split(F.col(content))).alias("part_index", "c"))
    return out.select(id_col, F.col("part_index").cast("bigint").alias("part_index"), "c.*")


def parent_child_chunks(df: DataFrame, parent_size: int = 2000, child_size: int = 400, content: str = "content", id_col: str = "doc_id", fixed: bool = False) -> DataFrame:
    """(chunk_id, parent_id, is_parent, content, child_ids): parents, and children cut from each.

    A parent's children are cut and named in its own row: rows that repeat an id have parents of the same name, each with
    its own children.
    """
    key = F.col(id_col).cast("string")
    parents = fixed_chunks(df, parent_size, 0, content, id_col) if fixed else recursive_chunks(df, parent_size, 0, content, id_col)
    parents = parents.select(F.concat(key, F.lit("_parent_"), "part_index").alias("parent_id"), "content")
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(child_size))
    pieces = F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(child_size))) if fixed else recursive_pieces(child_size, 0)(F.col("content"))
    name = lambda i: F.concat("parent_id", F.lit("_c"), i.cast("string"))
    cut = parents.withColumn("pieces", pieces).withColumn("ids", F.transform("pieces", lambda x, i: name(i)))
    none = F.lit(None).cast("string")
    own = F.struct(F.col("parent_id").alias("chunk_id"), none.alias("parent_id"), F.lit(True).alias("is_parent"), "content", F.when(F.size("ids") > 0, F.col("ids")).alias("child_ids"))
    children = F.transform("pieces", lambda x, i: F.struct(name(i).alias("chunk_id"), F.col("parent_id"), F.lit(False).alias("is_parent"), x.alias("content"), F.lit(None).cast("array<string>").alias("child_ids")))
    return cut.select(F.explode(F.concat(F.array(own), children)).alias("c")).select("c.*")


_JSON = "struct<parts:array<struct<content:string,json_path:string,first:int,last:int,count:int>>,error:string>"


def json_chunks(df: DataFrame, size: int = 1000, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, part_index, content, json_path, first, last, count, error) of JSON texts; texts that are none give no row."""

    def one(text: str | None) -> dict[str, Any]:
        parts, error = kernels.contained(lambda t: kernels.json_split(kernels.load_json(t or ""), size), text)
        return {"parts": parts, "error": error}

    split = text_udf(one, _JSON)
    out = df.select(id_col, split(F.col(content)).alias("s")).select(id_col, F.posexplode_outer("s.parts").alias("part_index", "c"), "s.error")
    return out.where("c IS NOT NULL OR error IS NOT NULL").select(id_col, "part_index", "c.*", "error")


CODE_SCHEMA = (
    "semantic_type string, symbol_name string, class_name string, line_start int, line_end int, content string, is_async boolean, is_generator boolean, return_type string, "
    "calls array<string>, attribute_calls array<string>, type_refs array<string>, decorators array<string>, raises array<string>, catches array<string>, globals_declared array<string>, inherits_from array<string>, "
    "module_vars array<string>, module_all array<string>, instance_attrs array<string>, imports array<struct<module:string,name:string,alias:string,level:int>>, params array<struct<name:string,kind:string,type_annotation:string,has_default:boolean>>"
)


def code_chunks(files: DataFrame, source: str = "source", content: str = "content", facts: list[str] | None = None) -> DataFrame:
    """(source, language, chunk_index, error, facts) of source files; the language goes by the extension, else Python.

    ``facts`` names those of CODE_SCHEMA that are wanted, all if it is None. The facts of a few files are held at a time.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    every = T.StructType.fromDDL(f"source string, language string, chunk_index int, error string, {CODE_SCHEMA}")
    schema = T.StructType([f for i, f in enumerate(every) if i < 4 or facts is None or f.name in facts])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("content")):
                rows = []
                for path, code in zip(part.column("source").to_pylist(), part.column("content").to_pylist(), strict=True):
                    language = kernels.language_of(path or "")
                    units, error = kernels.contained(kernels.code_units, code or "", language)
                    rows += [u | {"source": path, "language": language, "chunk_index": i, "error": error} for i, u in enumerate(units or ([kernels._facts()] if error else []))]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

    return files.select(F.col(source).alias("source"), F.col(content).alias("content")).mapInArrow(run, schema)


def code_route(extension: Column | str) -> Column:
    """The splitter of a file extension; Python's for any other."""
    out = F.lit("python")
    for ext, language in kernels.LANGUAGES.items():
        out = F.when(F.lower(tx.col(extension)) == ext, language).otherwise(out)
    return out


def whole_chunks(df: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """Every text one chunk: the place of a splitter that asks a language model."""
    return df.select(id_col, F.lit(0).alias("part_index"), F.col(content).alias("content"))


def page_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, part_index, content): every page with content of parsed documents (see office.parse_documents) a chunk."""
    from docgraph.operators.refine import document_markdown

    return document_markdown(docs).where("type = 'md'").select("doc_id", F.col("block_idx").alias("part_index"), "content")


def flatten_items(df: DataFrame, items: str, meta: str, item_meta: str = "metadata") -> DataFrame:
    """A row for every item of an array of (content, metadata); the item's metadata win over the parent's."""
    out = df.withColumn("__i", F.explode(items))
    kept = F.map_filter(meta, lambda k, v: ~F.map_contains_key(F.col("__i")[item_meta], k))
    return out.withColumns({"content": F.col("__i.content"), meta: F.map_concat(kept, F.col("__i")[item_meta])}).drop("__i", items)


def word_windows(df: DataFrame, size: int = 5, overlap: int = 2, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, part_index, content): windows of words; the last may be short."""
    kernels.check_sizes(size, overlap)
    words = df.select(id_col, F.regexp_extract_all(content, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    out = words.select(id_col, "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))).alias("part_index", "s"))
    return out.select(id_col, "part_index", F.array_join(F.slice("w", F.col("s") + 1, F.lit(size)), " ").alias("content"))


def line_sections(df: DataFrame, starts: str, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, section, content): a new section at every line that the pattern, one of Python's, matches.

    Sections are numbered by such lines: what is before the first has number 0.
    """

    begins = re.compile(starts)

    def one(text: str | None) -> list[dict[str, Any]]:
        if text is None:
            return []
        lines = text.split("\n")
        first = [i for i, line in enumerate(lines) if begins.search(line)]
        out = [(0, lines[: first[0] if first else len(lines)])] if not first or first[0] else []
        out += [(k + 1, lines[a:b]) for k, (a, b) in enumerate(zip(first, [*first, len(lines)][1:], strict=True))]
        return [{"section": k, "content": "\n".join(part)} for k, part in out]

    split = text_udf(one, "array<struct<section:bigint,content:string>>")
    return df.select(id_col, F.explode(split(F.col(content))).alias("c")).select(id_col, "c.*")


def sentences(df: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, i, sentence): stretches up to a full stop, question or exclamation mark."""
    return df.select(id_col, F.posexplode(F.regexp_extract_all(content, F.lit(r"[^.!?\s][^.!?]*[.!?]*"), F.lit(0))).alias("i", "sentence"))


def cluster_sentences(vectors: DataFrame, k: int = 2, seed: int = 1, features: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, cluster) of rows with a vector, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(id_col, array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(id_col, F.col("prediction").alias("cluster"))


def topic_chunks(df: DataFrame, topics: int = 3, seed: int = 1, terms: int = 5, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(id, topic, words): each text's likeliest topic, with the topic's weightiest words.

    All words count, however rare, and no list of them is in one place (see topics.Topics). Texts without a word have no
    row.
    """
    from docgraph.operators.topics import Topics

    found = F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}+"), F.lit(0))
    keyed = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, content).alias("d"), F.col(content).alias("content"))
    model = Topics(keyed.select("id", "d", F.transform(found, lambda x: F.xxhash64(x)).alias("w")), topics, seed, terms)
    best = model.heaviest()
    wanted = sorted({h for b in best for h in b})
    few = keyed.join(F.broadcast(model.holding(wanted)), "d", "left_semi").select(F.explode(found).alias("w")).distinct()
    of = dict(few.where(F.xxhash64("w").isin(wanted)).groupBy(F.xxhash64("w").alias("h")).agg(F.min("w").alias("w")).collect())
    names = F.array(*[F.lit(json.dumps([of[h] for h in b])) for b in best])
    return model.topics().select(F.col("id").alias(id_col), "topic", F.element_at(names, F.col("topic") + 1).alias("words"))
