"""Raw documents, pages and records to clean blocks."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions import text as tx
from docgraph.operators.lineage import free_name

ELEMENT = "struct<type:string, text:string, data:array<array<string>>, semantic_type:string, heading_level:int, list_level:int, ocr_text:string>"
PAGES = f"array<struct<page_num:int, elements:array<{ELEMENT}>, header_elements:array<{ELEMENT}>, footer_elements:array<{ELEMENT}>>>"


def text_markdown(e: Column) -> Column:
    """A text element: list item, heading, title or plain text."""
    kind, body = e["semantic_type"], F.coalesce(e["text"], F.lit(""))
    item = F.concat(F.repeat(F.lit("  "), F.coalesce(e["list_level"], F.lit(0))), F.lit("- "), body)
    return F.when(kind.isin("list", "list_item"), item).when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(e["heading_level"], F.lit(1))), F.lit(" "), body)).when(kind == "title", F.concat(F.lit("# "), body)).otherwise(body)


def table_markdown(data: Column) -> Column:
    """Rows as a Markdown table; short rows are padded, the first is the header; nothing for no rows."""
    width = F.array_max(F.transform(data, F.size))

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.concat(F.transform(row, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(row))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0))), line)
    return F.when((F.size(data) > 0) & (width > 0), F.array_join(F.concat(F.array(line(data[0]), rule), body), "\n")).otherwise("")


def element_markdown(e: Column) -> Column:
    """Any element but an image as Markdown."""
    chart = F.concat(F.lit("```\n"), F.coalesce(e["text"], F.lit("")), F.lit("\n```"))
    return F.when(e["type"] == "text", text_markdown(e)).when(e["type"] == "table", table_markdown(e["data"])).when(e["type"] == "chart", chart)


def document_markdown(docs: DataFrame, headers: bool = True, footers: bool = False) -> DataFrame:
    """(doc_id, block_idx, type, content): a Markdown block for every page with content, and one for every image.

    Parts are joined by a blank line; vertical tabs, form feeds and carriage returns become newlines.
    """
    none = F.array().cast(f"array<{ELEMENT}>")
    page = docs.select("doc_id", F.posexplode("pages").alias("page_idx", "page"))
    parts = F.concat(F.coalesce(F.col("page.header_elements"), none) if headers else none, F.coalesce(F.col("page.elements"), none), F.coalesce(F.col("page.footer_elements"), none) if footers else none)
    page = page.select("doc_id", "page_idx", parts.alias("parts"))
    body = F.filter(F.transform(F.filter("parts", lambda e: e["type"] != "image"), element_markdown), lambda x: F.length(x) > 0)
    text = page.select("doc_id", F.col("page_idx").alias("block_idx"), F.lit("md").alias("type"), F.regexp_replace(F.array_join(body, "\n\n"), r"[\x0B\f\r]", "\n").alias("content")).where("content <> ''")
    images = page.select("doc_id", F.col("page_idx").alias("block_idx"), F.explode(F.filter("parts", lambda e: e["type"] == "image")).alias("e"))
    shown = images.select("doc_id", "block_idx", F.lit("image_base64").alias("type"), F.coalesce(F.nullif("e.ocr_text", F.lit("")), F.lit("image")).alias("content"))
    return text.unionByName(shown)


def front_matter(title: Column | str, author: Column | str) -> Column:
    """A front-matter block of those of the two that are there; empty for neither."""
    t, a = tx.col(title), tx.col(author)
    lines = F.concat(F.when(t.isNotNull(), F.concat(F.lit("title: "), t, F.lit("\n"))).otherwise(""), F.when(a.isNotNull(), F.concat(F.lit("author: "), a, F.lit("\n"))).otherwise(""))
    return F.when(lines != "", F.concat(F.lit("---\n"), lines, F.lit("---\n"))).otherwise("")


HIDDEN = "script|style|noscript|iframe|head"


def html_text(html: Column | str) -> Column:
    """The visible text of a page: comments and hidden elements go, tags become newlines, three newlines or more two."""
    out = F.regexp_replace(tx.col(html), r"(?s)<!--.*?-->", "")
    for tag in HIDDEN.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    return tx.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def html_title(html: Column | str) -> Column:
    return tx.strip(F.regexp_extract(tx.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_meta(html: Column | str) -> Column:
    """The page's meta tags with a name or property and a content, quoted by double quotes, as a map; the first of a name counts."""
    text = tx.col(html)
    named = lambda first, second, at: F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(rf'(?is)<meta\s[^>]*?{first}[^>]*?\s{second}[^>]*>'), F.lit(at)).alias("k"), F.regexp_extract_all(text, F.lit(rf'(?is)<meta\s[^>]*?{first}[^>]*?\s{second}[^>]*>'), F.lit(3 - at)).alias("v")),
        lambda x: F.struct(F.lower(x["k"]).alias("key"), x["v"].alias("value")),
    )
    name, content = r'(?:name|property)="([^"]*)"', r'content="([^"]*)"'
    found = F.concat(named(name, content, 1), named(content, name, 2))
    keys = F.transform(found, lambda x: x["key"])
    return F.map_from_entries(F.filter(found, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


ID_KEYS = ("id", "_id", "uuid", "video_id", "uid", "original_id")


def normalize_records(df: DataFrame, record: str = "record", content_key: str | None = None) -> DataFrame:
    """JSON objects to (record_id, content_field, content, meta).

    The content is the field ``content_key``, or the one list that is not empty if there is exactly one, or the whole
    record; all other fields are metadata. The id is the first of the known id fields that the record has.
    """
    fields = F.from_json(F.col(record), "map<string,string>")
    lists = F.filter(F.map_keys("fields"), lambda k: F.col("fields")[k].rlike(r"(?s)^\[.*\S.*\]$"))
    key = F.lit(content_key) if content_key else F.when(F.size(lists) == 1, lists[0])
    out = df.withColumn("fields", fields).withColumn("content_field", key)
    found = F.coalesce(*[F.col("fields")[k] for k in ID_KEYS])
    content = F.coalesce(F.when(F.col("content_field").isNotNull(), F.col("fields")[F.col("content_field")]), F.col(record))
    meta = F.map_filter("fields", lambda k, v: ~k.eqNullSafe(F.col("content_field")))
    return out.select(*df.columns, found.alias("record_id"), "content_field", content.alias("content"), meta.alias("meta")).drop(record)


def rows_to_block(df: DataFrame, source: str, order: list[str], record: Column) -> DataFrame:
    """One block per source: its records in order as a JSON list, and their number."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, record.alias("__r"))))
    return df.groupBy(source).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["__r"]), ","), F.lit("]")).alias("content"), F.count("*").alias("record_count"))


def json_blocks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One block per object of a JSON list (or of a single object); items that are no objects are skipped."""
    text = tx.strip(payload)
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    exploded = df.select(*[c for c in df.columns if c != payload], F.posexplode(items).alias("block_idx", "content"))
    return exploded.where(tx.strip("content").startswith("{"))


def normalizer_route(kind: Column | str, content: Column | str) -> Column:
    """Which normaliser fits: html, markdown document, record or raw JSON, by type and look."""
    k, text = tx.col(kind), tx.strip(content)
    return F.when((k == "html") | text.rlike(r"(?i)^<(!doctype|html)"), "html").when(k == "document", "markdown").when((k == "record") | text.startswith("{"), "record").when(text.startswith("["), "raw_json").otherwise("markdown")


def dedup_blocks(df: DataFrame, content: str, order: list[str], scope: list[str] | None = None, shortest: int = 5) -> DataFrame:
    """The first of equal contents in each scope; contents under ``shortest`` characters always stay.

    Exact and null-safe: contents are compared by their SHA-256, null contents always stay.
    """
    stays = F.col(content).isNull() | (F.length(content) < shortest)
    key = F.when(stays, F.xxhash64(*order).cast("string")).otherwise(F.sha2(content, 256))  # what stays anyway is spread, however much of it there is
    n = free_name(df, "__n")
    w = Window.partitionBy(*(scope or []), key).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).where((F.col(n) == 1) | stays).drop(n)


def impute(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Fields that are null, or absent, get their default."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def handle_outliers(df: DataFrame, rules: dict[str, dict[str, Any]]) -> DataFrame:
    """Drops rows, or clamps values, outside [min, max]; null and non-numeric values pass."""
    for field, rule in rules.items():
        v = F.expr(f"try_cast(`{field}` AS DOUBLE)")
        low, high = rule.get("min"), rule.get("max")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (v < low)
        if high is not None:
            bad = bad | (v > high)
        if rule.get("action", "drop") == "drop":
            df = df.where(~F.coalesce(bad, F.lit(False)))
        else:
            fixed = F.when(v < low, F.lit(low)) if low is not None else F.when(F.lit(False), F.lit(high))
            fixed = fixed.when(v > high, F.lit(high)) if high is not None else fixed
            df = df.withColumn(field, F.coalesce(fixed.cast(df.schema[field].dataType), F.col(field)))
    return df


def prune(value: Any) -> Any:
    """Without nulls, empty strings, lists and objects, and words for nothing, from the inside out; 0 and false stay."""
    if isinstance(value, dict):
        value = {k: p for k, v in value.items() if (p := prune(v)) is not None}
        return value or None
    if isinstance(value, list):
        value = [p for v in value if (p := prune(v)) is not None]
        return value or None
    if isinstance(value, str) and value.strip().upper() in ("", "NULL", "NONE", "NAN"):
        return None
    return value


@F.pandas_udf(T.StringType())
def prune_json(payloads: pd.Series) -> pd.Series:
    """prune() of JSON texts; null where nothing is left or the text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            left = prune(json.loads(text)) if text else None
        except ValueError:
            return None
        return None if left is None else json.dumps(left, ensure_ascii=False, separators=(",", ":"))

    return payloads.map(one)


def prune_map(m: Column | str) -> Column:
    """The same for a flat map of strings."""
    return F.map_filter(tx.col(m), lambda k, v: ~tx.is_blank_word(v))


PROCESSORS = {
    "clean": lambda df, c: df.withColumn(c, tx.clean(c)),
    "pii": lambda df, c: df.withColumn(c, tx.mask_pii(c)),
    "whitespace": lambda df, c: df.withColumn(c, tx.whitespace(c)),
}


def chain(df: DataFrame, steps: list[str] | str = "ALL", content: str = "content") -> DataFrame:
    """Runs named processors in the order given, or all by name; unknown names are refused up front."""
    names = sorted(PROCESSORS) if steps == "ALL" else list(steps)
    if unknown := [n for n in names if n not in PROCESSORS]:
        raise ValueError(f"no such processors: {unknown}")
    for n in names:
        df = PROCESSORS[n](df, content)
    return df
