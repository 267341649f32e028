"""Queries of cleaning, normalising and chunking over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import chunk, refine
from docgraph.plans.registry import query, table
from docgraph.sources import files as fs
from docgraph.sources import render

WS = tx.WS


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_all(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


# ---- processors


@query("p01_clean", f"SELECT doc_id, {s_strip(s_all(s_all('text', '[0-9]+', ''), '[ \t]+', ' '))} AS content FROM documents")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("content", tx.clean("content", ["[0-9]+"]))


S_SPACES = "replace(replace(text, chr(160), ' '), chr(8203), '')"
S_P02 = s_strip(s_all(s_all(S_SPACES, "[ \t]+", " "), rf"\n{WS}*\n", "' || chr(10) || chr(10) || '"))
S_FLAT = s_strip(s_all(S_SPACES, f"{WS}+", " "))


@query("p02_whitespace", f"SELECT doc_id, {S_P02} AS content, {S_FLAT} AS flat FROM documents")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.whitespace("content").alias("content"), tx.whitespace("content", keep_newlines=False).alias("flat"))


@query(
    "p03_pii_mask",
    f"SELECT doc_id, {s_all(s_all('text', tx.EMAIL, '[EMAIL]'), tx.PHONE, '[PHONE]')} AS content, CAST(len(regexp_extract_all(text, '{tx.EMAIL}')) AS INTEGER) AS n_mail, CAST(len(regexp_extract_all(text, '{tx.PHONE}')) AS INTEGER) AS n_phone FROM documents",
)
def p03(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    return docs(spark, d).select("doc_id", tx.mask_pii("content").alias("content"), n(tx.EMAIL).alias("n_mail"), n(tx.PHONE).alias("n_phone"))


S_RAW = r"https?://[^\s\)\]<>\"]+"


@query(
    "p04_links",
    f"WITH t AS (SELECT page_id, html AS x, regexp_extract_all(html, '{tx.MARKDOWN_LINK}', 1) AS ti, regexp_extract_all(html, '{tx.MARKDOWN_LINK}', 2) AS u, regexp_extract_all(html, '{S_RAW}') AS raw FROM pages) "
    "SELECT page_id, CAST(len(u) + len(list_filter(list_distinct(raw), lambda r: NOT list_contains(u, r))) AS INTEGER) AS n_links, "
    f"{s_strip(s_all(s_all(s_all('x', tx.MARKDOWN_LINK, chr(92) + '1'), S_RAW, ''), WS + '+', ' '))} AS content FROM t",
)
def p04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(tx.links("html")).alias("n_links"), tx.without_links("html").alias("content"))


@query("p05_dedup", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR length(text) < 5 OR text IS NULL")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return refine.dedup_blocks(docs(spark, d), "content", ["doc_id"]).select("doc_id")


S_PROPS = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("p06_impute", f"SELECT event_id, coalesce(CASE WHEN {S_PROPS} % 3 > 0 THEN {S_PROPS} END, -1) AS k, 'none' AS note FROM events")
def p06(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return refine.impute(table(spark, d, "events").select("event_id", F.when(k % 3 > 0, k).alias("k")), {"k": -1, "note": "none"})


@query("p07_outliers", "SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, 1000.0), 50000.0) AS l_extendedprice, l_quantity FROM lineitem WHERE l_quantity BETWEEN 2 AND 45 OR l_quantity IS NULL")
def p07(spark: SparkSession, d: str) -> DataFrame:
    rules = {"l_quantity": {"min": 2, "max": 45, "action": "drop"}, "l_extendedprice": {"min": 1000.0, "max": 50000.0, "action": "clamp"}}
    return refine.handle_outliers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), rules)


@query("p08_prune", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'type=' || event_type ELSE 'kind=0,type=' || event_type END AS fields FROM events")
def p08(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("type"), "event_type", F.lit("a"), F.lit(" NaN "), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None).cast("string"), F.lit("kind"), F.when(F.col("event_id") % 3 == 0, "null").otherwise("0"))
    kept = F.array_join(F.array_sort(F.transform(F.map_entries(refine.prune_map(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "events").select("event_id", kept.alias("fields"))


@query("p08_prune_json", "SELECT event_id, '{\"event_id\":' || event_id || CASE WHEN event_type IS NULL OR upper(trim(event_type)) IN ('', 'NULL', 'NONE', 'NAN') THEN '}' ELSE ',\"y\":[\"' || event_type || '\"]}' END AS payload FROM events")
def p08_json(spark: SparkSession, d: str) -> DataFrame:
    whole = F.to_json(F.struct("event_id", F.struct(F.lit("").alias("a"), F.lit("none").alias("b")).alias("x"), F.array(F.lit("NULL"), "event_type").alias("y")))
    return table(spark, d, "events").select("event_id", refine.prune_json(whole).alias("payload"))


S_CLEAN = s_strip(s_all("text", "[ \t]+", " "))


@query("p09_chain", f"SELECT doc_id, {s_all(s_all(S_CLEAN, tx.EMAIL, '[EMAIL]'), tx.PHONE, '[PHONE]')} AS content FROM documents")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return refine.chain(docs(spark, d), ["clean", "pii"])


# ---- normalisers

def layout(spark: SparkSession, d: str) -> DataFrame:
    """documents as pages of a title, a heading, a list item, the text, a ragged table, an image and a footer."""

    def e(kind: str, text: F.Column | None = None, data: F.Column | None = None, semantic: str | None = None, heading: int | None = None, level: int | None = None) -> F.Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type"), (none if text is None else text).cast("string").alias("text"), (none if data is None else data).cast("array<array<string>>").alias("data"), F.lit(semantic).cast("string").alias("semantic_type"),
            F.lit(heading).cast("int").alias("heading_level"), F.lit(level).cast("int").alias("list_level"), none.cast("string").alias("ocr_text"),
        )

    rows = F.array(F.array(F.lit("id"), F.lit("size")), F.array(F.col("doc_id").cast("string")))
    body = F.array(e("text", F.col("source"), semantic="title"), e("text", F.lit("Language"), semantic="heading", heading=2), e("text", F.col("lang"), semantic="list", level=1), e("text", F.col("text")), e("table", data=rows), e("image"))
    page = F.struct(F.lit(1).alias("page_num"), body.alias("elements"), F.array().cast(f"array<{refine.ELEMENT}>").alias("header_elements"), F.array(e("text", F.lit("foot"))).alias("footer_elements"))
    return table(spark, d, "documents").select("doc_id", F.array(page).alias("pages"))


S_MD = (
    "'# ' || source || chr(10) || chr(10) || '## Language' || chr(10) || chr(10) || '  - ' || lang || chr(10) || chr(10) || CASE WHEN length(text) > 0 THEN text || chr(10) || chr(10) ELSE '' END || "
    "'| id | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |'"
)
S_LINES = s_all(S_MD, r"[\x0B\f\r]", "' || chr(10) || '")


@query("n01_document_markdown", f"SELECT doc_id, 0 AS block_idx, 'md' AS type, {S_LINES} AS content FROM documents UNION ALL SELECT doc_id, 0, 'image_base64', 'image' FROM documents")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return refine.document_markdown(layout(spark, d))


@query("n06_front_matter", "SELECT doc_id, '---' || chr(10) || 'title: ' || source || chr(10) || 'author: ' || lang || chr(10) || '---' || chr(10) AS head FROM documents")
def n06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", refine.front_matter("source", "lang").alias("head"))


def _s_html() -> str:
    out = s_all("html", "(?s)<!--.*?-->", "")
    for tag in refine.HIDDEN.split("|"):
        out = s_all(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = s_all(out, "(?s)<[^>]*>", "' || chr(10) || '")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    out = s_all(out, r"[ \t]*\n[ \t]*", "' || chr(10) || '")
    return s_strip(s_all(out, r"\n{3,}", "' || chr(10) || chr(10) || '"))


@query("n07_html_text", f"SELECT page_id, {_s_html()} AS content, {s_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def n07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", refine.html_text("html").alias("content"), refine.html_title("html").alias("title"))


@query(
    "n07_html_meta",
    "WITH m AS (SELECT page_id, unnest(list_zip(range(len(k)), k, v)) AS x FROM (SELECT page_id, list_concat(regexp_extract_all(html, '(?is)<meta\\s[^>]*?(?:name|property)=\"([^\"]*)\"[^>]*?\\scontent=\"([^\"]*)\"[^>]*>', 1), regexp_extract_all(html, '(?is)<meta\\s[^>]*?content=\"([^\"]*)\"[^>]*?\\s(?:name|property)=\"([^\"]*)\"[^>]*>', 2)) AS k, "
    "list_concat(regexp_extract_all(html, '(?is)<meta\\s[^>]*?(?:name|property)=\"([^\"]*)\"[^>]*?\\scontent=\"([^\"]*)\"[^>]*>', 2), regexp_extract_all(html, '(?is)<meta\\s[^>]*?content=\"([^\"]*)\"[^>]*?\\s(?:name|property)=\"([^\"]*)\"[^>]*>', 1)) AS v FROM pages)) "
    "SELECT page_id, lower(x[2]) AS name, arg_min(x[3], x[1]) AS content FROM m GROUP BY 1, 2",
)
def n07_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(refine.html_meta("html")).alias("name", "content"))


@query("n08_records", "SELECT event_id, CAST(event_id AS VARCHAR) AS record_id, 'tags' AS content_field, '[\"' || event_type || '\"]' AS content, CAST(user_id AS VARCHAR) AS meta_user FROM events")
def n08(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), "user_id", F.array("event_type").alias("tags"))).alias("record"))
    return refine.normalize_records(e).select("event_id", "record_id", "content_field", "content", F.col("meta")["user_id"].alias("meta_user"))


@query("n09_record_blocks", "SELECT conv_id, '[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn, role) || ']' AS content, count(*) AS record_count FROM conversations GROUP BY conv_id")
def n09(spark: SparkSession, d: str) -> DataFrame:
    return refine.rows_to_block(table(spark, d, "conversations"), "conv_id", ["turn", "role"], F.to_json(F.struct("turn", "role")))


@query("n10_json_blocks", "SELECT event_id, 1 AS block_idx, replace(props, ': ', ':') AS content FROM events WHERE props IS NOT NULL")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return refine.json_blocks(table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.concat(F.lit('["skipped",'), "props", F.lit("]")).alias("payload")))


@query(
    "n11_route",
    "SELECT page_id, part, CASE WHEN regexp_matches(x, '(?i)^<(!doctype|html)') THEN 'html' WHEN x[1] = '{' THEN 'record' WHEN x[1] = '[' THEN 'raw_json' ELSE 'markdown' END AS route "
    f"FROM (SELECT page_id, part, {s_strip('x')} AS x FROM (SELECT page_id, 0 AS part, html AS x FROM pages UNION ALL SELECT page_id, 1, regexp_extract(html, '(?s)>([^<>]+)<', 1) FROM pages UNION ALL SELECT event_id, 2, props FROM events))",
)
def n11(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    parts = [p.select("page_id", F.lit(0).alias("part"), F.col("html").alias("x")), p.select("page_id", F.lit(1).alias("part"), F.regexp_extract("html", "(?s)>([^<>]+)<", 1).alias("x")), table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.lit(2).alias("part"), F.col("props").alias("x"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("page_id", "part", refine.normalizer_route(F.lit("file"), "x").alias("route"))


# ---- chunkers


@query("c01_fixed_chunks", "SELECT doc_id, CAST(s // 900 AS INTEGER) AS part_index, substr(text, s + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents)")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_chunks(docs(spark, d), 1000, 100)


@query("c02_audited_chunks", "SELECT doc_id, CAST(s // 1000 AS INTEGER) AS part_index, substr(text, s + 1, 1000) AS content, CAST(length(text) AS INTEGER) AS original_length, '1.0' AS version FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents)")
def c02(spark: SparkSession, d: str) -> DataFrame:
    return chunk.audited_chunks(docs(spark, d)).drop("processed_at")


@query("c03_recursive_chunks")
def c03(spark: SparkSession, d: str) -> DataFrame:
    return chunk.recursive_chunks(docs(spark, d))


@query("c04_protected_chunks")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return chunk.recursive_chunks(docs(spark, d), protected=[r"\d[\d\s-]{6,}\d"])


@query("c05_sections", f"SELECT doc_id, section, 0 AS part, {s_strip('x')} AS content FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS section, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {s_strip('x')} <> ''")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return chunk.structure_sections(docs(spark, d), r"\n")


CHAPTERS = [("night", 0, 21600), ("morning", 21600, 43200), ("noon", 43200, 46800), ("evening", 64800, 86400)]


@query(
    "c06_intervals",
    "WITH c(title, start_time, end_time) AS (VALUES ('night', 0, 21600), ('morning', 21600, 43200), ('noon', 43200, 46800), ('evening', 64800, 86400)), "
    "e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS t, ts, event_id, event_type FROM events), "
    "j AS (SELECT e.*, last_value(c.title IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS title FROM e LEFT JOIN c ON e.t >= c.start_time AND e.t < c.end_time) "
    'SELECT user_id, CAST(day AS VARCHAR) AS day, title, string_agg(event_type, \' \' ORDER BY ts, event_id) AS content, min(t) AS "start", max(t) AS "end", count(*) AS n FROM j GROUP BY user_id, day, title',
)
def c06(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("t"), "ts", "event_id", "event_type")
    return chunk.interval_chunks(e, spark.createDataFrame(CHAPTERS, "title string, start_time int, end_time int"), ["user_id", "day"], "t", ["ts", "event_id"], "event_type")


@query(
    "c07_buckets",
    "SELECT user_id, CAST(floor(t / 604800.0) AS BIGINT) AS bucket, string_agg(event_type, ' ' ORDER BY t, event_id) AS content, min(t) AS \"start\", max(t) AS \"end\", count(*) AS n FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) GROUP BY ALL",
)
def c07(spark: SparkSession, d: str) -> DataFrame:
    return chunk.window_chunks(table(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp"))), ["user_id"], "t", 604800, ["t", "event_id"], "event_type")


@query("c08_record_groups", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role) AS content, min(turn) AS \"start\", max(turn) + 1 AS \"end\", count(*) AS n FROM conversations GROUP BY conv_id")
def c08(spark: SparkSession, d: str) -> DataFrame:
    return chunk.record_groups(table(spark, d, "conversations").withColumn("one", F.lit(1).cast("bigint")), ["conv_id"], "turn", ["turn", "role"], "text", "one")


@query("c09_markdown_chunks")
def c09(spark: SparkSession, d: str) -> DataFrame:
    md = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n## More\n\n- one\n- two\n"))
    return chunk.markdown_chunks(table(spark, d, "documents").select("doc_id", md.alias("content")))


S_CUT = "(SELECT doc_id, CAST(s // 50 AS INTEGER) AS part_index, substr(text, s + 1, 50) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text), 50)) AS s FROM documents))"


@query(
    "c10_classify",
    f"SELECT doc_id, part_index, CASE WHEN x[1] = '|' THEN 'table' WHEN substr(x, 1, 3) = '```' THEN 'code_block' WHEN regexp_matches(x, '^([-*+]|\\d+\\.)\\s') THEN 'list_item' WHEN substr(x, 1, 2) = '![' THEN 'image' ELSE 'text' END AS kind FROM (SELECT doc_id, part_index, {s_strip('x')} AS x FROM {S_CUT})",
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_chunks(docs(spark, d), 50).select("doc_id", "part_index", tx.classify_chunk("content").alias("kind"))


@query("c11_semantic_chunks")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return chunk.semantic_chunks(docs(spark, d))


@query(
    "c12_parent_child",
    "WITH p AS (SELECT doc_id || '_parent_' || (s // 2000) AS parent_id, substr(text, s + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS s FROM documents)), "
    "c AS (SELECT parent_id, s // 400 AS i, parent_id || '_c' || (s // 400) AS chunk_id, substr(content, s + 1, 400) AS content FROM (SELECT *, unnest(range(0, length(content), 400)) AS s FROM p)) "
    "SELECT p.parent_id AS chunk_id, NULL AS parent_id, true AS is_parent, any_value(p.content) AS content, string_agg(c.chunk_id, ',' ORDER BY i) AS child_ids FROM p JOIN c USING (parent_id) GROUP BY p.parent_id "
    "UNION ALL SELECT chunk_id, parent_id, false, content, NULL FROM c",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    return chunk.parent_child_chunks(docs(spark, d), fixed=True).withColumn("child_ids", F.array_join("child_ids", ","))


@query("c13_json_chunks")
def c13(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("content"))
    return chunk.json_chunks(c, 1000, id_col="conv_id")


@query("c16_route", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'python' END AS language FROM documents")
def c16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunk.code_route(F.expr("CASE doc_id % 5 WHEN 0 THEN '.PY' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.go' ELSE '.zig' END")).alias("language"))


@query("c21_whole", "SELECT doc_id, 0 AS part_index, text AS content FROM documents")
def c21(spark: SparkSession, d: str) -> DataFrame:
    return chunk.whole_chunks(docs(spark, d))


@query("c23_flatten", "SELECT conv_id, text AS content, role, 'chat' AS kind FROM conversations")
def c23(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("text").alias("content"), F.create_map(F.lit("role"), "role").alias("metadata"))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("items")).withColumn("meta", F.create_map(F.lit("kind"), F.lit("chat"), F.lit("role"), F.lit("?")))
    return chunk.flatten_items(nested, "items", "meta").select("conv_id", "content", F.col("meta")["role"].alias("role"), F.col("meta")["kind"].alias("kind"))


def _s_words(size: int, step: int) -> str:
    return (
        f"SELECT doc_id, CAST(s // {step} AS INTEGER) AS part_index, array_to_string(w[s + 1 : s + {size}], ' ') AS content FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS s "
        r"FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents))"
    )


@query("c25_word_windows", _s_words(5, 3))
def c25(spark: SparkSession, d: str) -> DataFrame:
    return chunk.word_windows(docs(spark, d))


@query("c26_word_blocks", _s_words(512, 512))
def c26(spark: SparkSession, d: str) -> DataFrame:
    return chunk.word_windows(docs(spark, d), 512, 0)


@query(
    "c27_line_sections",
    "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), "
    "s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l) "
    "SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, section",
)
def c27(spark: SparkSession, d: str) -> DataFrame:
    return chunk.line_sections(docs(spark, d), "^[A-Z]")


@query("c28_sentences", r"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS i, unnest(l) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\s][^.!?]*[.!?]*') AS l FROM documents)")
def c28(spark: SparkSession, d: str) -> DataFrame:
    return chunk.sentences(docs(spark, d))


@query("c29_token_windows", _s_words(512, 256))
def c29(spark: SparkSession, d: str) -> DataFrame:
    return chunk.word_windows(docs(spark, d), 512, 256)


@query("c30_kmeans")
def c30(spark: SparkSession, d: str) -> DataFrame:
    return chunk.cluster_sentences(table(spark, d, "embeddings"))


@query("c31_topics")
def c31(spark: SparkSession, d: str) -> DataFrame:
    return chunk.topic_chunks(docs(spark, d))


# ---- connectors' rendering


@query("s05_links", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"''#]+)', 1))) AS href FROM pages")
def s05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(fs.hrefs("html")).alias("href"))


@query("s04_crawl")
def s04(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return fs.crawl(p, p.agg(F.min_by("url", "page_id").alias("url")), max_depth=2)


@query("s27_packets", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def s27(spark: SparkSession, d: str) -> DataFrame:
    return fs.packet_counts(table(spark, d, "events").select((F.col("event_type") != "error").alias("success")))


@query("s29_json_safe", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2))::DOUBLE AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderstatus AS raw FROM orders")
def s29(spark: SparkSession, d: str) -> DataFrame:
    return render.json_safe(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), "o_orderdate", F.col("o_orderstatus").cast("binary").alias("raw")))


@query(
    "s30_threads",
    "SELECT conv_id, '# Thread' || chr(10) || arg_min(text, turn) || chr(10) || chr(10) || '## Replies' || chr(10) || "
    "coalesce(string_agg('- **' || role || '**: ' || text, chr(10) ORDER BY turn) FILTER (WHERE rn > 1), '(No replies)') AS content, CAST(count(*) - 1 AS INTEGER) AS n_replies "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id",
)
def s30(spark: SparkSession, d: str) -> DataFrame:
    return render.threads(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


def _s_escape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("s31_envelope", f"SELECT doc_id, '<html><head><title>' || source || '</title><meta name=\"lang\" content=\"' || lang || '\"></head><body>' || coalesce({_s_escape('text')}, '') || '</body></html>' AS html FROM documents")
def s31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", render.html_envelope("source", "text", {"lang": "lang"}).alias("html"))


@query("s34_properties", "SELECT c_custkey, '| Property | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Name | ' || c_name || ' |' || chr(10) || '| Segment | ' || replace(c_mktsegment || '|x', '|', '/') || ' |' AS content FROM customer")
def s34(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", render.properties_table([F.lit("Name"), F.lit("Segment")], ["c_name", F.concat("c_mktsegment", F.lit("|x"))]).alias("content"))


@query("s35_sheet_csv", "SELECT n_regionkey, string_agg(n_nationkey || ',\"' || n_name || ', x\"', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def s35(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(x["n_name"], F.lit(", x"))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(render.sheet_csv(rows).alias("content"))


@query("s36_calendar", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-06-01' - INTERVAL 30 DAY AND TIMESTAMP '1995-06-01' + INTERVAL 30 DAY")
def s36(spark: SparkSession, d: str) -> DataFrame:
    return render.calendar_window(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1995-06-01")


@query("b06_packets", "SELECT page_id, url AS source, '.html' AS extension, html AS content FROM pages")
def b06(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", fs.packet_source(F.lit(" "), "url").alias("source"), fs.path_extension(F.concat("url", F.lit("/x.HTML"))).alias("extension"), fs.lossy_text(F.col("html").cast("binary")).alias("content"))


@query("t26_visible_lines", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '  ', chr(10)), chr(10)), lambda x: {s_strip('x')}), lambda x: x <> ''), chr(10)) AS content FROM documents")
def t26(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("content", tx.visible_lines("content"))


@query(
    "l02_sniff",
    r"SELECT kind, id, CASE WHEN regexp_matches(x, '(?is)^<!doctype html|^<html') THEN '.html' WHEN regexp_matches(x, '^<\?xml') THEN '.xml' WHEN regexp_matches(x, '(?s)^[\{\[].*[\}\]]$') THEN '.json' WHEN regexp_matches(x, '(?m)^#{1,6} |^```|^- \[') THEN '.md' "
    r"WHEN regexp_matches(x, '(?m)^(def|class|import|from) \w+') THEN '.py' WHEN regexp_matches(x, '^[^\n,]*,[^\n]*\n[^\n,]*,') THEN '.csv' ELSE '.txt' END AS extension "
    f"FROM (SELECT kind, id, {s_strip('x')} AS x FROM (SELECT 'page' AS kind, page_id AS id, html AS x FROM pages UNION ALL SELECT 'event', event_id, props FROM events UNION ALL SELECT 'text', doc_id, text FROM documents "
    "UNION ALL SELECT 'note', doc_id, '# ' || source || chr(10) || text FROM documents UNION ALL SELECT 'row', doc_id, doc_id || ',' || source || chr(10) || lang || ',' || n_chars FROM documents UNION ALL SELECT 'code', doc_id, 'import ' || source || chr(10) || text FROM documents UNION ALL SELECT 'xml', doc_id, '<?xml version=\"1.0\"?>' || text FROM documents))",
)
def l02(spark: SparkSession, d: str) -> DataFrame:
    n, t = F.lit("\n"), table(spark, d, "documents")
    made = {"text": F.col("text"), "note": F.concat(F.lit("# "), "source", n, "text"), "row": F.concat("doc_id", F.lit(","), "source", n, "lang", F.lit(","), "n_chars"), "code": F.concat(F.lit("import "), "source", n, "text"), "xml": F.concat(F.lit('<?xml version="1.0"?>'), "text")}
    out = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    out = out.unionByName(table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("x")))
    for kind, x in made.items():
        out = out.unionByName(t.select(F.lit(kind).alias("kind"), F.col("doc_id").alias("id"), x.alias("x")))
    return out.select("kind", "id", tx.sniff_extension("x").alias("extension"))


@query("l14_output_name", r"SELECT page_id, regexp_replace(url, '[\\/:*?""<>|]', '_', 'g') AS name FROM pages")
def l14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.output_name(F.lit(None).cast("string"), "url").alias("name"))
