"""What connectors make of their payloads: pure functions of the rows, whatever client fetched them."""

from __future__ import annotations

import email
import email.policy
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions.text import col


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals become doubles, dates and times ISO texts, bytes UTF-8."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            out[f.name] = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.BinaryType):
            out[f.name] = F.make_valid_utf8(c.cast("string"))
    return df.withColumns(out) if out else df


def threads(messages: DataFrame, key: str, order: str, author: str, text: str) -> DataFrame:
    """(key, content, n_replies): the first message, then its replies in order as a Markdown list."""
    m = F.array_sort(F.collect_list(F.struct(order, author, text)))
    out = messages.groupBy(key).agg(m.alias("m"))
    line = lambda x: F.concat(F.lit("- **"), F.coalesce(x[author], F.lit("?")), F.lit("**: "), F.coalesce(x[text], F.lit("")))
    replies = F.array_join(F.transform(F.slice("m", F.lit(2), F.size("m")), line), "\n")
    body = F.concat(F.lit("# Thread\n"), F.coalesce(F.col("m")[0][text], F.lit("")), F.lit("\n\n## Replies\n"), F.when(F.size("m") > 1, replies).otherwise("(No replies)"))
    return out.select(key, body.alias("content"), (F.size("m") - 1).alias("n_replies"))


def html_escape(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_envelope(title: Column | str, body: Column | str, meta: dict[str, Column | str]) -> Column:
    """A page with a title and meta tags around a text, all escaped."""
    tags = [F.concat(F.lit(f'<meta name="{k}" content="'), html_escape(v), F.lit('">')) for k, v in meta.items()]
    return F.concat(F.lit("<html><head><title>"), html_escape(title), F.lit("</title>"), *tags, F.lit("</head><body>"), html_escape(body), F.lit("</body></html>"))


def mail_body(raw: bytes | str) -> dict[str, str | None]:
    """Subject, sender, date and body of a mail; the last HTML part wins, plain text counts only without one."""
    m = email.message_from_bytes(raw if isinstance(raw, bytes) else raw.encode(), policy=email.policy.default)
    html = plain = None
    for part in m.walk():
        kind = part.get_content_type()
        if part.is_multipart() or part.get_content_disposition() == "attachment" or kind not in ("text/html", "text/plain"):
            continue
        body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
        if kind == "text/html":
            html = body
        elif plain is None:
            plain = body
    return {"subject": m["subject"] and str(m["subject"]), "sender": m["from"] and str(m["from"]), "date": m["date"] and str(m["date"]), "body": html if html is not None else plain}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "sender", "date", "body")]))
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    """mail_body() of raw messages; nulls for what can't be read."""
    rows = []
    for r in raw:
        try:
            rows.append(mail_body(bytes(r)) if r is not None else {})
        except Exception:
            rows.append({})
    return pd.DataFrame(rows, columns=["subject", "sender", "date", "body"])


def blocks_markdown(blocks: list[dict[str, Any]], depth: int = 0) -> str:
    """A tree of note blocks as Markdown; children stand two blanks further in, tables as rows of cells."""
    out, number = [], 0
    pad = "  " * depth
    for b in blocks:
        kind, text = b.get("type"), b.get("text", "") or ""
        number = number + 1 if kind == "numbered" else 0
        if kind and kind.startswith("heading_"):
            line = "#" * int(kind[-1]) + " " + text
        elif kind == "bullet":
            line = f"- {text}"
        elif kind == "numbered":
            line = f"{number}. {text}"
        elif kind == "todo":
            line = f"- [{'x' if b.get('checked') else ' '}] {text}"
        elif kind == "quote":
            line = f"> {text}"
        elif kind == "code":
            line = f"```{b.get('language', '')}\n{text}\n```"
        elif kind == "image":
            line = f"![{text or 'image'}]({b.get('url', '')})"
        elif kind == "divider":
            line = "---"
        elif kind == "table":
            rows = [[str(c) for c in r] for r in b.get("rows", [])]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            line = "\n".join([*lines[:1], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) if rows else ""
        else:
            line = text
        if line:
            out.append("\n".join(pad + x for x in line.split("\n")))
        if b.get("children"):
            out.append(blocks_markdown(b["children"], depth + 1))
    return "\n".join(out)


def properties_table(names: list[Column | str], values: list[Column | str]) -> Column:
    """A Markdown table of a page's properties: newlines become blanks, pipes slashes."""
    cell = lambda c: F.translate(F.coalesce(col(c).cast("string"), F.lit("")), "\n|", " /")
    rows = [F.concat(F.lit("| "), cell(n), F.lit(" | "), cell(v), F.lit(" |")) for n, v in zip(names, values, strict=True)]
    return F.concat_ws("\n", F.lit("| Property | Value |"), F.lit("| --- | --- |"), *rows)


def sheet_csv(rows: Column | str) -> Column:
    """An array of arrays of cells as CSV text; a cell with a comma, quote or newline is quoted."""

    def cell(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return F.array_join(F.transform(col(rows), lambda r: F.array_join(F.transform(r, cell), ",")), "\n")


def calendar_window(df: DataFrame, start: str, reference: str, days: int = 30) -> DataFrame:
    """Events that begin within ``days`` of the reference on either side."""
    ref, span = F.lit(reference).cast("timestamp_ntz"), F.make_dt_interval(F.lit(days))
    return df.where(F.col(start).between(ref - span, ref + span))
