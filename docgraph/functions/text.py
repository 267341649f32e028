"""Column functions over text. Patterns mean the same in Java's regular expressions and in RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, as Python's str.strip sees it.
WS = r"[\t\n\x0B\f\r\x1c-\x1f\x{85}\p{Z}]"
EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+"
PHONE = r"\d{3}[-\.\s]??\d{3,4}[-\.\s]??\d{4}"
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^\s\)]+)\)"
RAW_LINK = r"https?://[^\s\)\]<>\"]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of WS, one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85 \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space, of any kind, at either end."""
    return F.trim(col(c), F.lit(SPACES))


def clean(c: Column | str, patterns: list[str] | None = None) -> Column:
    """Deletes each pattern in turn, then makes runs of blanks and tabs one blank, and strips."""
    out = col(c)
    for p in patterns or []:
        out = F.regexp_replace(out, p, "")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def whitespace(c: Column | str, keep_newlines: bool = True) -> Column:
    """No-break spaces become blanks, zero-width spaces go; runs of blank lines become one blank line, or all one blank."""
    out = F.replace(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    if not keep_newlines:
        return strip(F.regexp_replace(out, f"{WS}+", " "))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, f"\\n{WS}*\\n", "\n\n"))


def mask_pii(c: Column | str, email: bool = True, phone: bool = True) -> Column:
    """E-mail addresses, then phone numbers, become marks."""
    out = col(c)
    if email:
        out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    if phone:
        out = F.regexp_replace(out, PHONE, "[PHONE]")
    return out


def links(c: Column | str) -> Column:
    """Array of (title, url): Markdown links in order, then raw addresses not yet met, without a title; no repeats."""
    text = col(c)
    titles, urls = F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(2))
    marked = F.zip_with(titles, urls, lambda t, u: F.struct(t.alias("title"), u.alias("url")))
    raw = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(RAW_LINK), F.lit(0))), urls)
    return F.array_distinct(F.concat(marked, F.transform(raw, lambda u: F.struct(F.lit("").alias("title"), u.alias("url")))))


def without_links(c: Column | str) -> Column:
    """Markdown links become their titles, raw addresses go, and white space is made single."""
    out = F.regexp_replace(F.regexp_replace(col(c), MARKDOWN_LINK, "$1"), RAW_LINK, "")
    return strip(F.regexp_replace(out, f"{WS}+", " "))


def is_blank_word(c: Column) -> Column:
    """Whether a value says nothing: null, empty, or a word for nothing."""
    return c.isNull() | F.upper(strip(c)).isin("", "NULL", "NONE", "NAN")


def classify_chunk(c: Column | str) -> Column:
    """table, code_block, list_item, image or text, by how the text begins."""
    text = strip(c)
    return F.when(text.startswith("|"), "table").when(text.startswith("```"), "code_block").when(text.rlike(r"^([-*+]|\d+\.)\s"), "list_item").when(text.startswith("!["), "image").otherwise("text")


def sniff_extension(c: Column | str) -> Column:
    """A file extension for a text, by how it looks."""
    text = strip(c)
    return (
        F.when(text.rlike(r"(?is)^<!doctype html|^<html"), ".html")
        .when(text.rlike(r"^<\?xml"), ".xml")
        .when(text.rlike(r"(?s)^[\{\[].*[\}\]]$"), ".json")
        .when(text.rlike(r"(?m)^#{1,6} |^```|^- \["), ".md")
        .when(text.rlike(r"(?m)^(def|class|import|from) \w+"), ".py")
        .when(text.rlike(r"^[^\n,]*,[^\n]*\n[^\n,]*,"), ".csv")
        .otherwise(".txt")
    )


MAGIC = {"25504446": ".pdf", "504B0304": ".zip", "89504E47": ".png", "FFD8FF": ".jpg", "47494638": ".gif", "D0CF11E0": ".ole"}


def magic_extension(content: Column | str) -> Column:
    """A file extension for bytes, by their first ones; null if they say nothing."""
    head = F.hex(F.substring(col(content), 1, 8))
    out = F.lit(None).cast("string")
    for magic, ext in MAGIC.items():
        out = F.when(head.startswith(magic), ext).otherwise(out)
    return out


def output_name(*candidates: Column | str) -> Column:
    """The first candidate that is there, with characters that file systems forbid made underscores."""
    return F.regexp_replace(F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit("output")), r'[\\/:*?"<>|]', "_")


def visible_lines(c: Column | str) -> Column:
    """Lines stripped, cut at double blanks, without empty ones."""
    parts = F.flatten(F.transform(F.split(col(c), r"\n"), lambda x: F.split(strip(x), "  ")))
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0), "\n")
