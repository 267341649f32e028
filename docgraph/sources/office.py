"""Office documents to pages of elements, by their zipped XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.operators.refine import PAGES

Element = dict[str, Any]


def element(kind: str = "text", text: str | None = None, data: list[list[str]] | None = None, semantic: str | None = None, heading: int | None = None, level: int | None = None) -> Element:
    return {"type": kind, "text": text, "data": data, "semantic_type": semantic, "heading_level": heading, "list_level": level, "ocr_text": None}


def page(number: int, elements: list[Element], headers: list[Element] | None = None, footers: list[Element] | None = None) -> dict[str, Any]:
    return {"page_num": number, "elements": elements, "header_elements": headers or [], "footer_elements": footers or []}


def local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def child(node: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    for n in names:
        node = None if node is None else next((c for c in node if local(c) == n), None)
    return node


def under(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node.iter() if local(c) == name]


def text_of(node: ElementTree.Element) -> str:
    return "".join(("\t" if local(c) == "tab" else "\n" if local(c) == "br" else c.text or "") for c in node.iter() if local(c) in ("t", "tab", "br"))


def xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _docx_parts(root: ElementTree.Element | None) -> list[Element]:
    out = []
    for node in [] if root is None else root:
        if local(node) == "p":
            text = text_of(node).strip()
            if not text:
                continue
            style = attribute(child(node, "pPr", "pStyle"), "val") or ""
            numbering = child(node, "pPr", "numPr")
            if "list" in style.lower() or numbering is not None:
                out.append(element(text=text, semantic="list", level=int(attribute(child(numbering, "ilvl"), "val") or 0)))
            elif m := re.match(r"(?i)heading\s*(\d)", style):
                out.append(element(text=text, semantic="heading", heading=int(m[1])))
            else:
                out.append(element(text=text, semantic="title" if style.lower() == "title" else "paragraph"))
        elif local(node) == "tbl":
            out.append(element("table", data=[[" ".join(text_of(p) for p in under(c, "p")).strip() for c in r if local(c) == "tc"] for r in node if local(r) == "tr"]))
        elif local(node) == "sdt":
            out += _docx_parts(child(node, "sdtContent"))
    return out


def docx(content: bytes) -> list[dict[str, Any]]:
    """One page: paragraphs by their style (a list before a heading), tables, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        side = {k: [e for n in sorted(z.namelist()) if re.fullmatch(rf"word/{k}\d*\.xml", n) for e in _docx_parts(xml(z, n))] for k in ("header", "footer")}
        root = xml(z, "word/document.xml")
        return [page(1, _docx_parts(child(root, "body")), side["header"], side["footer"])]


def pptx(content: bytes) -> list[dict[str, Any]]:
    """A page per slide: shapes of all groups by their place, top to bottom and left to right, then the notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for k, name in enumerate(slides, 1):
            placed = []
            for shape in [s for s in xml(z, name).iter() if local(s) in ("sp", "graphicFrame")]:
                off = next(iter(under(shape, "off")), None)
                at = (int(attribute(off, "y") or 0), int(attribute(off, "x") or 0))
                tables = under(shape, "tbl")
                if tables:
                    placed.append((at, element("table", data=[[" ".join(text_of(p) for p in under(c, "p")).strip() for c in r if local(c) == "tc"] for r in tables[0] if local(r) == "tr"])))
                    continue
                text = "\n".join(t for p in under(shape, "p") if (t := text_of(p).strip()))
                kind = attribute(next(iter(under(shape, "ph")), None), "type") or ""
                if text:
                    placed.append((at, element(text=text, semantic="title" if "title" in kind.lower() else "paragraph")))
            parts = [e for _, e in sorted(placed, key=lambda x: x[0])]
            notes = xml(z, f"ppt/notesSlides/notesSlide{k}.xml")
            if notes is not None and (text := "\n".join(t for p in under(notes, "p") if (t := text_of(p).strip()))):
                parts.append(element(text=text, semantic="notes"))
            out.append(page(k, parts))
        return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx(content: bytes, skip_hidden: bool = False) -> list[dict[str, Any]]:
    """A page with a table per sheet; blank rows and, if asked, hidden sheets are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in under(s, "t")) for s in (strings if strings is not None else []) if local(s) == "si"]
        links = xml(z, "xl/_rels/workbook.xml.rels")
        target = {attribute(r, "Id"): attribute(r, "Target") for r in (links if links is not None else [])}
        out = []
        for s in under(xml(z, "xl/workbook.xml"), "sheet"):
            if skip_hidden and attribute(s, "state") in ("hidden", "veryHidden"):
                continue
            link = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
            name = (target.get(link) or f"worksheets/sheet{len(out) + 1}.xml").lstrip("/")
            sheet = xml(z, name if name.startswith("xl/") else f"xl/{name}")
            rows = []
            for r in under(sheet, "row") if sheet is not None else []:
                cells: dict[int, str] = {}
                for c in [c for c in r if local(c) == "c"]:
                    raw = child(c, "v")
                    value = "".join(t.text or "" for t in under(c, "t")) if attribute(c, "t") == "inlineStr" else (raw.text or "") if raw is not None else ""
                    cells[_column(attribute(c, "r") or "") if attribute(c, "r") else len(cells)] = shared[int(value)] if attribute(c, "t") == "s" and value else value
                if any(v.strip() for v in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            title = element(text=attribute(s, "name"), semantic="heading", heading=2)
            out.append(page(len(out) + 1, [title, element("table", data=rows)] if rows else [title]))
        return out


def _hwpx_level(style: str, height: float) -> int | None:
    if m := re.match(r"(?i)(?:heading|outline|개요|제목)\s*(\d)", style):
        return min(6, int(m[1]))
    return next((k for k, least in ((1, 28), (2, 20), (3, 16)) if height >= least), None)


def hwpx(content: bytes) -> list[dict[str, Any]]:
    """A page per section: tables, headings by style name or type size, and neighbouring plain paragraphs of a style joined."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        head = xml(z, "Contents/header.xml")
        styles = {attribute(s, "id"): attribute(s, "name") or "" for s in (under(head, "style") if head is not None else [])}
        heights = {attribute(s, "id"): float(attribute(s, "height") or 0) / 100 for s in (under(head, "charPr") if head is not None else [])}
        out = []
        for k, name in enumerate(sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), 1):
            parts: list[Element] = []
            last = None
            for p in [c for c in xml(z, name) if local(c) == "p"]:
                tables = under(p, "tbl")
                for t in tables:
                    parts.append(element("table", data=[[text_of(c).strip() for c in r if local(c) == "tc"] for r in t if local(r) == "tr"]))
                style = styles.get(attribute(p, "styleIDRef"), "")
                text = "" if tables else text_of(p).strip()
                if not text:
                    last = None
                    continue
                level = _hwpx_level(style, max([heights.get(attribute(r, "charPrIDRef"), 0.0) for r in under(p, "run")] or [0.0]))
                if level:
                    parts.append(element(text=text, semantic="heading", heading=level))
                elif last == style and parts:
                    parts[-1]["text"] += "\n" + text
                else:
                    parts.append(element(text=text, semantic="paragraph"))
                last = None if level else style
            out.append(page(k, parts))
        return out


PARSERS: dict[str, Callable[[bytes], list[dict[str, Any]]]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "hwpx": hwpx}


def sniff(content: bytes) -> str | None:
    """The format by the bytes: the parts a zip has tell which."""
    if content[:4] == b"%PDF":
        return "pdf"
    if content[:2] != b"PK":
        return "hwp" if content[:4] == b"\xd0\xcf\x11\xe0" else None
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return None
    for prefix, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"), ("Contents/", "hwpx")):
        if any(n.startswith(prefix) for n in names):
            return kind
    return None


def parse_documents(files: DataFrame, path: str = "path", content: str = "content", extra: dict[str, Callable[[bytes], list[dict[str, Any]]]] | None = None) -> DataFrame:
    """(doc_id, format, pages, error) of binary files, for refine.document_markdown.

    Formats without a parser here (HWP, images: they need libraries or OCR) take one from ``extra``; else, and for a file
    that can't be read, the error says so and no other row suffers.
    """
    from docgraph.sources.pdf import pdf

    parsers = PARSERS | {"pdf": pdf} | (extra or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["p"], pdf["c"], strict=True):
                kind, pages, error = None, None, None
                try:
                    kind = sniff(bytes(data or b"")) or str(name or "").rsplit(".", 1)[-1].lower()
                    if kind not in parsers:
                        raise ValueError(f"no parser for {kind}")
                    pages = parsers[kind](bytes(data))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((name, kind, pages, error))
            yield pd.DataFrame(rows, columns=["doc_id", "format", "pages", "error"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, f"doc_id string, format string, pages {PAGES}, error string")
