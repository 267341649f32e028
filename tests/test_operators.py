"""Edge cases: nulls, empties, Unicode, the rules of code graphs, files of each format, sinks and streams."""

import io
import json
import math
import re
import sqlite3
import tracemalloc
import uuid
import zipfile
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import analytics as an
from docgraph.operators import chunk, graph, kernels, refine, retrieve
from docgraph.sinks import writers
from docgraph.sources import files, office, pdf, render, services


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, tx.strip, "  a b　\n") == "a b"
    assert one(spark, tx.mask_pii, "größe@müller.de ruf 010-1234-5678 an") == "[EMAIL] ruf [PHONE] an"
    assert one(spark, tx.whitespace, "a \tb​c\n \n\n d ") == "a bc\n\n d"
    assert one(spark, tx.whitespace, None) is None
    found = one(spark, tx.links, "[t](http://a.b/c) http://a.b/c https://d.e")
    assert [tuple(x) for x in found] == [("t", "http://a.b/c"), ("", "https://d.e")]


def test_prune():
    assert refine.prune({"a": None, "b": {"c": "", "d": [None, "NaN"]}, "e": 0, "f": [False, "x", []]}) == {"e": 0, "f": [False, "x"]}
    assert refine.prune({"a": [{}]}) is None


def test_dedup_blocks(spark):
    df = spark.createDataFrame([(0, "long enough"), (1, "long enough"), (2, "ab"), (3, "ab"), (4, None), (5, None)], "i int, c string")
    assert sorted(r["i"] for r in refine.dedup_blocks(df, "c", ["i"]).collect()) == [0, 2, 3, 4, 5]


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "😀b😀")], "doc_id int, content string")
    got = sorted((r["doc_id"], r["part_index"], r["content"]) for r in chunk.fixed_chunks(df, 4, 1).collect())
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "g"), (4, 0, "😀b😀")]
    with pytest.raises(ValueError):
        chunk.fixed_chunks(df, 4, 4)


def test_recursive_split_keeps_every_character():
    text = "One. Two three.\n\nFour five six seven.\n" + "x" * 57 + " end"
    parts = kernels.recursive_split(text, 20, 0)
    assert all(len(p) <= 20 for p in parts)
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    kept = kernels.protected_split("aaa <<keep this whole>> bbb", [r"<<.*?>>"], 8, 0)
    assert "<<keep this whole>>" in kept


def test_many_intervals_by_bins(spark):
    rng = np.random.default_rng(0)
    cuts = np.sort(rng.choice(1000, 40, replace=False)).tolist()
    iv = spark.createDataFrame([(f"t{k}", a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=True))], "title string, start_time int, end_time int")
    rec = spark.createDataFrame([(1, int(t), i, "x") for i, t in enumerate(rng.integers(0, 1100, 300))], "s int, t int, i int, w string")
    few = sorted(map(tuple, chunk.interval_chunks(rec, iv, ["s"], "t", ["t", "i"], "w").collect()), key=str)
    assert few == sorted(map(tuple, chunk.interval_chunks(rec, iv, ["s"], "t", ["t", "i"], "w", bins=7).collect()), key=str)


def test_semantic_chunks_brute(spark):
    text = "aaaa bbb. aaab bba\nzzzz 9999 ++. aaab"
    got = chunk.semantic_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, content string"), 0.9).collect()

    def hist(s):
        v = np.bincount([ord(c) % 10 for c in s], minlength=10).astype(float)
        return v / np.linalg.norm(v)

    groups = []
    for s in (x.strip() for x in text.replace("\n", ". ").split(". ")):
        if groups and hist(groups[-1][-1]) @ hist(s) >= 0.9:
            groups[-1].append(s)
        else:
            groups.append([s])
    assert [r["content"] for r in sorted(got, key=lambda r: r["part_index"])] == [". ".join(g) for g in groups]


def test_json_chunks():
    parts = kernels.json_split(kernels.load_json(str([{"id": i, "v": "x" * 20} for i in range(10)])), 120)
    assert sum(p["count"] or 0 for p in parts) == 10
    assert kernels.load_json("not json {") is None


PACKAGE = {
    "src/app/__init__.py": "from .core import run\n__all__ = ['run', 'Base']\n",
    "src/app/base.py": "import abc\nLIMIT = 3\n\n\nclass Base:\n    @abc.abstractmethod\n    def go(self, n: int) -> int:\n        raise NotImplementedError\n\n    @property\n    def size(self):\n        return LIMIT\n\n\ndef helper(x):\n    return x\n",
    "src/app/core.py": "from app.base import Base, helper\nfrom . import base\n\nCOUNT = 0\n\n\nclass Job(Base):\n    def go(self, n):\n        self.step()\n        return helper(n)\n\n    def step(self):\n        global COUNT\n        COUNT += 1\n\n\nasync def later(job: Job):\n    job.step()\n    yield job.size\n\n\ndef run():\n    later(Job())\n",
    "src/app/broken.py": "def half(:\n    pass\n",
    "web/main.js": "import x from './x';\n\nfunction start(a) {\n  return a;\n}\n\nclass View {\n}\n",
}


def test_code_edges(spark):
    files_ = spark.createDataFrame(list(PACKAGE.items()), "source string, content string")
    nodes = graph.code_nodes(chunk.code_chunks(files_))
    got = {(r["source"].split("src_app_")[-1].split("src/app/")[-1], r["target"].split("src/app/")[-1], r["type"]) for r in graph.CodeGraph(nodes).edges().collect()}
    want = {
        ("core.py#Job", "base.py#Base", "INHERITS"),
        ("core.py#Job.go", "base.py#Base.go", "OVERRIDES"),
        ("core.py#Job.go", "base.py#helper", "CALLS"),
        ("base.py#Base.go", "exception:NotImplementedError", "RAISES"),
    }
    assert want <= got, want - got
    kinds = {k for _, _, k in got}
    assert {"CONTAINS", "IMPORTS", "MUTATES_GLOBAL", "EXPOSES", "USES_TYPE", "MAYBE_CALLS"} <= kinds, kinds


def test_graph_questions(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), (None, "a")], "source string, target string")
    got = {r["node"]: r["hop"] for r in graph.neighbourhood(e, spark.createDataFrame([("b",)], "node string"), 1).collect()}
    assert got == {"b": 0, "a": 1, "c": 1}
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert {r["node_id"] for r in graph.phantom_nodes(nodes, e).collect()} == {"c", "d", "x", "y"}


def test_score_card_and_rsi(spark):
    up = spark.createDataFrame([(1, i, float(i), 1.0 + i) for i in range(30)], "k int, t int, v double, vol double")
    r = {x["t"]: x["rsi"] for x in an.rsi(up, "v", ["k"], ["t"]).collect()}
    assert r[12] is None and r[13] == 100.0
    card = {x["t"]: x["score"] for x in an.score_card(up, "v", "vol", ["k"], ["t"]).collect()}
    assert card[29] == 4 and card[0] == 0
    flat = spark.createDataFrame([(1, i, 5.0) for i in range(20)], "k int, t int, v double")
    assert {x["rsi"] for x in an.rsi(flat, "v", ["k"], ["t"]).collect()} == {None}


def test_slices_hold_a_few_texts():
    """Pieces leave a Python worker slice by slice, by number and by bytes; a long text is a slice of its own."""
    import pyarrow as pa

    texts = pa.array(["x" * 10] * 1100 + ["y" * (chunk.SLICE_BYTES + 5), None, "z"] + ["w" * (chunk.SLICE_BYTES // 2)] * 3)
    got = list(chunk.slices(texts, texts))
    assert pa.concat_arrays(got).equals(texts)
    assert [len(g) for g in got] == [500, 500, 100, 1, 2 + 1, 2]
    assert [len(g) for g in chunk.slices(texts.slice(1100, 2), texts.slice(1100, 2))] == [1, 1]


def test_code_is_parsed_once(spark):
    """Nodes of units and of files, and a rule over both, parse a source once."""
    files_ = spark.range(3000).selectExpr("concat('m', id, '.py') AS source", "'def f():\\n    raise ValueError\\n' AS content").coalesce(1)
    seen = spark.sparkContext.accumulator(0)
    units = kernels.code_units
    counted = lambda code, language: (seen.add(1), units(code, language))[1]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chunk, "kernels", SimpleNamespace(code_units=counted, language_of=kernels.language_of, contained=kernels.contained, _facts=kernels._facts))
        nodes = graph.code_nodes(chunk.code_chunks(files_, facts=[*graph.CodeGraph.OF_ALL, "raises"]))
        assert graph.CodeGraph(nodes, held=True).raises().count() == 3000 and nodes.count() == 6000
    assert seen.value == 3000


def test_code_facts_of_one_rule(spark):
    """A rule's facts alone give the rule's edges."""
    code = "import os\nfrom b import f\nX = 1\n__all__ = ['C']\nclass C(D):\n    @abstractmethod\n    def go(self, a: C):\n        global X\n        f()\n        self.go()\n        raise E\nclass D:\n    def go(self):\n        pass\n"
    files_ = spark.createDataFrame([("a.py", code), ("b.py", "def f():\n    pass\n")], "source string, content string")
    whole = graph.CodeGraph(graph.code_nodes(chunk.code_chunks(files_)))
    for rule, facts in graph.CodeGraph.READS.items():
        part = graph.CodeGraph(graph.code_nodes(chunk.code_chunks(files_, facts=[*graph.CodeGraph.OF_ALL, *facts])), held=True)
        want = sorted(map(str, getattr(whole, rule)().collect()))
        assert sorted(map(str, getattr(part, rule)().collect())) == want and (want or rule in ("uses_type", "maybe_calls"))


def test_nearest_batch_brute(spark):
    x = np.random.default_rng(0).standard_normal((60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id int, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in an.nearest_batch(df, df.where("vec_id < 10"), 4).collect()}
    for q in range(10):
        order = np.argsort(np.linalg.norm(x - x[q], axis=1))[:4]
        assert [got[q, k] for k in range(1, 5)] == order.tolist()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped(
    {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/one.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
)
PPTX = zipped({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:off x="0" y="9"/><a:p><a:r><a:t>low</a:t></a:r></a:p></p:sp><p:sp><p:ph type="title"/><a:off x="0" y="1"/><a:p><a:r><a:t>high</a:t></a:r></a:p></p:sp></p:sld>'})
HWPX = zipped({"Contents/header.xml": '<head><style id="1" name="Outline 2"/><style id="2" name="Body"/></head>', "Contents/section0.xml": '<sec><p styleIDRef="1"><run><t>H</t></run></p><p styleIDRef="2"><run><t>a</t></run></p><p styleIDRef="2"><run><t>b</t></run></p></sec>'})


def test_office(spark):
    rows = [("a.docx", DOCX), ("b.xlsx", XLSX), ("c.pptx", PPTX), ("d.hwpx", HWPX), ("e.pdf", b"%PDF-1.7"), ("f.docx", b"PK broken"), ("g.docx", None)]
    df = office.parse_documents(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert got["a.docx"]["pages"][0]["elements"][0]["heading_level"] == 2
    assert got["b.xlsx"]["pages"][0]["elements"][1]["data"] == [["name", "", "3"], ["x"]] and len(got["b.xlsx"]["pages"]) == 2 and len(office.xlsx(XLSX, skip_hidden=True)) == 1
    assert [e["text"] for e in got["c.pptx"]["pages"][0]["elements"]] == ["high", "low"]
    assert [e["text"] for e in got["d.hwpx"]["pages"][0]["elements"]] == ["H", "a\nb"]
    assert all(got[n]["error"] and got[n]["pages"] is None for n in ("e.pdf", "f.docx", "g.docx"))
    md = {r["doc_id"]: r["content"] for r in refine.document_markdown(df.where("pages IS NOT NULL")).collect()}
    assert md["a.docx"] == "## Top\n\n- item\n\n| a |  |\n| --- | --- |"


def test_files_and_sqlite(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in ("a.txt", "b.TXT", "c.md", "deep/d.txt"):
        (tmp_path / "in" / n).write_text("x")
    base = str(tmp_path / "in")
    assert files.files(spark, base, extensions=[".txt"]).count() == 3
    assert files.files(spark, base, recursive=False, name_pattern="*.md").count() == 1
    assert files.texts(spark, base).count() == 1
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE data (id INTEGER PRIMARY KEY, name TEXT)")
        db.executemany("INSERT INTO data VALUES (?, ?)", [(i * 7, f"n{i}") for i in range(25)])
    assert sorted(map(tuple, files.sqlite(spark, path, "data", partitions=3).collect())) == [(i * 7, f"n{i}") for i in range(25)]
    assert [r[0] for r in files.sqlite(spark, path).collect()] == ["data"]
    writers.sqlite_upsert(spark.createDataFrame([(7, "new"), (1000, "more")], "id long, name string"), path, "data")
    assert dict(map(tuple, files.sqlite(spark, path, query="SELECT id, name FROM data WHERE id IN (7, 1000)").collect())) == {"7": "new", "1000": "more"}


def test_fetch_and_crawl(spark):
    def get(u):
        if "bad" in u:
            raise OSError("no")
        return u.encode()

    tasks = spark.createDataFrame([("http://a", 1), ("http://bad", 2)], "uri string, n int")
    got = {r["n"]: r for r in files.fetch(tasks, get, wait=0).collect()}
    assert got[1]["success"] and bytes(got[1]["data"]) == b"http://a" and got[2]["error"] == "OSError: no"
    pages = spark.createDataFrame([("http://s/a", '<a href="/b">x</a>'), ("http://s/b", '<a href="c#f">x</a><a href="/a">'), ("http://s/c", None)], "url string, html string")
    seen = files.crawl(pages, spark.createDataFrame([("http://s/a",)], "url string"), 5)
    assert {r["url"]: r["depth"] for r in seen.collect()} == {"http://s/a": 0, "http://s/b": 1, "http://s/c": 2}


def test_render():
    mail = b"Subject: =?utf-8?b?w6k=?=\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/plain\n\nplain\n--b\nContent-Type: text/html\n\n<p>one</p>\n--b--\n"
    assert render.mail_body(mail) == {"subject": "é", "sender": None, "date": None, "body": "<p>one</p>"}
    tree = [{"type": "heading_2", "text": "T"}, {"type": "bullet", "text": "a", "children": [{"type": "numbered", "text": "b"}]}, {"type": "table", "rows": [["h"], ["c"]]}]
    assert render.blocks_markdown(tree) == "## T\n- a\n  1. b\n| h |\n| --- |\n| c |"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "é"), ("b.txt", None)], "name string, content string")
    assert [tuple(r) for r in writers.files(df, str(tmp_path)).collect()] == [("a.txt", 2)]
    with pytest.raises(Exception, match="outside"):
        writers.files(spark.createDataFrame([("../x", "a")], "name string, content string"), str(tmp_path)).collect()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert writers.retry(flaky, wait=0) == 5
    v = spark.createDataFrame([(1, [1.0]), (2, None)], "i int, vector array<double>")
    assert not writers.vectors_complete(v) and writers.vectors_complete(v.where("i = 1")) and not writers.vectors_complete(v.limit(0))


def test_streams(spark, tmp_path):
    from docgraph.streaming import events

    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    pdf = pd.DataFrame({"k": [1, 1, 1, 2], "value": [1.0, 2.0, 3.0, 4.0], "ts": pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:50", "2024-01-01 01:10", "2024-01-03 00:00"])})
    spark.createDataFrame(pdf).write.parquet(src)
    stream = events.windowed(events.read_events(spark, src, spark.read.parquet(src).schema), ["k"], "value")
    q = events.write_parquet(stream, out, str(tmp_path / "c"))
    q.awaitTermination(120)
    got = {(r["k"], r["window_start"].hour, r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, 2, 3.0), (1, 1, 1, 3.0)}  # the last window stays open
    with pytest.raises(ValueError):
        refine.chain(spark.createDataFrame([("a",)], "content string"), ["nothing"])


def test_recipes(spark):
    from docgraph.plans import recipes

    nodes, edges = recipes.normal(spark.createDataFrame([(1, "one two. " * 40), (2, None), (3, "one two. " * 40)], "doc_id int, content string"), 100, 0)
    n = nodes.count()
    assert n > 3 and edges.count() == 2 * (n - 1)
    nodes, _, failures = recipes.standard(spark.createDataFrame([("a.docx", DOCX), ("e.pdf", b"%PDF")], "path string, content binary"))
    assert nodes.count() == 1 and [r["doc_id"] for r in failures.collect()] == ["e.pdf"]
    kept = []
    recipes.transfer(nodes, lambda df: kept.append(df.count()), lambda df: df.limit(0))
    assert kept == [0]


def test_core(spark, monkeypatch):
    from docgraph import core

    c = core.Config({"a": {"b": 1}})
    monkeypatch.setenv("X_Y", "env")
    c.set("q.r", 2)
    assert (c.get("a.b"), c.get("x.y"), c.get("n", 5), c.section("q"), c.merged({"a": 3}).get("a"), c.get("a.b")) == (1, "env", 5, {"r": 2}, 3, 1)
    assert core.safe_run(lambda: 1 / 0, 7) == 7
    heard = []

    class Bad:
        def on_start(self, name):
            raise OSError

        def on_finish(self, name, out):
            heard.append((name, out))

    assert core.Callbacks(Bad()).run("x", lambda: 3) == 3 and heard == [("x", 3)]
    df, o = core.observed(spark.range(10), "o", n=F.count("*"))
    df.collect()
    assert o.get["n"] == 10


def test_repeated_ids_keep_their_own_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 1500), (1, "b" * 700)], "doc_id long, content string")
    audited = {(r["content"][0], r["part_index"], r["original_length"]) for r in chunk.audited_chunks(df).collect()}
    assert audited == {("a", 0, 1500), ("a", 1, 1500), ("b", 0, 700)}
    for fixed in (False, True):
        rows = chunk.parent_child_chunks(df, 2000, 400, fixed=fixed).collect()
        parents = sorted((r["content"][0], len(r["child_ids"])) for r in rows if r["is_parent"])
        assert parents == [("a", 4), ("b", 2)] and sum(not r["is_parent"] for r in rows) == 6


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "long enough", 7), (2, "long enough", 8), (3, None, 9), (4, None, 9), (5, "ab", 9), (6, "ab", 9)], "id long, content string, __n long")
    out = refine.dedup_blocks(df, "content", ["id"])
    assert out.columns == df.columns and {(r["id"], r["__n"]) for r in out.collect()} == {(1, 7), (3, 9), (4, 9), (5, 9), (6, 9)}
    up = an.upsert(df.select("id", "__n"), df.select("id", (F.col("__n") + 1).alias("__n"), F.lit(1).alias("at")).where("id < 3"), ["id"], "at")
    assert {r["id"]: r["__n"] for r in up.collect()} == {1: 8, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9}


def test_intervals_without_chapters_and_on_their_edges(spark):
    rec = spark.createDataFrame([(1, 0.0, "a"), (1, 5.0, "b"), (1, 10.0, "c")], "v long, t double, text string")
    none = spark.createDataFrame([], "title string, start_time double, end_time double")
    assert [(r["title"], r["content"]) for r in chunk.interval_chunks(rec, none, ["v"], "t", ["t"], "text").collect()] == [(None, "a b c")]
    some = spark.createDataFrame([("x", 0.0, 5.0), ("y", 5.0, 10.0)], "title string, start_time double, end_time double")
    got = {r["title"]: r["content"] for r in chunk.interval_chunks(rec, some, ["v"], "t", ["t"], "text").collect()}
    assert got == {"x": "a", "y": "b c"}


def test_nearest_batch_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 7 = 0")
    got = {}
    for r in an.nearest_batch(df, q, 3, block=4, itself=False).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    for i in range(0, 60, 7):
        order = sorted((round(float(d[i, j]), 6), j) for j in range(60) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]


def test_nearest_batch_scores_a_part_at_a_time(spark, monkeypatch):
    """The pairs that are scored at once don't grow with the queries; the results are those of all at once."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in rng.standard_normal(8)]) for i in range(400)], "vec_id long, embedding array<double>").coalesce(1)
    want = sorted(map(tuple, an.nearest_batch(df, df, 3, itself=False, digits=5).collect()))
    monkeypatch.setattr(an, "PAIRS", 1000)
    assert sorted(map(tuple, an.nearest_batch(df, df, 3, itself=False, digits=5).collect())) == want

    held = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: held.append(run) or self.limit(0).selectExpr("vec_id AS query_id", "vec_id", "0D AS score"))
    an.nearest_batch(df, df, 3)
    pdf = df.toPandas()
    tracemalloc.start()
    rows = sum(len(x) for x in held[0](iter([pdf])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1200 and peak < 1_500_000  # 400 x 400 scores alone are 1.3 MB, and were held several times


def test_topics_count_every_word(spark):
    df = spark.createDataFrame([(i, f"common once{i}") for i in range(6)] + [(9, "unseen"), (10, "...")], "doc_id long, content string")
    out = chunk.topic_chunks(df, topics=2)
    assert {r["doc_id"] for r in out.collect()} == {0, 1, 2, 3, 4, 5, 9}


def test_topics_by_hand(spark, monkeypatch):
    """As one loop over texts and words would have it, however rows lie and blocks are cut; no vocabulary at the driver."""
    from pyspark.ml.feature import CountVectorizer

    from docgraph.operators import topics as lda

    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: pytest.fail("the vocabulary goes to the driver"))
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'xyz'[i % 3]}{chr(97 + j)}" for j in rng.integers(0, 12, 30)) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "?"), (7, texts[7])]
    df = spark.createDataFrame(rows, "key long, text string")
    got = chunk.topic_chunks(df.repartition(7), content="text", id_col="key").collect()
    monkeypatch.setattr(lda, "BLOCK", 100)
    assert sorted(map(tuple, chunk.topic_chunks(df.coalesce(1), content="text", id_col="key").collect())) == sorted(map(tuple, got))

    full = df.where("text rlike '[a-z]'").selectExpr("key", "xxhash64(key, text) AS d", "split(text, ' ') AS w", "transform(split(text, ' '), x -> xxhash64(x)) AS h").collect()
    words = sorted({(h, w) for r in full for h, w in zip(r["h"], r["w"], strict=True)})
    place = {h: i for i, (h, _) in enumerate(words)}
    lam, alpha = lda.draws(np.array([h for h, _ in words]), 3, 1), np.full(3, 1 / 3)
    e_log = lambda x: lda.digamma(x) - lda.digamma(np.array([x.sum()]))
    start = np.random.default_rng(1).gamma(100, 0.01, 3)

    def one(r):
        at, n = np.unique([place[h] for h in r["h"]], return_counts=True)
        beta, gamma, moved = np.exp(np.stack([e_log(lam[:, k]) for k in range(3)], 1))[at], start, 1
        while moved > 1e-3:
            theta = np.exp(e_log(gamma))
            new = theta * (beta.T @ (n / (beta @ theta + 1e-100))) + alpha
            moved, gamma = np.abs(new - gamma).mean(), new
        theta = np.exp(e_log(gamma))
        return gamma, at, beta * theta * (n / (beta @ theta + 1e-100))[:, None]

    done = 0
    for t in range(1, 11):
        batch = [r for r in full if lda.uniform(np.array([r["d"]]), 1, 1, t)[0] < 0.05]
        if not batch:
            continue
        done += 1
        rho, stat, found = (1024 + done) ** -0.51, np.zeros_like(lam), [one(r) for r in batch]
        for _, at, s in found:
            stat[at] += s
        lam = (1 - rho) * lam + rho * (stat * len(full) / math.ceil(0.05 * len(full)) + 1 / 3)
        m = len(batch)
        slope, q, z = m * (np.mean([e_log(g) for g, *_ in found], axis=0) - e_log(alpha)), -m * lda.trigamma(alpha), m * lda.trigamma(alpha.sum())
        step = rho * -(slope - (slope / q).sum() / (1 / z + (1 / q).sum())) / q
        alpha = alpha + step if (alpha + step > 0).all() else alpha
    best = [json.dumps([words[i][1] for i in np.argsort(-lam[:, k])[:5]]) for k in range(3)]
    want = sorted((r["key"], int(k := one(r)[0].argmax()), best[k]) for r in full)
    assert done and sorted(map(tuple, got)) == want
    assert len({r["topic"] for r in got}) > 1


def test_topics_digamma():
    from docgraph.operators import topics as lda

    x, h = np.array([0.3, 1.0, 2.5, 40.0, 1e6]), 1e-4
    assert np.allclose(lda.digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], atol=1e-4, rtol=1e-4)
    assert np.allclose(lda.digamma(np.array([1.0])), -0.5772156649015329, atol=1e-11) and np.allclose(lda.trigamma(np.array([1.0])), np.pi**2 / 6, atol=1e-11)


def test_clusters_part_far_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, float(i) / 100]) for i in range(20)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["cluster"] for r in chunk.cluster_sentences(df).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]


def pdf_file(*objects, trailer=b"<< /Root 1 0 R >>"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects) + b"trailer " + trailer + b"\n%%EOF"


def pdf_stream(data, more=b""):
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), more, packed)


PDF = pdf_file(
    (1, b"<< /Type /Catalog /Pages 2 0 R /Outlines 9 0 R >>"),
    (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>"),
    (3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"),
    (4, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>"),
    (5, pdf_stream(b"BT /F1 24 Tf 72 700 Td (Big \\(Title\\)) Tj ET BT /F1 10 Tf 72 650 Td (First line) Tj 0 -12 Td [(sec) -20 (ond) -400 (line)] TJ ET % note\nBT /F1 10 Tf 72 500 Td (Far b\\351low) Tj ET")),
    (6, pdf_stream(b"BT /F2 10 Tf 1 0 0 1 50 50 Tm <00010002> Tj <0003> Tj ET BI /W 1 ID xx EI")),
    (7, b"<< /Type /Font /Subtype /Type1 >>"),
    (8, b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>"),
    (9, b"<< /First 11 0 R >>"),
    (10, pdf_stream(b"1 beginbfchar <0001> <D55C> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange")),
    (11, b"<< /Title (Chapter) >>"),
)


def test_pdf(spark):
    got = {r["doc_id"]: r for r in office.parse_documents(spark.createDataFrame([("a.pdf", PDF), ("b.pdf", b"%PDF-1.7 nothing"), ("c.pdf", pdf_file((1, b"<< >>"), trailer=b"<< /Encrypt 3 0 R >>"))], "path string, content binary")).collect()}
    first, second = got["a.pdf"]["pages"]
    assert [(e["semantic_type"], e["heading_level"], e["text"]) for e in first["elements"]] == [("heading", 1, "Big (Title)"), ("paragraph", None, "First line\nsecond line"), ("paragraph", None, "Far b\u00e9low")]
    assert [e["text"] for e in first["header_elements"]] == ["Chapter"] and [e["text"] for e in second["elements"]] == ["\ud55cab"]
    assert "no pages" in got["b.pdf"]["error"] and "encrypted" in got["c.pdf"]["error"]
    packed = b"1 0 2 33 3 95 " + b"<< /Type /Catalog /Pages 2 0 R >>" + b"<< /Kids [3 0 R] /Resources << /Font << /F1 << >> >> >> >>   " + b" << /Type /Page /Contents 5 0 R >>"
    body = [(4, pdf_stream(packed, b"/Type /ObjStm /N 3 /First 14")), (5, pdf_stream(b"BT /F1 9 Tf (in a stream) ' ET"))]
    assert pdf.pdf(pdf_file(*body))[0]["elements"][0]["text"] == "in a stream"
    chunks = chunk.page_chunks(office.parse_documents(spark.createDataFrame([("a.pdf", PDF)], "path string, content binary"))).collect()
    assert [(r["part_index"], r["content"].split("\n")[0]) for r in sorted(chunks, key=lambda r: r["part_index"])] == [(0, "# Chapter"), (1, "\ud55cab")]


def fake_client():
    """Answers by address and page, as the services give them."""
    feed = "<rss><channel>" + "".join(f"<item><title>T{i}</title><link>l{i}</link><description>short</description></item>" for i in range(15)) + "<item><title>x</title><encoded>&lt;p&gt;full&lt;/p&gt;</encoded></item></channel></rss>"

    def call(address, p):
        if address == "feed":
            return feed
        if "/contents/" in address:
            tree = {"": [{"type": "dir", "path": "d"}, {"type": "file", "path": "a.py", "download_url": "raw:a"}], "d": [{"type": "file", "path": "d/b.py", "download_url": "raw:b"}, {"type": "file", "path": "d/c.md", "download_url": "raw:c"}]}
            return tree[address.split("/contents/")[1]]
        if address.startswith("raw:"):
            return "code " + address
        if address.endswith("/issues"):
            return [{"html_url": f"i{p['page']}{k}", "title": "t", "body": None, "number": k} | ({"pull_request": {}} if k == 0 else {}) for k in range(3)] if p["page"] < 20 else []
        if address == "films":
            return [{"_id": i, "v": i} for i in range(7) if i >= p["filter"].get("least", 0)][: p["limit"]]
        if "conversations.history" in address:
            return {"messages": [{"ts": "1", "text": "hi", "user": "u", "reply_count": 1}], "response_metadata": {"next_cursor": "" if p.get("cursor") else "c"}}
        if "conversations.replies" in address:
            return {"messages": [{"ts": "1", "text": "hi", "user": "u"}, {"ts": "2", "text": "yo", "user": "v"}]}
        if "discord" in address:
            at = int(p.get("before", 50))
            return [{"id": str(i), "content": f"m{i}"} for i in range(at - 1, max(-1, at - 11), -1)]
        if "/search" in address and "jql" in p:
            return {"issues": [{"key": f"K-{i}", "fields": {"summary": "s"}} for i in range(p["startAt"], min(30, p["startAt"] + 8))]}
        if address.endswith("/children"):
            block = {"type": "paragraph", "id": "k", "has_children": address.split("/")[-2] == "p", "paragraph": {"rich_text": [{"plain_text": address.split("/")[-2]}]}}
            return {"results": [block], "next_cursor": None}
        if "wikipedia" in address:
            return {"query": {"pages": {"1": {"title": "A b", "extract": "Text"}}}}
        if address == "search":
            return list(range(1, 31))
        if address == "fetch":
            return b"Subject: =?utf-8?b?w6k=?=\r\nFrom: a@b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>body %d</p>" % p["id"]
        raise RuntimeError("no such address")

    return call


def test_services(spark):
    def run(service, limit=None, **task):
        return services.read(spark.createDataFrame([(json.dumps(task),)], "task string"), service, fake_client, limit).collect()

    feed = run("rss", url="feed")
    assert len(feed) == 10 and feed[0]["content"] == "# T0\n\nshort" and run("rss", 0, url="feed")[-1]["content"] == "# x\n\nfull"
    assert [r["source"] for r in run("github_code", repo="a/b", extensions=[".py"])] == ["a.py", "d/b.py"]
    issues = run("github_issues", repo="a/b")
    assert len(issues) == 20 and issues[0]["source"] == "i11"
    assert len(run("mongodb", collection="films", query={"least": 3})) == 4
    threads = run("slack", channel="C")
    assert [r["content"] for r in threads] == ["hi\n- **v**: yo"] * 2
    assert len(run("discord", channel="1")) == 20 and len(run("discord", 0, channel="1")) == 50
    assert len(run("jira", 0, base="http://j", project="K")) == 30
    assert run("notion", page="p")[0]["content"] == "p\n  k"
    assert run("wikipedia", title="A b")[0]["source"] == "https://ko.wikipedia.org/wiki/A_b"
    mails = run("mail")
    assert len(mails) == 10 and mails[0]["content"] == "body 30" and mails[0]["meta"]["subject"] == "\u00e9"
    bad = run("web_page", url="nowhere")
    assert [r["success"] for r in bad] == [False] and "no such address" in bad[0]["error"]
    assert [r["success"] for r in services.read(spark.createDataFrame([(None,)], "task string"), "rss", fake_client).collect()] == [False]


def test_readable():
    html = "<html><head><title>x</title></head><body><nav><p>menu</p></nav><article><h2>Top &amp; more</h2><p>A <b>b</b></p><ul><li><a href='x'>only a link</a></li><li>point</li></ul></article><footer><p>foot</p></footer></body></html>"
    assert services.readable(html) == "## Top & more\n\nA b\n\n- point"
    assert services.readable(None) == "" and services.readable("plain") == "plain"


def test_retrieval(spark):
    df = spark.createDataFrame([("/data/a.txt", "A"), ("/data/sub/b.txt", "B"), ("/etc/passwd", "no")], "path string, content string")
    assert [r["content"] for r in retrieve.by_file(df, "/data", "sub/../sub/b.txt").collect()] == ["B"]
    for name in ("../etc/passwd", "/etc/passwd"):
        with pytest.raises(ValueError):
            retrieve.by_file(df, "/data", name)
    ask = retrieve.Dispatcher(file=lambda name: retrieve.by_file(df, "/data", name), key=lambda value: retrieve.by_key(df, "content", value))
    assert ask("key", value="A").count() == 1 and ask("key", value=None).count() == 0 and ask("file", name="a.txt").count() == 1
    with pytest.raises(retrieve.UnknownRequest):
        ask("other")
    with pytest.raises(ValueError):
        ask("key", wrong=1)


def test_encoded_files(spark, capsys):
    assert writers.encoded(b"%PDF-1") == (b"%PDF-1", ".pdf") and writers.encoded("x")[1] == ".txt" and writers.encoded(" <html>")[1] == ".html"
    assert writers.encoded({"a": [1]}) == (b'{"a": [1]}', ".json") and writers.encoded({1, 2})[1] == ".pkl"
    assert writers.encoded("x", mime="text/csv; charset=utf-8")[1] == ".csv" and writers.encoded("x", ".md", "text/csv")[1] == ".md"
    writers.console(spark.range(2))
    assert "id" in capsys.readouterr().out


def test_neo4j_nodes_and_relations(spark, tmp_path):
    def run(statement, rows):
        with open(tmp_path / f"{uuid.uuid4().hex}.json", "w") as f:
            json.dump([statement, rows], f)

    nodes = spark.createDataFrame([("a", "Te:xt"), ("b", "Topic")], "node_id string, node_class string")
    edges = spark.createDataFrame([("a", "b", "hasParent"), ("b", "a", "has`Child")], "source string, target string, type string")
    writers.neo4j_batches(nodes, run, edges)
    said = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert {re.search(r"\(n:`(.*?)`|r:`(.*?)`", s)[0] for s, _ in said} == {"(n:`Te_xt`", "(n:`Topic`", "r:`hasParent`", "r:`has_Child`"}
    assert sum(len(rows) for _, rows in said) == 4
