"""Apportionment and fixity audits against brute force and DuckDB."""

import duckdb
import numpy as np
import pytest

from docgraph.llm import mixing, warc
from docgraph.llm import tokens as tk
from tests.llm.conftest import frame, prose


def test_apportion_brute():
    rng = np.random.default_rng(0)
    for _ in range(200):
        keys = [f"k{i}" for i in range(int(rng.integers(1, 6)))]
        weights = {k: float(rng.integers(0, 5)) for k in keys}
        cap = {k: int(rng.integers(0, 15)) for k in keys}
        seats = int(rng.integers(0, 40))
        ranked = sorted((-weights[k] / (2 * n + 1), k) for k in keys for n in range(cap[k]) if weights[k] > 0)[:seats]
        got = mixing.apportion(seats, weights, cap)
        assert all(got.get(k, 0) == sum(x == k for _, x in ranked) for k in keys)


def test_count_words():
    import pyarrow as pa

    texts = ["", None, "a", " a  b\tc\n", "\n", "größe 日本 x", "x" * 1000, "b"]
    assert tk.count_words(pa.array(texts)).tolist() == [len((t or "").split()) for t in texts]


def test_mixing_quotas_and_blocks(spark):
    rows = [(i, prose(i, 40 + i % 50), f"s{i % 3}") for i in range(300)]
    want = {"s0": 3, "s1": 1, "s2": 0}
    out = mixing.mixed_texts(frame(spark, rows), want, block_tokens=64, shard_tokens=1000).collect()
    tokens, total = {}, {}
    for i, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    for r in out:
        key = r["source"], r["block"]
        tokens[key] = tokens.get(key, 0) + r["end_token"] - r["start_token"]
        assert r["text"].split() == rows[r["doc_id"]][1].split()[r["start_token"] : r["end_token"]] != []
    assert all(n == 64 or k[1] == total[k[0]] // 64 for k, n in tokens.items())
    n = {s: sum(k[0] == s for k in tokens) for s in ("s0", "s1", "s2")}
    assert n["s2"] == 0 and n["s0"] > n["s1"] > 0
    assert len({r["shard"] for r in out}) > 3
    again = mixing.mix_sources(frame(spark, rows), want, block_tokens=64, shard_tokens=1000).collect()
    assert sorted(tuple(r)[:6] for r in out) == sorted(map(tuple, again))


def test_mixing_loses_nothing(spark):
    """With a fraction of one every word of every source is in a block, in whatever shards; small sources too."""
    rows = [(i, prose(i, 10 + i % 7), f"small{i % 40}") for i in range(200)] + [(1000 + i, prose(i, 100), "hot") for i in range(60)]
    for shard_tokens in (50, 1 << 20):
        out = mixing.mix_sources(frame(spark, rows), fraction=1.0, block_tokens=256, shard_tokens=shard_tokens).collect()
        assert len({r["source"] for r in out}) == 41
        assert sum(r["end_token"] - r["start_token"] for r in out) == sum(len(t.split()) for _, t, _ in rows)


@pytest.mark.parametrize("shard_tokens", [2000, mixing.SHARD_TOKENS])
def test_mixing_oracle(spark, shard_tokens):
    rows = [(i, prose(i, 300 + i), ["a", "b", None][i % 3]) for i in range(60)]
    df = frame(spark, rows)
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841 — DuckDB reads it by name
    want = duckdb.sql(mixing.oracle(shard_tokens=shard_tokens)).fetchall()
    assert sorted(map(tuple, mixing.mix_sources(df, shard_tokens=shard_tokens).collect())) == sorted(want)


def test_mixing_odd(spark, odd, odd_rows, none):
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    out = mixing.mixed_texts(odd, fraction=1.0, block_tokens=100).collect()
    words = {}
    for r in out:
        words.setdefault((r["source"], r["doc_id"]), []).extend(r["text"].split())
        assert len(r["text"].split()) == r["end_token"] - r["start_token"]
    want = {}
    for i, t, s in odd_rows:
        if i is not None and t and t.split():
            want.setdefault((s or "unknown", i), []).extend(t.split())
    assert {k: sorted(v) for k, v in words.items()} == {k: sorted(v) for k, v in want.items()}
    assert words["b", 4] == ["word", "word"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id long, digest string, bytes int")


def page(i, html="<p>x</p>", url="http://a"):
    return (i, url, html, 9, "d", 4)


def test_audit_finds_every_kind(spark):
    a = [page(i, f"<p>{i}</p>" * (i % 5 + 1)) for i in range(0, 3000, 3)]
    b = [r for r in a if r[0] != 30]
    b = [page(r[0], "<q>" + r[2][3:]) if r[0] == 300 else page(r[0], r[2][:-2]) if r[0] == 1500 else r for r in b] + [page(600, "<p>600</p>"), page(2999)]
    got = {r["page_id"]: r for r in warc.audit(pages(spark, a), pages(spark, b)).collect()}
    assert {i: r["kind"] for i, r in got.items()} == {30: "missing", 300: "altered", 1500: "truncated", 600: "repeated", 2999: "extra"}
    before = [warc_bytes(r) for r in a if r[0] < 300]
    assert got[300]["start_offset"] == sum(before) and got[2999]["start_offset"] is None


def warc_bytes(r):
    n = len(r[2].encode())
    return len(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{r[0]}>\r\nWARC-Target-URI: {r[1]}\r\nContent-Length: {n}\r\n\r\n") + n + 4


def test_audit_odd(spark):
    rows = [page(None), page(1, None), page(1, None), page(-5, ""), page(2, "日本" * 50_000), page(3, "a", None)]
    df = pages(spark, rows)
    assert warc.audit(df, df).count() == 0
    assert {r["page_id"] for r in warc.audit(df, df.limit(0)).collect()} == {1, -5, 2, 3}
    assert {r["kind"] for r in warc.audit(df.limit(0), df).collect()} == {"extra"}
    assert warc.audit(df.limit(0), df.limit(0)).count() == 0
    swapped = pages(spark, rows[::-1])
    assert warc.audit(df, swapped).count() == 0
