"""The pipeline's stages in order, their columns, and their effects against the operators' own reports."""

import duckdb
import pytest

import corpus_pipeline
from docgraph.llm import decontaminate, mixing, queries, secrets, simhash, toxicity
from docgraph.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs, stage(spark, docs, DIR).cache()
        if name == "toxicity":
            gone = {r["doc_id"] for r in toxicity.toxic_documents(before, table(spark, DIR, "labels")).collect()}
        elif name == "near_duplicates":
            gone = {r["doc_id"] for r in simhash.near_duplicates(before).collect()}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.contaminated(before, table(spark, DIR, "benchmark")).collect()}
        elif name == "secrets":
            gone = set()
            assert {r["doc_id"] for r in out.where("contains(text, '[SECRET]')").collect()} >= {r["doc_id"] for r in secrets.find_secrets(before).collect()}
        else:
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mixed_texts(before).collect()))
            assert out.where("text IS NULL OR text = ''").count() == 0
            continue
        assert out.columns == before.columns
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        assert ids(out) == [i for i in ids(before) if i not in gone]
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_stages_of_odd_tables(spark, odd, none):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, DIR)
            was, now = sorted(map(tuple, before.collect()), key=key), sorted(map(tuple, docs.collect()), key=key)
            if name == "near_duplicates":  # 5 repeats 4; rows without an id, a text or a word stay
                assert now == [r for r in was if r[0] != 5]
            elif name != "mixing":
                assert docs.columns == df.columns and now == was
            else:
                assert {r[3] for r in now} <= {4, 6, 7, 8}
                if df is odd:  # one short block each of b, and half of the blocks of c
                    words = {r[0]: sum(x[1] and len(x[1].split()) or 0 for x in was if x[0] == r[0]) for r in was}
                    assert all(0 <= r[4] < r[5] <= words[r[3]] and len(r[6].split()) == r[5] - r[4] for r in now)
                    assert {r[0] for r in now} == {"b", "c"}


def test_run_keeps_only_the_last_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["source", "shard", "block", "doc_id", "start_token", "end_token", "text"] and out.count() > 0
    (folder,) = tmp_path.iterdir()
    assert [p.name for p in folder.iterdir()] == ["mixing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DIR).select(*want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
