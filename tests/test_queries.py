"""Every registered query against its SQL in DuckDB, over whole tables at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from docgraph.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SLOW = {"c30_kmeans", "c31_topics"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(map(tuple, got.select(*want.columns).collect())) == normal(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_knn_batch_rounds_as_sql(spark, tmp_path):
    """Ranks go by the rounded score; halves and near copies far from the origin are as in SQL, to the last bit."""
    near = [0.300004, 0.300001, 1.128735, 1.128725, 1.148965]
    rows = [(0, [0.0, 0.0]), *((i + 2, [d, 0.0]) for i, d in enumerate(near))]
    rows += [(50, [1e6, 1e6]), *((60 + i, [1e6 + d, 1e6]) for i, d in enumerate((0.25, 0.125001, 0.125004, 0.5, 0.75, 2.0)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(ORACLES["e01_knn_batch"])
    got = QUERIES["e01_knn_batch"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {r["type"] for r in __spark_entry__.entry(spark).collect()} <= {"hasParent", "hasChild"}
