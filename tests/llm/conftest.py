import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h1 string, root string, n int, block int, `end` int"


def frame(spark, rows):
    """documents with extra columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", 1, 2, 3) for i, t, s in rows], SCHEMA)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(names, n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeated rows and a very long text."""
    long = prose(3, 60_000)
    return [(1, None, "a"), (None, "no id here at all", "a"), (2, "", None), (3, " \n\t ", "b"), (4, "word", "b"), (4, "word", "b"), (5, "word", None), (6, long, "c"), (7, "!!! ... ???", "c"), (8, "größe 日本語 text", "c"), (8, None, "c")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
