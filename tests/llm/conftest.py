"""Small document tables with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, shard string, h string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names operators use themselves."""
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", "   \n\t ", "one", "one two three four", base, base, base.replace("w1 ", "zz ", 1), words(rng, 20000, 5000), "é" * 300, "a\x00b\u2028c<|endoftext|>d", "x" * 30000, base.upper(), "tab\tsep  double  blanks \n\n\n end "]
    rows = [(k, t, "en", "s", len(t or ""), 0.1, 1, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
