"""Hard negatives against brute force; bounds that never cut a score off."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyhire.llm import exact_scores, hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score int, id string"


def brute(rows, every=100, n_positives=5, n_negatives=10, share=(30, 90)):
    whole = lambda x: int(256 * x) if abs(x) > 2**40 else int(np.floor(256 * x))
    ok = [(i, [whole(x) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    cut = lambda x: max(-exact_scores.TOP, min(exact_scores.TOP, x))
    want = []
    for anchor, (y, v) in sorted({a: min((y, v) for b, v, y in ok if b == a) for a, _, _ in ok if a % every == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, z) for i, w, z in ok if i != anchor and len(w) == len(v))
        for s, positive, _ in [x for x in scored if x[2] == y][:n_positives]:
            hard = [x for x in scored if x[2] != y and share[0] * -s <= 100 * -x[0] <= share[1] * -s][:n_negatives]
            want += [(anchor, positive, k + 1, x[1], cut(-s), cut(-x[0])) for k, x in enumerate(hard)]
    return sorted(want)


def found(df):
    rows = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def test_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (4, 8))
    rows = [(k, (centres[k % 4] + rng.normal(0, 0.1, 8)).tolist(), int((k + k // 50) % 4), 1, "x") for k in range(900)] + [(k, [0.25] * 8, k % 2, 1, "x") for k in range(900, 1300)]
    rows += [(2000, None, 1, 1, "x"), (2100, [float("nan")] * 8, 1, 1, "x"), (2200, [None] * 8, 1, 1, "x"), (2300, [float("inf")] + [0.0] * 7, 1, 1, "x"), (None, [0.1] * 8, 1, 1, "x"), (2400, [0.1] * 8, None, 1, "x"), (2500, [0.5] * 3, 1, 1, "x"), (2501, [0.5] * 3, 1, 1, "x"), (2502, [0.3] * 3, 2, 1, "x"), (2600, [], 1, 1, "x"), (2700, [0.0] * 8, 1, 1, "x"), (2800, [-1.0] * 8, 9, 1, "x")]
    rows += [rows[3], rows[100]]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(df) == want and len(want) > 400
    assert found(df.limit(0)) == []


def test_large_components(spark):
    values = [[5e7, 0.5], [-0.25, 3e9], [1e30, -1e30], [0.5, 0.5], [3e9, 3e9], [1e30, 0.0], [0.1, -0.1], [1e30, 2e30], [2e30, 1e30], [1e30, 1.0], [0.0, 0.0], [4e29, 4e29], [5e29, 0.0], [1e300, 1e300], [6e29, 1e20]]
    rows = [(100 * k if k < 5 else k, v, k % 2, 1, "x") for k, v in enumerate(values + values)]
    rows = [(k if k >= 15 else i, v, y, a, b) for k, (i, v, y, a, b) in enumerate(rows)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want and want


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for dim in (1, 3, 64):
        q, c = (np.floor(256 * np.concatenate([rng.normal(0, 1, (40, dim)), np.zeros((1, dim)), np.ones((1, dim)), -np.ones((1, dim)), 1e30 * rng.normal(0, 1, (3, dim))])) for _ in range(2))
        c[:5] = q[:5]
        refs = hard_negatives.directions(np.concatenate([c[:20], q[:5]]), 8)
        sides = [(hard_negatives.angles_to(x, hard_negatives.norms(x), refs), hard_negatives.norms(x)) for x in (q, c)]
        low, high = hard_negatives.score_bounds(*sides[0], *sides[1], dim)
        for i in range(len(q)):
            for j in range(len(c)):
                exact = sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True))
                assert low[i, j] <= exact <= high[i, j]
        assert (high - low)[:40, :40].mean() < 2.01 * (sides[0][1][:40, None] * sides[1][1][None, :40]).mean() + 3


def test_wide_texts_sort_as_numbers():
    numbers = sorted([-(10**40), -(10**40) + 1, -(2**64), -(2**63), -(3 * 10**19), -(10**300)])
    assert sorted(map(exact_scores.widened, numbers)) == [exact_scores.widened(n) for n in numbers]
    assert [exact_scores.exact_of(-1, exact_scores.widened(n)) for n in numbers] == numbers
    numbers = [-n for n in reversed(numbers)]
    assert sorted(map(exact_scores.widened, numbers)) == [exact_scores.widened(n) for n in numbers]
    assert [exact_scores.exact_of(1, exact_scores.widened(n)) for n in numbers] == numbers


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    got = [tuple(r) for r in queries.op12_hard_negatives(spark, data).select(names).collect()]
    assert sorted(got) == sorted(want) and want
