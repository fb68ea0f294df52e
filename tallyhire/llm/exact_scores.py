"""Exact integer inner products of scaled vectors, however large their components.

Scaled components are whole numbers held as doubles, which is exact at any size: scaling is by a power of two, and doubles
beyond 2^53 are whole. Scores go with Spark's longs. One beyond 64 bits is cut to the largest or smallest of these, and a text
goes with it (see widened), by which cut scores still compare as what they are.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = (1 << 63) - 1
Exact = dict[tuple[int, int], int]  # scores beyond 64 bits by row and column


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int, **others: Column) -> DataFrame:
    """(id, v array<double> of floor(scale * x), dim, others) of the rows that take part.

    Those are the ones whose id and vector are not null, nor empty, and whose components are neither null nor, once scaled,
    beyond what a double holds.
    """
    x = F.col(vector_col)
    times = lambda c: F.lit(float(scale)) * c.cast("double")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(times(c)) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(times(c)) < F.lit(2.0**53), F.floor(times(c)).cast("double")).otherwise(times(c))
    good = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(finite)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"), F.size(x).alias("dim"), *(c.alias(n) for n, c in others.items()))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, Exact]:
    """Inner products cut to TOP and -TOP, and those that were cut.

    In double precision where no sum can pass 2^53, in 64-bit integers where none can pass 2^62; Python's integers bear the
    pairs of vectors so large that they might.
    """
    large = [np.abs(x).max(axis=1, initial=0) for x in (q, c)]
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.outer(*large) * q.shape[1]
    bound[np.isnan(bound)] = 0  # a null vector and one whose bound is beyond doubles
    if bound.max(initial=0) < 2**53:
        return (q @ c.T).astype(np.int64), {}
    fits = [np.where(np.abs(x) < 2**62, x, 0).astype(np.int64) for x in (q, c)]
    out, exact = fits[0] @ fits[1].T, {}
    rows: dict[int, list[int]] = {}
    columns: dict[int, list[int]] = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(bound >= 2**62)), strict=True):
        a = rows.get(i) or rows.setdefault(i, [int(x) for x in q[i].tolist()])
        b = columns.get(j) or columns.setdefault(j, [int(x) for x in c[j].tolist()])
        score = sum(map(mul, a, b))
        out[i, j] = max(-TOP, min(TOP, score))
        if abs(score) >= TOP:
            exact[i, j] = score
    return out, exact


def widened(score: int) -> str:
    """A text that sorts as the numbers do, among those of one sign: length, then digits; of negative ones the nines' complement."""
    digits = str(abs(score))
    if score >= 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def exact_of(score: int, wide: str | None) -> int:
    """The number that a cut score and its text stand for."""
    if wide is None:
        return score
    return int(wide[4:]) if score > 0 else -int("".join(str(9 - int(d)) for d in wide[4:]))


def places(shape: tuple[int, int], exact: Exact) -> np.ndarray | None:
    """Ranks by which cut scores compare, None if nothing was cut."""
    if not exact:
        return None
    out, of = np.zeros(shape, np.int64), {x: k for k, x in enumerate(sorted(set(exact.values())))}
    for at, score in exact.items():
        out[at] = of[score]
    return out


def first_of_each(s: np.ndarray, taken: np.ndarray, ids: np.ndarray, most: np.ndarray, exact: Exact) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's first most[row] taken scores, the largest first, ties by id; ids belong to the columns."""
    if not s.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(int(most.max(initial=0)), s.shape[1])
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.iinfo(np.int64).min
    held = np.where(taken, s, least)
    kth = np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    i, j = np.nonzero(taken & (held >= kth[:, None]))
    wide = places(s.shape, exact)
    order = np.lexsort((ids[j], -s[i, j], i) if wide is None else (ids[j], -wide[i, j], -s[i, j], i))
    i, j = i[order], j[order]
    few = np.arange(len(i)) - np.searchsorted(i, i, "left") < most[i]
    return i[few], j[few]
