"""Exact top-k search by distributed histogram selection.

Every query meets every candidate, in blocks. No block keeps its scores: rounds of global score histograms, one for each
query, narrow down the interval that holds the query's kth score until it is one integer. A last pass emits the scores
above it, and of those equal to it the smallest ids, and a window over these few rows ranks them.

A block need not count scores below its own kth one, for the global kth cannot be lower; so a block adds few bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.llm.common import keep, ship
from tallyhire.llm.exact_scores import TOP, Exact, matrix, places, products, scaled, widened

BINS = 1024
#: Rows of a block: candidates, queries.
CANDIDATES, QUERIES = 16384, 2048


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k candidates of largest inner product for each query; ties go to the smaller id.

    Components become floor(scale * x). A query's own id is no candidate for it. Only vectors of the query's dimension
    are; null vectors, and those with null or non-finite components, take no part. A query row that is repeated counts
    once (of different vectors under one query id, the smallest); repeated candidate rows each count. Scores beyond 64 bits
    compare as they are and are returned as the largest or smallest long. Other columns are ignored, whatever their names.
    Empty tables give no rows.
    """
    spark = candidates.sparkSession
    ship(spark)
    q = keep(scaled(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    c = keep(scaled(candidates, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()))
    norm = lambda df: df.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    (n_q, m_q), (n_c, m_c) = norm(q), norm(c)
    if not n_q or not n_c:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, groups = max(8, -(-n_c // CANDIDATES)), -(-n_q // QUERIES)
    # both sides' keys must be of one type: 64-bit hashes and sequences, as an int and a long are dealt to different partitions
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = c.withColumn("part", F.pmod(F.xxhash64("id", "row"), F.lit(parts).cast("long"))).withColumn("g", every(groups))
    most = (m_q * m_c) ** 0.5 if m_q < 2.0**500 and m_c < 2.0**500 else 2.0**500
    limit = min(TOP, int(most * (1 + 1e-9)) + 2)  # no score is beyond it, by Cauchy and Schwarz
    width = 1
    while width * BINS < 2 * limit + 1:
        width *= BINS

    # lo: the kth score is lo or more; need: how many of the k lie in [lo, lo + BINS * width)
    state = q.select("id", F.lit(-limit).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))

    def side(now: DataFrame) -> DataFrame:
        return q.join(now, "id").withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups).cast("long"))).withColumn("part", every(parts))

    def blocks(qs: pa.Table, cs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Exact]]:
        """(query ids, lo, need, candidate ids, scores with the queries' own at the least value, those cut to 64 bits)"""
        if not qs.num_rows or not cs.num_rows:
            return
        ids, dim = np.asarray(cs["id"]), qs["dim"][0].as_py()
        cv = matrix(cs["v"], dim)
        for at in range(0, qs.num_rows, 256):
            part = qs.slice(at, 256)
            own = np.asarray(part["id"])
            s, exact = products(matrix(part["v"], dim), cv)
            s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield own, np.asarray(part["lo"]), np.asarray(part["need"]), ids, s, exact

    def histogram(width: int):
        def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
            out = [[], [], []]
            for own, lo, need, _, s, _ in blocks(qs, cs):
                above = (s.view(np.uint64) - lo.view(np.uint64)[:, None]) // np.uint64(width)  # right where s >= lo, without overflow
                bins = np.where((s >= lo[:, None]) & (above < BINS), above.astype(np.int64), -1)
                n = min(k, s.shape[1])
                least = np.partition(bins, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                i, j = np.nonzero(bins >= np.maximum(least, 0)[:, None])
                key, count = np.unique(i * BINS + bins[i, j], return_counts=True)
                for column, x in zip(out, (own[key // BINS], key % BINS, count), strict=True):
                    column.append(x)
            return pa.table({n: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for n, x in zip(("id", "bin", "n"), out, strict=True)})

        return run

    while True:
        both = side(state).groupBy("dim", "g", "part").cogroup(dealt.groupBy("dim", "g", "part"))
        bins = both.applyInArrow(histogram(width), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        above = bins.withColumn("upto", F.sum("n").over(down)).join(state, "id").filter(F.col("upto") >= F.col("need"))
        chosen = above.groupBy("id").agg(F.max_by(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "bin").alias("x"))
        # a query with fewer candidates than it needs keeps its lowest bound and takes them all
        up = (F.col("lo").cast("decimal(38,0)") + F.col("x.bin") * F.lit(width).cast("decimal(20,0)")).cast("long")
        lo = F.when(F.col("x").isNull(), F.col("lo")).otherwise(up)
        state = keep(state.join(chosen, "id", "left").select("id", lo.alias("lo"), F.coalesce("x.need", "need").alias("need")))
        if width == 1:
            break
        width //= BINS

    def take(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for own, lo, need, ids, s, exact in blocks(qs, cs):
            i, j = np.nonzero(s > lo[:, None])
            tie_i, tie_j = np.nonzero(s == lo[:, None])
            wide = places(s.shape, exact)
            order = np.lexsort((ids[tie_j], tie_i) if wide is None else (ids[tie_j], -wide[tie_i, tie_j], tie_i))
            tie_i, tie_j = tie_i[order], tie_j[order]
            first = np.searchsorted(tie_i, tie_i, "left")
            few = np.arange(len(tie_i)) - first < need[tie_i]
            i, j = np.concatenate([i, tie_i[few]]), np.concatenate([j, tie_j[few]])
            cut = [exact.get(x) for x in zip(i.tolist(), j.tolist(), strict=True)] if exact else [None] * len(i)
            for column, x in zip(out, (own[i].tolist(), ids[j].tolist(), s[i, j].tolist(), [None if x is None else widened(x) for x in cut]), strict=True):
                column += x
        return pa.table({n: pa.array(x, kind) for n, x, kind in zip(("query_id", "vec_id", "score", "wide"), out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    both = side(state).groupBy("dim", "g", "part").cogroup(dealt.groupBy("dim", "g", "part"))
    found = both.applyInArrow(take, "query_id long, vec_id long, score long, wide string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
