"""Hard-negative mining with angular triangle filtering.

Every vector keeps its norm and its angles to a few reference directions. The angles of two vectors to one direction bound
the angle between them (it is no less than their difference, no more than their sum), and so their cosine, and times
the norms their score. Only candidates whose bounds reach into the window that is asked for get an integer score: for an
anchor's positives, the scores from the kth best lower bound of its label on; for its negatives, the share of its positives'
scores. The bounds are widened by more than rounding can amount to, so nothing is lost.

Anchors meet candidates in blocks. A block yields at most k rows for each anchor, and a window over these ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.llm.common import keep, ship
from tallyhire.llm.exact_scores import TOP, exact_of, first_of_each, matrix, products, scaled, widened

#: Reference directions, and the rows that they are chosen from (the lowest by a hash of the id).
REFERENCES, SAMPLE = 8, 512
#: Rows of a block: candidates, anchors; anchors that are scored at once.
CANDIDATES, ANCHORS, AT_ONCE = 16384, 2048, 64


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow; at least 1, but 0 for null vectors."""
    most = np.abs(v).max(axis=1, initial=0)
    return most * np.sqrt((np.square(v / np.where(most > 0, most, 1)[:, None])).sum(axis=1))


def directions(v: np.ndarray, n: int) -> np.ndarray:
    """At most n unit vectors (rows), each as far from those before it as any row of v; the first is the mean direction."""
    size = norms(v)
    unit = v[size > 0] / size[size > 0, None]
    if not len(unit):
        return np.empty((0, v.shape[1]))
    mean = unit.mean(axis=0)
    found = [mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else unit[0]]
    while len(found) < min(n, len(unit)):
        nearest = np.stack([np.einsum("ij,j->i", unit, f) for f in found]).max(axis=0)
        found.append(unit[int(nearest.argmin())])
    return np.stack(found)


def slack(dim: int) -> float:
    """More than a computed angle can be off: cosines are off by at most (dim + 8) units of rounding, angles by the root of twice that."""
    return 1.01 * float(np.sqrt(4 * (dim + 8) * 2.0**-52)) + 1e-14


def angles_to(v: np.ndarray, size: np.ndarray, refs: np.ndarray) -> np.ndarray:
    unit = v / np.where(size > 0, size, 1)[:, None]
    return np.arccos(np.clip(unit @ refs.T, -1, 1))


def score_bounds(qa: np.ndarray, qn: np.ndarray, ca: np.ndarray, cn: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): what each pair's score lies between, by the triangle inequality on the stored angles. May hold nan: unknown."""
    low, high = np.zeros((len(qn), len(cn))), np.full((len(qn), len(cn)), np.pi)
    for r in range(qa.shape[1]):
        x, y = qa[:, r, None], ca[None, :, r]
        np.maximum(low, np.abs(x - y), out=low)
        total = x + y
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    off = 2 * slack(dim)
    with np.errstate(over="ignore", invalid="ignore"):
        n = qn[:, None] * cn[None, :]
        margin = n * 1e-9 + 1
        return n * np.cos(np.clip(high + off, 0, np.pi)) - margin, n * np.cos(np.clip(low - off, 0, np.pi)) + margin


@dataclass
class Side:
    """Rows of a block as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Side:
        v, angles = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) for c in ("v", "angles"))
        return Side(np.asarray(table["id"]), np.asarray(table["label"]), v, np.asarray(table["norm"]), angles)

    def take(self, at: np.ndarray) -> Side:
        return Side(self.ids[at], self.labels[at], self.v[at], self.norm[at], self.angles[at])


def bounded(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    return score_bounds(q.angles, q.norm, c.angles, c.norm, q.v.shape[1])


def as_float(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def found_table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array(columns[n], kind) for n, kind in kinds.items()})


FOUND = {"anchor": pa.int64(), "nth": pa.int32(), "id": pa.int64(), "score": pa.int64(), "wide": pa.string()}
FOUND_SCHEMA = "anchor long, nth int, id long, score long, wide string"


def positives_in(k: int):
    """The first k candidates of each anchor's label in a block."""

    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in FOUND}
        if qs.num_rows and cs.num_rows:
            anchors, candidates = Side.of(qs), Side.of(cs)
            for label in np.unique(anchors.labels):
                c = candidates.take(np.flatnonzero(candidates.labels == label))
                mine = np.flatnonzero(anchors.labels == label)
                for lo in range(0, len(mine) if len(c.ids) else 0, AT_ONCE):
                    q = anchors.take(mine[lo : lo + AT_ONCE])
                    low, high = bounded(q, c)
                    other = q.ids[:, None] != c.ids[None, :]
                    low = np.where(other & ~np.isnan(low), low, -np.inf)
                    n = min(k, len(c.ids))
                    reached = np.partition(low, len(c.ids) - n, axis=1)[:, len(c.ids) - n] if n == k else np.full(len(q.ids), -np.inf)
                    open_ = other & ~(high < reached[:, None])
                    at = np.flatnonzero(open_.any(axis=0))
                    s, exact = products(q.v, c.v[at])
                    i, j = first_of_each(s, open_[:, at], c.ids[at], np.full(len(q.ids), k), exact)
                    add(out, q.ids[i], np.zeros(len(i), np.int64), c.ids[at][j], s[i, j], [exact.get(x) for x in zip(i.tolist(), j.tolist(), strict=True)])
        return found_table(out, FOUND)

    return run


def add(out: dict[str, list], anchor: np.ndarray, nth: np.ndarray, ids: np.ndarray, score: np.ndarray, exact: list[int | None]) -> None:
    for n, x in (("anchor", anchor), ("nth", nth), ("id", ids), ("score", score)):
        out[n] += x.tolist()
    out["wide"] += [None if x is None else widened(x) for x in exact]


def negatives_in(k: int, share: tuple[int, int]):
    """The first k candidates of other labels for each anchor and positive in a block, whose scores are so many hundredths of the positive's."""

    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in FOUND}
        if qs.num_rows and cs.num_rows:
            anchors, c, positives = Side.of(qs), Side.of(cs), qs["positives"].to_pylist()
            for lo in range(0, len(anchors.ids), AT_ONCE):
                q = anchors.take(np.arange(lo, min(lo + AT_ONCE, len(anchors.ids))))
                windows: dict[int, list[tuple[int, int, int]]] = {}  # by place among the positives: (row, least, most)
                for i, each in enumerate(positives[lo : lo + AT_ONCE]):
                    for p in each:
                        score = exact_of(p["score"], p["wide"])
                        windows.setdefault(p["nth"], []).append((i, -(-share[0] * score // 100), share[1] * score // 100))
                least, most = np.full(len(q.ids), np.inf), np.full(len(q.ids), -np.inf)
                for each in windows.values():
                    for i, a, b in each:
                        if a <= b:
                            least[i], most[i] = min(least[i], as_float(a - abs(a) // 10**12 - 1)), max(most[i], as_float(b + abs(b) // 10**12 + 1))
                low, high = bounded(q, c)
                open_ = (q.labels[:, None] != c.labels[None, :]) & (least <= most)[:, None] & ~(high < least[:, None]) & ~(low > most[:, None])
                at = np.flatnonzero(open_.any(axis=0))
                if not len(at):
                    continue
                s, exact = products(q.v, c.v[at])
                open_ = open_[:, at]
                for nth, each in windows.items():
                    a, b = np.full((2, len(q.ids)), [[TOP], [-TOP]], np.int64)
                    bounds = {}
                    for i, x, y in each:
                        a[i], b[i] = max(-TOP, min(TOP, x)), max(-TOP, min(TOP, y))
                        bounds[i] = x, y
                    taken = open_ & (s >= a[:, None]) & (s <= b[:, None])
                    for (i, j), score in exact.items():
                        taken[i, j] = open_[i, j] and i in bounds and bounds[i][0] <= score <= bounds[i][1]
                    i, j = first_of_each(s, taken, c.ids[at], np.full(len(q.ids), k), exact)
                    add(out, q.ids[i], np.full(len(i), nth), c.ids[at][j], s[i, j], [exact.get(x) for x in zip(i.tolist(), j.tolist(), strict=True)])
        return found_table(out, FOUND)

    return run


def with_angles(rows: DataFrame) -> DataFrame:
    """rows (id, v, dim, label, anchor) with norm and angles, to references that are chosen for each dimension from a bounded sample."""
    sample = rows.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("dim", "v").toArrow()
    dims = np.asarray(sample["dim"])
    refs = {d: directions(np.asarray(sample["v"].take(pa.array(np.flatnonzero(dims == d))).to_pylist(), np.float64), REFERENCES) for d in np.unique(dims).tolist()}
    # at most SAMPLE vectors in all
    shared = rows.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, norm, angles = np.asarray(batch.column(2)), np.zeros(batch.num_rows), [[]] * batch.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = matrix(batch.column(1).take(pa.array(at)), d)
                norm[at] = norms(v)
                if d in shared.value:
                    for k, row in zip(at.tolist(), angles_to(v, norm[at], shared.value[d]).tolist(), strict=True):
                        angles[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), pa.array(angles, pa.list_(pa.float64()))], ["id", "v", "dim", "label", "anchor", "norm", "angles"])

    return rows.mapInArrow(run, "id long, v array<double>, dim int, label long, anchor boolean, norm double, angles array<double>")


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, share: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    anchors: which rows are anchors; label: whole numbers. Components become floor(scale * x). An anchor's positives are
    the first n_positives other rows of its label and dimension by score; its hard negatives for each are the first n_negatives rows of
    other labels whose score is share[0] to share[1] hundredths of the positive's. Ties go to the smaller id. Rows with a null
    id, label or vector, or null or non-finite components, take no part. An anchor id that repeats counts once, with its
    smallest label and vector; other repeated rows each count. Scores beyond 64 bits compare as they are and are returned
    as the largest or smallest long. Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    part = scaled(vectors.filter(label.isNotNull()), id_col, vector_col, scale, label=label.cast("long"), anchor=F.coalesce(anchors, F.lit(False)))
    rows = keep(with_angles(part).withColumn("row", F.monotonically_increasing_id()))
    q = keep(rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "v", "dim", "norm", "angles")).alias("x")).select("id", "x.*"))
    n_q, n_c = q.count(), rows.count()
    if not n_q:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts, groups = max(8, -(-n_c // CANDIDATES)), -(-n_q // ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # both sides' keys are longs, as an int and a long of one value are dealt to different partitions
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "row"), F.lit(parts).cast("long"))).withColumn("g", every(groups))
    side = lambda df: df.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups).cast("long"))).withColumn("part", every(parts))
    meet = lambda df, run: side(df).groupBy("dim", "g", "part").cogroup(dealt.groupBy("dim", "g", "part")).applyInArrow(run, FOUND_SCHEMA)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.desc("wide"), "id")
    positives = keep(meet(q, positives_in(n_positives)).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n_positives))
    lists = positives.groupBy("anchor").agg(F.collect_list(F.struct("nth", "score", "wide")).alias("positives"))  # n_positives each
    asked = q.join(lists.withColumnRenamed("anchor", "id"), "id")
    hardest = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.desc("wide"), "id")
    negatives = meet(asked, negatives_in(n_negatives, share)).withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= n_negatives)
    named = positives.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor", "nth"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
