"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences and a remainder. The remainders' lengths, rounded up to multiples of
CLASS_WIDTH, make a histogram of at most capacity / CLASS_WIDTH classes. A linear program over patterns (how many
remainders of each class share a sequence) uses as few sequences as it can; its columns are priced by a knapsack dynamic
program over the dual values. Rounded-down pattern counts are dealt to the documents by their rank within a class; what
rounding leaves (a bounded number) is filled largest first.

The program's size depends on the capacity only. Spark tokenizes, counts, ranks and assigns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.llm.bpe import loaded
from tallyhire.llm.common import give_back, keep, ship

CAPACITY = 2048
CLASS_WIDTH = 8
#: Parts of a class that are ranked apart, so that no task ranks a whole class.
RANK_PARTS = 256


#: Patterns that one pricing adds to the pool, pivots before the next one, pivots before the basis is inverted anew.
POOL, PRICE_EVERY, INVERT_EVERY = 48, 48, 300


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix by Gauss-Jordan elimination in numpy's own loops.

    A driver shares its process with Spark's threads, and threaded LAPACK calls were seen to hang there; so the linear
    program calls neither LAPACK nor BLAS.
    """
    n = len(a)
    work = np.concatenate([a, np.eye(n)], axis=1)
    for k in range(n):
        r = k + int(np.abs(work[k:, k]).argmax())
        if r != k:
            work[[k, r]] = work[[r, k]]
        work[k] /= work[k, k]
        column = work[:, k].copy()
        column[k] = 0
        rows = np.flatnonzero(column)
        work[rows] -= column[rows, None] * work[k]
    return work[:, n:]


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrix times vector, without BLAS."""
    return np.einsum("ij,j->i", a, v)


def price(duals: np.ndarray, units: np.ndarray, room: int, most: int = 1) -> tuple[float, np.ndarray]:
    """The largest dual value of a pattern that fits in room, and up to `most` patterns, best first (rows): unbounded knapsack.

    The patterns are the best ones that hold each class. units ascend.
    """
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(units, np.arange(room + 1), "right").tolist()
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        k = fits[w]
        if k:
            value = best[w - units[:k]] + duals[:k]
            j = int(value.argmax())
            if value[j] > best[w] + 1e-12:
                best[w], took[w] = value[j], j
    holding = duals + best[room - units]
    found: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-holding, kind="stable").tolist():
        pattern, w = np.zeros(len(units), np.int64), room - int(units[first])
        pattern[first] = 1
        while w > 0:
            if took[w] < 0:
                w -= 1
            else:
                pattern[took[w]] += 1
                w -= int(units[took[w]])
        found.setdefault(pattern.tobytes(), pattern)
        if len(found) >= most or (len(found) > 1 and holding[first] <= 1 + 1e-7):
            break
    return float(best[room]), np.stack(list(found.values()))


def largest_first(units: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A basis (columns): patterns filled with the largest classes left, each used until a class is used up.

    No later pattern holds that class, so the patterns are independent.
    """
    left, open_, out = demand.astype(np.float64), np.ones(len(units), bool), []
    while open_.any():
        p, w = np.zeros(len(units)), room
        for k in np.flatnonzero(open_)[::-1].tolist():
            p[k] = w // units[k]
            w -= int(p[k]) * int(units[k])
        held = np.flatnonzero(p)
        uses = left[held] / p[held]
        last = int(uses.argmin())
        left[held] = np.maximum(left[held] - uses[last] * p[held], 0)
        open_[held[last]] = False
        out.append(p)
    return np.stack(out, 1)


def column_generation(units: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used, possibly a fraction, so that demand is met exactly, and a bound no plan can beat.

    Revised simplex, begun with the patterns of largest_first. A pricing fills a pool of patterns, from which pivots take the
    best until none is worth more than a sequence. Prices are drawn towards those of the best bound so far, at first the
    lengths themselves, so that they don't swing; where these find nothing, the basis's own prices decide. It ends when no
    pattern is worth more than a sequence, or, with a gap, when the bound proves that no plan saves one sequence, or the
    share `gap` of all; at the latest after 400 pivots a class, as rounding errors could make it go round in circles.
    The basis is inverted anew now and then, so that errors don't add up.
    """
    m = len(units)
    patterns = largest_first(units, demand, room)  # columns of the basis
    inverse = inverted(patterns)
    x = times(inverse, demand)
    centre = units / room  # prices that no pattern exceeds
    bound, pool, since = float((centre * demand).sum()), np.empty((0, m)), 0
    for nth in range(1, 400 * m + 400):
        duals = inverse.sum(0)
        if gap and x.sum() - bound < max(1.0, gap * bound):
            break
        values = times(pool, duals)
        if not len(values) or values.max() <= 1 + 1e-7 or since >= PRICE_EVERY:
            for drawn in (0.7, 0.0):
                prices = np.maximum(drawn * centre + (1 - drawn) * duals, 0)
                value, found = price(prices, units, room, POOL)
                prices = prices / max(1.0, value)
                if (prices * demand).sum() > bound:
                    bound, centre = float((prices * demand).sum()), prices
                pool = found.astype(np.float64)
                values = times(pool, duals)
                if values.max() > 1 + 1e-7:
                    break
            else:
                break
            since = 0
        pattern = pool[int(values.argmax())]
        u = times(inverse, pattern)
        positive = u > 1e-9
        if not positive.any():
            break
        ratio = np.full(m, np.inf)
        ratio[positive] = np.maximum(x[positive], 0) / u[positive]
        r = int(ratio.argmin())
        patterns[:, r] = pattern
        since += 1
        if nth % INVERT_EVERY == 0:
            inverse = inverted(patterns)
            x = times(inverse, demand)
            continue
        x = x - ratio[r] * u
        x[r] = ratio[r]
        inverse[r] /= u[r]
        u[r] = 0
        rows = np.flatnonzero(u)
        inverse[rows] -= u[rows, None] * inverse[r]
    return patterns.T.astype(np.int64), np.maximum(x, 0), bound


@dataclass
class Plan:
    """For each class, ascending rank segments: first rank, first sequence, items of the class in a sequence, first slot.

    bound: no plan for the rounded lengths has fewer sequences.
    """

    n_sequences: int
    bound: float = 0.0
    segments: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


def plan(histogram: dict[int, int], room: int) -> Plan:
    """Whole patterns for a histogram {class: remainders}, class by class segments of ranks."""
    units = np.asarray(sorted(histogram), np.int64)
    demand = np.asarray([histogram[int(u)] for u in units], np.int64)
    out = Plan(0)
    if not len(units):
        return out
    patterns, uses, out.bound = column_generation(units, demand.astype(np.float64), room)
    whole: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for p, n in sorted(zip(patterns, uses, strict=True), key=lambda z: -z[1]):
        n = int(min([np.floor(n + 1e-7), *(left[p > 0] // p[p > 0])]))
        if n > 0:
            whole.append((p, n))
            left -= n * p
    while left.any():  # at most the items of one use of each pattern, and what numeric error left
        p, w = np.zeros(len(units), np.int64), room
        for k in range(len(units) - 1, -1, -1):
            p[k] = min(left[k], w // units[k])
            w -= p[k] * units[k]
        n = int((left[p > 0] // p[p > 0]).min())
        whole.append((p, n))
        left -= n * p
    rank = np.zeros(len(units), np.int64)
    for p, n in whole:
        slot = 0
        for k in np.flatnonzero(p)[::-1].tolist():
            out.segments.setdefault(int(units[k]), []).append((int(rank[k]), out.n_sequences, int(p[k]), slot))
            rank[k] += n * p[k]
            slot += int(p[k])
        out.n_sequences += n
    return out


def tokenized(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, doc_tokens, crcs): the CRC-32 of each full piece and of the remainder, if any, in order."""
    ship(docs.sparkSession)
    end = np.asarray([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, crcs = [], []
            for ids in bpe.each(batch.column(1)):
                data = np.concatenate([ids.astype("<u4"), end]).tobytes()
                n.append(len(data) // 4)
                crcs.append([crc32(data[i : i + 4 * capacity]) for i in range(0, len(data), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "doc_tokens", "crcs"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, class_width: int = CLASS_WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    Every document, a null or empty one too (its end id alone), has pieces that cover its ids once. Repeated rows and
    null ids are packed like others; other columns are dropped, whatever their names. A sequence holds at most capacity ids,
    without gaps. No documents: no rows.
    """
    spark = docs.sparkSession
    room = capacity // class_width
    full, rest = F.floor(F.col("doc_tokens") / capacity), F.col("doc_tokens") % capacity
    # 256 parts by a hash, of the row's number too: a class that a third of all documents share, even one document that is a
    # third of all rows, is still ranked by many tasks; the parts are fixed once the rows are written
    rows = keep(tokenized(docs, path, end_id, capacity, id_col, text_col).select(
        "*", full.alias("n_full"), F.ceil(rest / class_width).cast("int").alias("class"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(RANK_PARTS)).cast("int").alias("part"),
    ))
    # at most (room + 1) * RANK_PARTS rows, however many documents
    counts = rows.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("n_full").alias("full")).toPandas().sort_values(["class", "part"])
    if counts.empty:
        return spark.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    found = plan({int(c): int(n) for c, n in counts[counts["class"] > 0].groupby("class")["n"].sum().items()}, room)
    counts["rank0"] = counts.groupby("class")["n"].cumsum() - counts["n"]
    counts["full0"] = found.n_sequences + counts["full"].cumsum() - counts["full"]
    offsets = spark.createDataFrame(counts[["class", "part", "rank0", "full0"]].astype("int64"))
    order = Window.partitionBy("class", "part").orderBy("id", "crcs")
    ranked = (
        rows.join(F.broadcast(offsets), ["class", "part"])
        .withColumn("rank", F.col("rank0") + F.row_number().over(order) - 1)
        .withColumn("full_at", F.col("full0") + F.sum("n_full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_full"))
        .select("id", "doc_tokens", "crcs", "class", "rank", "full_at")
    )
    shared = spark.sparkContext.broadcast({c: np.asarray(s, np.int64) for c, s in found.segments.items()})  # a few rows for each class

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, crcs = np.asarray(batch.column(1)), batch.column(2)
            kind, rank, full_at = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 4, 5))
            lists = np.asarray(crcs.offsets).astype(np.int64)
            n = np.diff(lists)
            row = np.repeat(np.arange(len(tokens)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(tokens[row] - nth * capacity, capacity)
            sequence, slot = full_at[row] + nth, np.zeros(len(row), np.int64)
            last = np.cumsum(n) - 1
            for c in np.unique(kind[kind > 0]).tolist():
                mine = np.flatnonzero(kind == c)
                s = segments[c]
                at = s[np.searchsorted(s[:, 0], rank[mine], "right") - 1]
                k = rank[mine] - at[:, 0]
                sequence[last[mine]], slot[last[mine]] = at[:, 1] + k // at[:, 2], at[:, 3] + k % at[:, 2]
            values = crcs.values.slice(int(lists[0]), int(lists[-1] - lists[0]))
            columns = [batch.column(0).take(pa.array(row)), pa.array(nth * capacity), pa.array(length), values, pa.array(tokens[row]), pa.array(sequence), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    cut = ranked.mapInArrow(pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot").withColumnRenamed("id", id_col)
