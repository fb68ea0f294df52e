"""N-gram Jaccard join by parity sketches.

A text is its set of distinct word shingles; two link at a Jaccard similarity of 0.8 or more. Then their symmetric
difference is at most (|A| + |B|) / 9. Hashing the shingles into m blocks and XOR-ing those of a block gives a sketch;
each differing shingle changes one block at most, so sketches of linked texts differ in at most d blocks, and of any
d + s blocks at least s agree (pigeonhole). Texts of like size (a band) that agree in a block meet by a shuffle on
(band, block, XOR). As d grows with the sizes, a text gives only the first d + s blocks for its own size and that of its
largest partner; what two linked texts differ in is within the d of either, so it is the shorter run of blocks in which
s agree. What meets is filtered by the Hamming distance of parity sketches of two to four bits a shingle, also
a lower bound of the symmetric difference, and then verified on the whole sets.

Large groups never yield all pairs of their members:

* Copies, texts of one set, are one class from the start.
* Groups of more than HOT classes (common passages, families of near copies) matter only to classes that may agree with
  another in such blocks alone. A set agrees with any partner in at least s of its blocks; unless as many of them are in
  large groups or empty, each of its links meets in a smaller group as well. So all but these doubtful classes leave the large groups, and no link is lost.
* What stays is a family with a base, the member in most large groups. Each member is compared with the base only, which
  gives its deviation, the symmetric difference. As |X ^ Y| = |dX| + |dY| - 2 |dX & dY|, two members link only if their
  deviations share enough elements: 18 |dX & dY| >= S(X) + S(Y), where S(X) = 9 |dX| - |X|. Where that asks for none, both
  link with the base. So elements that one member alone has rule out partners, members without a possible partner leave,
  and the others meet again under the first elements of their deviations (a prefix filter, rare elements first). Groups of
  at most SMALL are compared by sketches, larger ones get a base of their own; each base leaves its group, so this ends.
* Members that earlier links have joined already are not compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhire.llm.common import drop_kept, give_back, keep, ship, small_side

WORDS = 5
HOT = 8
SMALL = 64
#: Shingles of deviations that a task unfolds.
ELEMENTS = 16_384
SEEDS = 4
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Keys have 48 bits: sets that share one by chance are told apart later, and the shuffle of keys, the largest, has less to write.
EVEN = U(2**48 - 2)
NEVER = 1 << 60
SALTS = np.arange(SEEDS, dtype=U) * BASE


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The ascending 64-bit hashes of a text's distinct shingles (of its whole word sequence, if shorter); none without words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six white-space characters
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(xxh3_64_intdigest, words), U, len(words))
    n = min(WORDS, len(w))
    h = w[: len(w) - n + 1] + U(n)
    for k in range(1, n):
        h = h * BASE + w[k : len(w) - n + 1 + k]
    return np.unique(mixed(h))


def bands(longest: int = 1 << 40) -> np.ndarray:
    """The least size of each band; a band's sizes differ by a factor of about 1.4."""
    out = [1]
    while out[-1] <= longest:
        out.append(int(out[-1] * 1.4) + 1)
    return np.asarray(out, np.int64)


BANDS = bands()


def differing(size: int) -> int:
    """The largest symmetric difference of linked sets of at most this size."""
    return 2 * size // 9


def blocks(band: int) -> tuple[int, int]:
    """(m, s): a band's number of blocks and how many of those that both give linked sets agree in at least."""
    d = differing(int(BANDS[band + 1]) - 1)
    s = max(3, -(-d // 5))
    return d + s, s


def needed(n: int, band: int) -> int:
    """How many of a band's blocks, the first ones, a set of this size gives: s more than it may differ in from a partner in the band."""
    return (n + min(n * 5 // 4, int(BANDS[band + 1]) - 1)) // 9 + blocks(band)[1]


def own_bands(n: int) -> list[int]:
    """The band of a size, and the next if a larger partner may be in it."""
    k = int(np.searchsorted(BANDS, n, "right")) - 1
    return [k, k + 1] if n * 5 // 4 >= BANDS[k + 1] else [k]


def signatures(h: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The keys under which a set meets others, and for bands of even and of odd number how many blocks in large groups make it doubtful.

    The last bit of a key tells whether its band's number is odd. A set with s or more empty blocks can't count on a match
    in a full one; it is dealt again by another hash, as then any partner it has only empty blocks in common with is. After
    the last deal the empty blocks are keys as well.
    """
    keys, spare, n = [], [NEVER, NEVER], len(h)
    for band in own_bands(n):
        (m, s), own = blocks(band), needed(n, band)
        odd = U(band & 1)
        for seed in range(SEEDS):
            x = h if not seed else np.sort(mixed(h + SALTS[seed]))
            at = np.searchsorted(((x >> U(32)) * U(m)) >> U(32), np.arange(own + 1, dtype=U))
            full = np.flatnonzero(np.diff(at))
            place = mixed(np.arange(own, dtype=U) + U((band * SEEDS + seed) << 40))
            keys.append(mixed(np.bitwise_xor.reduceat(x[: at[-1]], at[full]) + place[full]) & EVEN | odd)
            empty = own - len(full)
            spare[band & 1] = min(spare[band & 1], max(0, s - empty))
            if empty < s:
                break
            if seed == SEEDS - 1:
                keys.append(place[np.setdiff1d(np.arange(own), full)] & EVEN | odd)
    return np.concatenate(keys), spare


def sketch(h: np.ndarray) -> bytes:
    """Parities of the set's hashes, two to four bits for each."""
    bits = 1 << max(6, (2 * len(h) - 1).bit_length())
    ones = np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(ones).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches; the longer one is folded to the other's length, which XORs its bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def print_of(text: Column) -> Column:
    """A hash of a text as it stands; null's is that of the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, print, n, class, spare, sketch) of every text; class is a hash of the whole set, spare signatures' second value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            n, a, b, sk = [], [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py())
                n.append(len(h))
                a.append(class_of(h))
                b.append(signatures(h)[1] if len(h) else [NEVER, NEVER])
                sk.append(sketch(h))
            columns = [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.int64())), pa.array(sk, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "print", "n", "class", "spare", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", print_of(F.col("text")).alias("print"), "text").mapInArrow(
        run, f"doc_id {kind}, print long, n long, class long, spare array<long>, sketch binary"
    )


def class_of(h: np.ndarray) -> int:
    return int(mixed(np.add.reduce(mixed(h + BASE), dtype=U, keepdims=True) + U(len(h))).view(np.int64)[0])


def keyed(docs: DataFrame) -> DataFrame:
    """(class, key) of every text with words; copies of a set that one task reads give their keys once.

    In this order a key's high bytes, which are zero, and the next row's header and class, often the same, compress as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                keys, classes, n = [], [], []
                for t in batch.column(0).slice(lo, 2048):
                    h = shingles(t.as_py())
                    c = class_of(h)
                    if not len(h) or c in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
                    keys.append(np.unique(signatures(h)[0]))
                    classes.append(c)
                    n.append(len(keys[-1]))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(classes, np.int64), n)), signed(np.concatenate(keys))], ["class", "key"])

    return docs.select("text").mapInArrow(run, "class long, key long")


def met(rows: DataFrame) -> DataFrame:
    """Groups of classes under one key, from rows (class, key) sorted by key, then class: (hot, a, b).

    A pair of classes a < b of a group of at most HOT, or (hot) the class b of the larger group a. Pairs of groups whose
    members a task has seen already are left out; rows of hot groups pass through one by one: no group is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        key, cls = np.empty(0, np.int64), np.empty(0, np.int64)  # of the last key so far, if its group isn't hot
        hot_key, last = None, 0

        def out(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], ["hot", "a", "b"])

        def groups(key: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups of which none is hot, or one hot group."""
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            some = np.repeat((size > 1), size)
            key, cls, size = key[some], cls[some], size[size > 1]
            if not len(key):
                return
            start = np.cumsum(size) - size
            if size[0] > HOT:
                yield out(True, key, cls)
                return
            print_ = np.add.reduceat(mixed(cls.view(U)), start)
            _, first = np.unique(print_, return_index=True)
            new = np.zeros(len(start), bool)
            new[[i for i in first.tolist() if int(print_[i]) not in given]] = True
            if len(given) > 200_000:
                given.clear()
            given.update(print_[new].tolist())
            end = np.repeat(start + size, size)  # of each row's group
            row = np.flatnonzero(np.repeat(new, size))
            for step in range(1, HOT):
                row = row[row + step < end[row]]
                yield out(False, cls[row], cls[row + step])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, c = np.asarray(batch.column("key")), np.asarray(batch.column("class"))
            if hot_key is not None:
                same = int(np.searchsorted(k != hot_key, True)) if k[0] == hot_key else 0
                more = c[:same][np.diff(c[:same], prepend=last) != 0]
                if len(more):
                    last = int(more[-1])
                    yield out(True, np.full(len(more), hot_key), more)
                k, c = k[same:], c[same:]
                if not len(k):
                    continue
                hot_key = None
            key, cls = np.concatenate([key, k]), np.concatenate([cls, c])
            once = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
            key, cls = key[once], cls[once]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            for at, n in zip(start[:-1][size[:-1] > HOT].tolist(), size[:-1][size[:-1] > HOT].tolist(), strict=True):
                yield from groups(key[at : at + n], cls[at : at + n])
            cold = np.repeat(size <= HOT, size)
            cold[start[-1] :] = False
            if cold.any():
                yield from groups(key[cold], cls[cold])
            key, cls = key[start[-1] :], cls[start[-1] :]
            if len(key) > HOT:
                hot_key, last = int(key[0]), int(cls[-1])
                yield from groups(key, cls)
                key, cls = key[:0], cls[:0]
        if len(key):
            yield from groups(key, cls)

    return rows.mapInArrow(run, "hot boolean, a long, b long")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches are as those of linked sets may be."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    like = 100 * F.least("n_a", "n_b") >= 80 * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(like).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, t = (batch.column(k).to_pylist() for k in (2, 3, 4))
            ok = [9 * hamming(x, y) <= m for m, x, y in zip(n, s, t, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one before it is handed on stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    give_back()


class Sets:
    """The sets of the classes seen last."""

    def __init__(self, most: int = 64):
        self.known: dict[int, np.ndarray] = {}
        self.most = most

    def of(self, cls: int, text: pa.StringScalar) -> np.ndarray:
        if cls not in self.known:
            if len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[cls] = shingles(text.as_py())
        return self.known[cls]


def linked(n: int, m: int, apart: int) -> bool:
    """Whether sets of sizes n and m with so large a symmetric difference have a Jaccard similarity of 0.8 or more."""
    both = (n + m - apart) // 2
    return both > 0 and 100 * both >= 80 * (both + apart)


def with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the texts x of class a and y of class b."""
    x, y = texts.select(F.col("class").alias(a), F.col("text").alias("x")), texts.select(F.col("class").alias(b), F.col("text").alias("y"))
    return pairs.join(x, a).join(y, b)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones among pairs (a, b), by the whole sets of their texts (class, text), one of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for c, d, x, y in zip(a, b, batch.column(2), batch.column(3), strict=True):
                p, q = sets.of(c, x), sets.of(d, y)
                ok.append(linked(len(p), len(q), len(p) + len(q) - 2 * len(np.intersect1d(p, q, assume_unique=True))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return with_texts(pairs, texts, "a", "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def deviations(families: DataFrame, texts: DataFrame) -> DataFrame:
    """Members (family, base, m) compared with their base: (.., n, new, lost, linked).

    new are the shingles of m that the base lacks, lost the base's that m lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, members = Sets(), Sets()
        for batch in sliced(batches):
            n, new, lost, ok = [], [], [], []
            for c, d, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                p, q = bases.of(c, x), members.of(d, y)
                more, less = (np.setdiff1d(u, v, assume_unique=True) for u, v in ((q, p), (p, q)))
                n.append(len(q))
                new.append(more.view(np.int64))
                lost.append(less.view(np.int64))
                ok.append(linked(len(p), len(q), len(more) + len(less)))
            longs = pa.list_(pa.int64())
            columns = [pa.array(n, pa.int64()), pa.array(new, longs), pa.array(lost, longs), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["family", "base", "m", "n", "new", "lost", "linked"])

    rows = with_texts(families, texts, "base", "m").select("family", "base", "m", "x", "y")
    return rows.mapInArrow(run, "family long, base long, m long, n long, new array<long>, lost array<long>, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(class, comp): the smallest class that each linked class reaches. Labels go to neighbours and jump to their labels' labels."""
    both = keep(links.union(links.select("b", "a")).toDF("v", "u").distinct())
    labels = keep(both.groupBy("v").agg(F.least("v", F.min("u")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("l").alias("lu")), "u").groupBy("v").agg(F.min("lu").alias("lu"))
        step = labels.join(near, "v").select("v", "l", F.least("l", "lu").alias("l1"))
        jump = step.select(F.col("v").alias("l1"), F.col("l1").alias("l2"))
        after = keep(step.join(jump, "l1").select("v", F.col("l").alias("was"), F.least("l1", "l2").alias("l")))
        moved = after.filter("l <> was").limit(1).count()
        drop_kept(labels)
        labels = after.select("v", "l")
        if not moved:
            drop_kept(both)
            return labels.select(F.col("v").alias("class"), F.col("l").alias("comp"))


def based(groups: DataFrame, family: str) -> DataFrame:
    """(family, base, m) from large groups (key, m, n, often): a group's base is its member in most groups, of those the smallest.

    family: "base" joins the groups of one base, "key" keeps each apart.
    """
    base = groups.groupBy("key").agg(F.max(F.struct("often", -F.col("n"), "m")).alias("best")).select("key", F.col("best.m").alias("base"))
    rows = groups.select("key", "m").join(base, "key").filter("m <> base")
    return rows.select(F.col(family).alias("family"), "base", "m").distinct()


def elements(rows: DataFrame, column: str) -> DataFrame:
    """(family, m, e) of the shingles in a column of deviations, about as many in each task, however few and large the members."""
    n = rows.agg(F.sum(F.size(column))).first()[0] or 0
    parts = min(n // ELEMENTS + 1, max(2048, n >> 22))  # larger parts where there would be too many
    return rows.select("family", "m", column).repartition(parts).select("family", "m", F.explode(column).alias("e"))


def measured(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Members with component, inner (that of the base), s and u.

    s: 9 |d| - n. A partner's s is at most u, as it shares none of the new shingles that no other member has.
    """
    of = lambda c: comp.select(F.col("class").alias(c), F.col("comp").alias(f"c_{c}"))
    single = elements(rows, "new").groupBy("family", "e").agg(F.count("*").alias("k"), F.min("m").alias("m"))
    own = single.filter("k = 1").groupBy("family", "m").agg(F.count("*").alias("own"))
    found = rows.join(of("base"), "base", "left").join(of("m"), "m", "left").join(own, ["family", "m"], "left")
    found = found.withColumn("comp", F.coalesce("c_m", "m")).withColumn("inner", F.col("comp") == F.coalesce("c_base", "base"))
    size = F.size("new") + F.size("lost")
    found = found.withColumn("s", 9 * size - F.col("n")).withColumn("u", 18 * (size - F.coalesce("own", F.lit(0))) - F.col("s"))
    return found.drop("c_m", "c_base", "base", "linked", "own")


def possible(rows: DataFrame) -> DataFrame:
    """The measured members that may link with one outside their component; least is the smallest s of such a partner."""
    outer = ~F.col("inner")
    bounds = rows.groupBy("family").agg(
        F.min("s").alias("least_s"), F.max("u").alias("most_u"), F.min(F.when(outer, F.col("s"))).alias("outer_s"), F.max(F.when(outer, F.col("u"))).alias("outer_u"),
    )
    least = F.when(F.col("inner"), F.col("outer_s")).otherwise(F.col("least_s"))
    most = F.when(F.col("inner"), F.col("outer_u")).otherwise(F.col("most_u"))
    # no outer member: the bounds are null, and no one stays
    return rows.join(bounds, "family").filter((least <= F.col("u")) & (F.col("s") <= most)).withColumn("least", least).drop(*bounds.columns[1:])


def prefixes(rows: DataFrame) -> DataFrame:
    """(key, m, n, s, u, comp): the first shingles of each possible member's deviation, of which a partner must have one first, too.

    Rare ones come first, by how many members have them in their deviations.
    """
    new = elements(rows, "new")
    often = new.groupBy("family", "e").agg(F.count("*").alias("k")).filter("k > 1")
    mine = new.join(often, ["family", "e"]).groupBy("family", "m").agg(F.collect_list("k").alias("k"), F.collect_list("e").alias("e"))  # shingles of one text
    gone = elements(rows, "lost").groupBy("family", "e").agg(F.count("*").alias("k"))
    base = gone.groupBy("family").agg(F.collect_list("k").alias("base_k"), F.collect_list("e").alias("base_e"))  # shingles of the base

    def lists(column: pa.Array) -> list[np.ndarray]:
        values, offsets = np.asarray(column.values), np.asarray(column.offsets)  # both of the whole batch, offsets of the slice
        return [values[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, keys = [], []
            fixed = (c.to_pylist() for c in batch.columns[:8])
            for family, m, n, s, u, comp, least, new, lost, k, e, base_k, base_e in zip(*fixed, *map(lists, batch.columns[8:]), strict=True):
                shared = max(1, -(-(s + least) // 18), -(-(s - 5 * n // 4) // 9))  # with any partner, at least
                first = max(0, len(e) + len(lost) - shared + 1)  # new ones that no other has come before them
                mine = np.isin(base_e, lost, assume_unique=True)
                k, e = np.concatenate([k, base_k[mine]]), np.concatenate([e, base_e[mine]])
                chosen = e[np.lexsort((e, k))[:first]]
                keys.append(mixed(chosen.view(U) ^ mixed(np.asarray([family], np.int64).view(U))).view(np.int64))
                out.append((m, n, s, u, comp))
            sizes = [len(x) for x in keys]
            columns = [np.repeat(np.asarray(x, np.int64), sizes) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
            columns = [np.concatenate([np.empty(0, np.int64), *keys]), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], list(FIELDS))

    none = F.array().cast("array<long>")
    wanted = rows.join(mine, ["family", "m"], "left").join(base, "family", "left")
    wanted = wanted.select("family", "m", "n", "s", "u", "comp", "least", F.size("new").alias("new"), *(F.coalesce(c, none).alias(c) for c in ("lost", "k", "e", "base_k", "base_e")))
    return wanted.mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS))


FIELDS = ("key", "m", "n", "s", "u", "comp")


def across(groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of members of small groups that lie in different components and may share enough."""
    x, y = groups.alias("x"), groups.alias("y")
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.m") < F.col("y.m")) & (F.col("x.comp") != F.col("y.comp"))
    enough = (F.col("x.s") <= F.col("y.u")) & (F.col("y.s") <= F.col("x.u"))
    like = 100 * F.least("x.n", "y.n") >= 80 * F.greatest("x.n", "y.n")
    return x.join(y, meets & enough & like).select(F.col("x.m").alias("a"), F.col("y.m").alias("b")).distinct()


def family_pairs(rows: DataFrame, comp: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """From the families' deviations: pairs (a, b) still to be compared, and the links with later bases.

    Large groups get bases of their own as long as that leaves fewer rows each time; else they are compared as small ones are.
    """
    pairs, links, most = [], [], None
    while True:
        found = keep(prefixes(keep(possible(keep(measured(rows, comp))))))
        size = found.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        sized = keep(found.join(size.select("key", "size"), "key"))
        large = sized.filter(F.col("size") > SMALL)
        left = large.count()
        if not left or (most and left >= most):
            return [*pairs, keep(across(sized))], links
        pairs.append(keep(across(sized.filter(F.col("size") <= SMALL))))
        most = left
        often = large.groupBy("m").agg(F.count("*").alias("often"))
        rows = keep(deviations(based(large.join(often, "m").select("key", "m", "n", "often"), "key"), texts))
        links.append(rows.filter("linked").select("base", "m").toDF("a", "b"))


def meetings(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that meet in small groups, by sizes and sketches possible; rows (key, m, n, often) of the large groups' doubtful classes."""
    groups = keep(met(keyed(docs).repartition("key").sortWithinPartitions("key", "class")))
    large = groups.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("m")).withColumn("odd", F.col("key").bitwiseAND(F.lit(1)).cast("int"))
    spare = classes.select(F.col("class").alias("m"), "spare", "n")
    doubtful = large.groupBy("m", "odd").agg(F.count("*").alias("hot")).join(spare, "m").filter(F.col("hot") >= F.element_at("spare", F.col("odd") + 1))
    stays = large.join(doubtful.select("m", "odd", "n", "hot"), ["m", "odd"]).select("key", "m", "n", F.col("hot").alias("often"))
    stays = keep(stays.join(stays.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"))
    few = stays.filter(F.col("size") <= HOT).select("key", "m")
    more = few.withColumnRenamed("m", "a").join(few.withColumnRenamed("m", "b"), "key").filter("a < b").select("a", "b")
    pairs = keep(near(groups.filter("NOT hot").select("a", "b").union(more).distinct(), classes))
    drop_kept(groups)
    return pairs, stays.filter(F.col("size") > HOT).select("key", "m", "n", "often")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text), one of each wanted class (class, rep, print)."""
    found = keep(docs.join(small_side(wanted), F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("print") == print_of(F.col("text")))).select("class", "text"))
    if found.groupBy("class").count().filter("count > 1").isEmpty():
        return found
    one = keep(found.groupBy("class").agg(F.min("text").alias("text")))  # repeated rows
    drop_kept(found)
    return one


def linked_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, print, n, class) of docs (doc_id, text), and (class, comp) of the classes that have links."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = keep(sets(docs))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("at")
    classes = table.filter("n > 0").groupBy("class").agg(rep, F.first("n").alias("n"), F.first("spare").alias("spare"), F.first("sketch").alias("sketch"))
    classes = keep(classes.select("class", F.col("at.doc_id").alias("rep"), F.col("at.print").alias("print"), "n", "spare", "sketch"))
    pairs, large = meetings(docs, classes)
    seen = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(large.select("m")).distinct()
    texts = texts_of(docs, keep(seen.join(classes.select("class", "rep", "print"), "class")))
    rows = keep(deviations(based(large, "base"), texts))
    links = keep(verified(pairs, texts).union(rows.filter("linked").select("base", "m")))
    comp = components(links)
    later, more = family_pairs(rows, comp, texts)
    for part in later:
        more.append(verified(near(part, classes), texts))
    for part in more:
        links = links.union(part)
    return table.select("doc_id", "print", "n", "class"), components(links)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text), a row for each row.

    component_id is the smallest doc_id that links reach, the row's own included; null only where no row of the component
    has a doc_id. Null, empty and blank texts have no shingles and no links. Repeated doc_ids may stand for different texts:
    each row links by its own text. doc_id may be of any type that has an order; other columns are ignored, whatever their
    names. An empty table gives no rows. Shingle hashes of 64 bits stand for shingles.
    """
    table, comp = linked_components(docs)
    full = table.filter("n > 0")
    by_class = full.groupBy("class").agg(F.min("doc_id").alias("rep")).join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = by_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = by_class.join(least, "comp").select("class", "component_id")
    found = full.join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(table.filter("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (rows without a doc_id only where all are), then text hash.

    Rows without words are no one's duplicates and stay. Of repeated rows one stays, of those that differ in other columns
    the smallest. Columns may have any names.
    """
    table, comp = linked_components(docs)
    own_id, own_print, own_row = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "print", "row"))  # no column of docs has such a name
    full = table.filter("n > 0").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = full.groupBy("comp").agg(F.min(order).alias("at"))
    own = full.groupBy("comp", "doc_id", "print").agg(F.count("*").alias("k")).join(first, "comp")
    stays = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("print") == F.col("at.print"))
    own = keep(own.select(F.col("doc_id").alias(own_id), F.col("print").alias(own_print), "k", stays.alias("stays")))
    same = F.col(own_id).eqNullSafe(docs["doc_id"]) & (F.col(own_print) == print_of(docs["text"]))
    left = docs.join(small_side(own.filter("NOT stays")), same, "left_anti")
    again = own.filter("stays AND k > 1")
    if again.isEmpty():
        return left
    several = docs.join(small_side(again), same, "left_semi")
    one = several.groupBy(F.col("doc_id").alias(own_id), print_of(F.col("text")).alias(own_print)).agg(F.min(F.struct(*docs.columns)).alias(own_row))
    return left.join(small_side(again), same, "left_anti").unionByName(one.select(f"{own_row}.*"))
