"""Phrase collocation mining by best-first branch and bound.

A phrase's score is at most 2000000 * a / (l + r) for its occurrences a and those of the two parts of any cut. A phrase that begins
with the pair P = (w1, w2) occurs at most f(P) times, and what follows w1 at least as often as the phrase itself; so its
score is at most 2000000 * f(P) / (f(w1) + f(P)). This bound needs the prefix's counts alone.

1. Words are counted, then pairs of frequent words: each pair is a prefix with a score and a bound.
2. A frontier threshold is set for each language, at the score of its `reach` best pairs. One pass counts the longer phrases
   that hold a pair whose bound reaches the threshold, and of whose pairs all are frequent. Every phrase that scores so much
   begins with such a pair, and every longer phrase that could drop it holds that pair, too: so all that score so much are
   known, and which of them survive.
3. A language whose `top` survivors (or all its pairs) are there is settled, ties included. The others go on with a lower
   threshold.

Passes over the texts count in chunks: numpy counts a chunk's phrases by numbers of words, Spark adds the chunks up. What a
pass may count is told to the tasks by Bloom filters of a fixed size. These never lose a phrase; one that passes by mistake is
counted like the others, by the whole phrase, so that all counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.llm.common import give_back, keep, ship

#: Bits of a Bloom filter (4 MB) and bits set for a phrase.
BLOOM_BITS, BLOOM_HASHES = 1 << 25, 4
#: A chunk ends at so many words, or so many different ones; texts are cut into words so many bytes at a time.
CHUNK_WORDS, CHUNK_VOCABULARY, SLICE_BYTES = 4_000_000, 400_000, 2_000_000
#: Rows of a batch that a task hands on.
ROWS = 50_000
#: Parts of a language that are ranked apart.
RANK_PARTS = 64
SCALE = 2_000_000
END = b"\xff"  # no byte of UTF-8: parts the pieces
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")

#: For a language and a chunk's words: (length, places, counts) of the phrases to count. t has the words' numbers, 0 between pieces.
Pick = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


class Vocabulary(dict):
    """Numbers words as they come; 0 is END."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """(words by number, the numbers in each language's texts) from batches of (lang, text). Texts are whole; pieces end with 0."""
    vocabulary, found, held, total = Vocabulary(), {}, {}, 0

    def numbered(lang: str) -> int:
        words = END.join([*held.pop(lang)[1], b""]).translate(LETTERS).replace(END, b" \xff ").split()
        found.setdefault(lang, []).append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        return len(words)

    def full() -> tuple[list[bytes], dict[str, np.ndarray]]:
        return list(vocabulary), {lang: np.concatenate([*parts, np.zeros(8, np.int32)]) for lang, parts in found.items()}

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            size, texts = held.get(lang, (0, []))
            texts.append(text.as_py() or b"")
            held[lang] = size + len(texts[-1]), texts
            if held[lang][0] >= SLICE_BYTES:
                total += numbered(lang)
            if total >= CHUNK_WORDS or len(vocabulary) >= CHUNK_VOCABULARY:
                for each in list(held):
                    numbered(each)
                yield full()
                vocabulary, found, total = Vocabulary(), {}, 0
    for each in list(held):
        numbered(each)
    if found:
        yield full()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes, in order."""
    with np.errstate(over="ignore"):
        x = (np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b, np.uint64) + np.uint64(0x7F4A7C159E3779B9))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeded(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Hashes of words of a language; those of phrases are mixed from them, from left to right."""
    return mixed(np.full(len(hashes), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64), hashes)


def bits_of(hashes: np.ndarray) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((hashes + np.uint64(k) * step) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def holds(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether phrases are in a filter: true for all that are, for few others."""
    out = np.ones(len(hashes), bool)
    for bit in bits_of(hashes):
        out &= (bloom[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def bloom_of(phrases: DataFrame) -> np.ndarray:
    """A Bloom filter of (lang, phrase); the driver gets at most BLOOM_BITS / 64 numbers, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                each = seeded(lang, word_hashes(phrase.split(b" ")))
                h = each[:1]
                for k in range(1, len(each)):
                    h = mixed(h, each[k : k + 1])
                hashes.append(h)
            if not hashes:
                continue
            bits = np.unique(np.concatenate(bits_of(np.concatenate(hashes))))
            at = np.flatnonzero(np.diff(bits >> 6, prepend=-1))
            masks = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), at)
            yield pa.RecordBatch.from_arrays([pa.array((bits >> 6)[at].astype(np.int32)), pa.array(masks.view(np.int64))], ["place", "mask"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "place int, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[np.asarray(rows["place"])] = np.asarray(rows["mask"]).view(np.uint64)
    return out


def different(t: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, number) of each of the different phrases of n words that begin at the places."""
    code, shift = t[at].astype(np.int64), int(t.max(initial=0)).bit_length()
    for k in range(1, n):
        if int(code.max(initial=0)).bit_length() + shift > 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code << shift | t[at + k]
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return at[first], count


def counted(docs: DataFrame, pick: Callable[[], Pick]) -> DataFrame:
    """(lang, phrase, n): how often the picked phrases occur in docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = pick()
        for words, texts in chunks(batches):
            hashes = word_hashes(words)
            for lang, t in texts.items():
                for n, places, counts in chosen(t, seeded(lang, hashes)):
                    for lo in range(0, len(places), ROWS):
                        at = places[lo : lo + ROWS]
                        columns = [[words[x] for x in t[at + k].tolist()] for k in range(n)]
                        phrases = pa.array(list(map(b" ".join, zip(*columns, strict=True))) if n else [b""] * len(at), pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrases, pa.array(counts[lo : lo + ROWS], pa.int64())], ["lang", "phrase", "n"])
        give_back()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def all_words() -> Pick:
    """Every word, and under the phrase '' the number of all words."""

    def pick(t: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts, places = np.bincount(t), np.zeros(len(hashes), np.int64)
        places[t] = np.arange(len(t))
        found = np.flatnonzero(counts[1:]) + 1
        yield 1, places[found], counts[found]
        yield 0, np.zeros(1, np.int64), counts[1:].sum(keepdims=True)

    return pick


def pairs_of(words: np.ndarray) -> Pick:
    """Pairs of frequent words."""

    def pick(t: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        frequent = holds(words, hashes)
        frequent[0] = False
        at = frequent[t]
        yield 2, *different(t, np.flatnonzero(at[:-1] & at[1:]), 2)

    return pick


def grown(pairs: np.ndarray, alive: np.ndarray, longest: int) -> Pick:
    """Phrases of 3 to `longest` words of whose pairs all are frequent and one is alive."""

    def pick(t: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
        h = mixed(hashes[t[at]], hashes[t[at + 1]])
        good, live = np.zeros(len(t), bool), np.zeros(len(t), bool)
        good[at] = holds(pairs, h)
        at, h = at[good[at]], h[good[at]]
        live[at] = holds(alive, h)
        whole, some = good, live
        for n in range(3, longest + 1):
            whole = whole[:-1] & good[n - 2 :]
            some = some[:-1] | live[n - 2 :]
            yield n, *different(t, np.flatnonzero(whole & some), n)

    return pick


def given(phrases: np.ndarray, shortest: int, longest: int) -> Pick:
    """The phrases in a filter."""

    def pick(t: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = np.flatnonzero(t)
        h = hashes[t[at]]
        for n in range(2, longest + 1):
            on = t[at + n - 1] > 0
            at, h = at[on], mixed(h[on], hashes[t[at[on] + n - 1]])
            if n >= shortest:
                yield n, *different(t, at[holds(phrases, h)], n)

    return pick


def times(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts), exactly; the product may pass 64 bits."""
    product, parts = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)"), parts.cast("decimal(20,0)")
    return ((product - product % parts) / parts).cast("long")


def kth_score(rows: DataFrame, k: int) -> DataFrame:
    """(lang, threshold): the kth largest score of each language that has so many rows. A histogram: scores are at most SCALE."""
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("lang", "score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down))
    return bins.filter(F.col("upto") >= k).groupBy("lang").agg(F.max("score").alias("threshold"))


def cuts(rows: DataFrame) -> DataFrame:
    """Each row (lang, phrase, a) with every cut: k words on the left side."""
    words = F.split("phrase", " ")
    each = rows.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    return each.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))


def with_parts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Every cut with the counts of its parts, null where counts (lang, phrase, n) lacks one."""
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    return cuts(rows).join(side("left", "l"), ["lang", "left"], "left").join(side("right", "r"), ["lang", "right"], "left")


def lowest_cut(parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the cut of the lowest score, the shortest left side among equals."""
    scored = parts.withColumn("score", times(F.col("a"), F.col("l") + F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def inner_phrases(longer: DataFrame) -> DataFrame:
    """(lang, phrase, by): of every phrase of two words and more inside a longer one, how often the most frequent of these occurs."""
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    starts = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), starts))
    return longer.select("lang", F.explode(inside).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("by"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, kept_share: int = 80, reach: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank from 1, phrase, a, l, r, n, score): each language's first `top` collocations of 2 to `longest` words.

    Texts, A-Z lower-cased, are cut at . , ; : ! ? and line breaks (0A to 0D) into pieces, these at blanks and tabs into
    words. a: occurrences of the phrase in pieces, at least `least`; l, r: of its parts at the cut that scores lowest; n: of all
    words. A phrase inside a longer one of which there are kept_share hundredths as many, or more, is dropped. Order: score, a
    (both descending), phrase by its bytes.

    Null texts are empty; a null language is `und`; repeated rows count each time; other columns are ignored, whatever their
    names. A language without frequent phrases, like an empty table, gives no rows. reach: pairs by which a language's frontier
    is set at first (2 * top).
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    send = spark.sparkContext.broadcast  # filters only, of BLOOM_BITS each
    words = keep(counted(texts, all_words).filter((F.col("n") >= least) | (F.col("phrase") == "")))
    frequent = words.filter("phrase <> ''")
    filter_of_words = send(bloom_of(frequent))
    pairs = keep(counted(texts, lambda: pairs_of(filter_of_words.value)).filter(F.col("n") >= least))
    scored = lowest_cut(with_parts(pairs.withColumnRenamed("n", "a"), frequent))
    open_pairs = keep(scored.withColumn("bound", times(F.col("a"), F.col("l") + F.col("a"))))  # l: of the first word
    filter_of_pairs = send(bloom_of(pairs))
    reach, done = reach or 2 * top, []
    while True:
        threshold = keep(open_pairs.select("lang").distinct().join(kth_score(open_pairs, reach), "lang", "left").select("lang", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold")))
        live = keep(open_pairs.join(threshold, "lang").filter(F.col("bound") >= F.col("threshold")))
        filter_of_live = send(bloom_of(live))
        longer = keep(counted(texts, lambda f=filter_of_live: grown(filter_of_pairs.value, f.value, longest)).filter(F.col("n") >= least))
        begun = longer.withColumn("prefix", F.substring_index("phrase", " ", 2)).join(live.select("lang", F.col("phrase").alias("prefix"), "threshold"), ["lang", "prefix"])
        counts = frequent.unionByName(pairs).unionByName(longer)
        parts = keep(with_parts(begun.select("lang", "phrase", F.col("n").alias("a")), counts))
        # a right part that no pass has counted occurs at least as often as the phrase
        high = parts.groupBy("lang", "phrase").agg(F.min(times(F.col("a"), F.col("l") + F.coalesce("r", "a"))).alias("high"))
        worth = high.join(threshold, "lang").filter(F.col("high") >= F.col("threshold")).select("lang", "phrase")
        parts = parts.join(worth, ["lang", "phrase"], "left_semi")
        lacking = keep(parts.filter(F.col("r").isNull()).select("lang", F.col("right").alias("phrase")).distinct())
        if not lacking.isEmpty():
            filter_of_lacking = send(bloom_of(lacking))
            more = keep(counted(texts, lambda f=filter_of_lacking: given(f.value, 3, longest - 1)).join(lacking, ["lang", "phrase"], "left_semi"))
            found = more.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r2"))
            parts = parts.join(found, ["lang", "right"], "left").withColumn("r", F.coalesce("r", "r2")).drop("r2")
        candidates = live.select("lang", "phrase", "a", "l", "r", "score").unionByName(lowest_cut(parts)).join(threshold, "lang").filter(F.col("score") >= F.col("threshold"))
        inside = candidates.join(inner_phrases(longer), ["lang", "phrase"], "left")
        alive = keep(inside.filter(F.col("by").isNull() | (100 * F.col("by").cast("decimal(20,0)") < kept_share * F.col("a").cast("decimal(20,0)"))).drop("by"))
        enough = alive.groupBy("lang").agg(F.count("*").alias("survivors"))
        settled = keep(threshold.join(enough, "lang", "left").filter((F.col("threshold") == 0) | (F.col("survivors") >= top)).select("lang"))
        done.append(alive.join(settled, "lang", "left_semi"))
        rest = open_pairs.join(settled, "lang", "left_anti")
        if rest.isEmpty():
            break
        open_pairs, reach = keep(rest), reach * 4
    survivors = done[0]
    for each in done[1:]:
        survivors = survivors.unionByName(each)
    cut = survivors.drop("threshold").join(kth_score(survivors, top), "lang", "left").filter(F.col("score") >= F.coalesce("threshold", F.lit(0)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # ties may be many: each part of a language keeps its first ones, and these few are ranked together
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS).cast("long"))
    few = cut.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("nth") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = words.filter("phrase = ''").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
