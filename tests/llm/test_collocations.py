"""Collocations against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyhire.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=30, longest=4, share=80):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in good.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], c)
        found = []
        for p, a in good.items():
            if 100 * inside[p] < share * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total, -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(df, **options):
    rows = collocations.collocations(df, **options).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    common = [f"w{k}" for k in range(30)] + ["É", "Wort", "x y", "and\x1cso", "[x]"]
    idioms = [[f"i{k}{j}" for j in range(rng.randrange(2, 7))] for k in range(30)] + [["w1", "kin", "w2"], ["of", "w3", "kin"], ["Hot", "potato"]]

    def text():
        words = []
        for _ in range(rng.randrange(80)):
            words += rng.choice(idioms) if rng.random() < 0.25 else [rng.choice(common)]
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ", ", "\n", "\t", "!?", " \x0b "])
        return rng.choice([" ", "  ", " \t"]).join(words)

    rows = [(rng.choice(["en", "en", "en", "de", None]), text()) for _ in range(1200)]
    rows += [("en", "same line again and again. " * 40)] * 30 + [("xx", "too few words"), ("yy", None), ("und", text()), ("en", ""), (None, "kin kin kin kin kin " * 40)]
    return rows, spark.createDataFrame([(k, t, lang, "p", 1) for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)


def test_equal_brute_force(corpus):
    rows, df = corpus
    want = brute(rows)
    assert found(df) == want and len(want) > 150


@pytest.mark.parametrize(("top", "reach"), [(5, 1), (40, 10), (100, 100)])
def test_frontier_settles(corpus, top, reach):
    """Low thresholds are reached in several rounds; what a threshold leaves out is never missed."""
    rows, df = corpus
    assert found(df, top=top, reach=reach) == brute(rows, top=top)


def test_other_lengths(corpus):
    rows, df = corpus
    assert found(df, longest=2) == brute(rows, longest=2)
    assert found(df, longest=5, top=60, least=20) == brute(rows, longest=5, top=60, least=20)


@pytest.mark.parametrize(("words", "vocabulary", "size"), [(1, 1, 1), (50, 10, 100), (10**6, 10**6, 10**6)])
def test_chunks_count_alike(corpus, monkeypatch, words, vocabulary, size):
    """Whatever the chunks, their counts add up to those of the whole; full filters let all phrases pass."""
    rows = [(lang or "und", text) for lang, text in corpus[0][:60]]
    for name, value in (("CHUNK_WORDS", words), ("CHUNK_VOCABULARY", vocabulary), ("SLICE_BYTES", size)):
        monkeypatch.setattr(collocations, name, value)
    full = np.full(collocations.BLOOM_BITS // 64, 2**64 - 1, np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 7], strict=True)], ["lang", "text"]) for k in range(0, 60, 7)]
    got = Counter()
    for names, texts in collocations.chunks(iter(batches)):
        hashes = collocations.word_hashes(names)
        for lang, t in texts.items():
            for pick in (collocations.all_words(), collocations.pairs_of(full), collocations.grown(full, full, 4)):
                for n, places, counts in pick(t, collocations.seeded(lang, hashes)):
                    for at, count in zip(places.tolist(), counts.tolist(), strict=True):
                        got[lang, b" ".join(names[x] for x in t[at : at + n]).decode()] += count
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            found = re.findall("[^\x20\x09]+", piece)
            want[lang, ""] += len(found)
            want.update((lang, " ".join(found[i : i + n])) for n in range(1, 5) for i in range(len(found) - n + 1))
    assert got == want


def test_filters_lose_nothing(spark):
    phrases = [("en", f"a{k} b{k % 7}") for k in range(3000)] + [("de", "a1"), ("en", "x y z")]
    bloom = collocations.bloom_of(spark.createDataFrame(phrases, "lang string, phrase string"))
    each = lambda lang, phrase: collocations.seeded(lang, collocations.word_hashes(phrase.encode().split(b" ")))

    def held(lang, phrase):
        h = each(lang, phrase)
        for k in range(1, len(h)):
            h = np.concatenate([collocations.mixed(h[:1], h[k : k + 1]), h[1:]])
        return collocations.holds(bloom, h[:1])[0]

    assert all(held(*p) for p in phrases)
    assert sum(held("fr", phrase) for _, phrase in phrases) < 5


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op11_collocations']})").fetchall()
    got = [tuple(r) for r in queries.op11_collocations(spark, data).select(names).collect()]
    assert sorted(got) == sorted(want) and want
