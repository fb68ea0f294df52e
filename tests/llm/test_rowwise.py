"""Encoding, repetition, token counts, classifiers: against libraries, brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhire.llm import bpe, common, quality_fm, queries, repetition, token_counts, toxicity_crf

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


def test_bpe_equals_the_library(library):
    rng = random.Random(1)
    mine = bpe.ForcedBoundaryBPE(queries.BYTE_BPE, public_tokenizers.PATTERN)
    alphabet = " \n\t\r'sdltrevm!?.,1²  é日\x1c\x0b\u2028"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 5000, "日本" * 2000, "don't 's !'s \n\n  w", "".join(map(chr, range(0x250)))]
    for ids, text in zip(mine.encode_all(pa.array(texts)), texts, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_round_trip(text):
    mine = bpe.loaded(queries.BYTE_BPE)
    assert mine.decode(mine.encode(text)) == text


def test_bpe_fragments_are_cut_at_every_never_pair(library):
    mine = bpe.loaded(queries.BYTE_BPE)
    texts = ["qzxj" * 400 + "ñ" * 400, "plain words, and zqxj wvkq.\n\nMore of them 12345", "日本語 text"]
    for text in texts:
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        data, cut = mine.fragments(pa.array([text.encode()], pa.binary()))
        ends = [*np.flatnonzero(cut)[1:].tolist(), len(data)]
        pieces = [bytes(data[i:j]) for i, j in zip(np.flatnonzero(cut).tolist(), ends, strict=True)]
        assert b"".join(pieces) == text.encode()
        assert not any(mine.never[a << 8 | b] for p in pieces for a, b in zip(p, p[1:], strict=False))
        # each piece by itself gives the text's ids
        assert [i for p in pieces for i in mine._merge(p)] == mine.encode(text).tolist()
    data, cut = mine.fragments(pa.array([texts[0].encode()], pa.binary()))
    assert cut.sum() > 400


def test_encoding_query(spark, odd_docs, no_docs, library):
    rows = bpe.encoding_digests(odd_docs, queries.BYTE_BPE).collect()
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    assert len(rows) == len(texts)
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in (library.encode(t, add_special_tokens=False).ids for t in texts))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    full = {(r["doc_id"], r["decoded"]) for r in bpe.encode_documents(odd_docs, queries.BYTE_BPE).collect()}
    assert (5, texts[5]) in full and (0, "") in full
    assert bpe.encoding_digests(no_docs, queries.BYTE_BPE).count() == 0


def brute_repetition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup_lines, line_chars, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            line_chars += len(line)
            if line in seen:
                dup_lines, dup_chars = dup_lines + 1, dup_chars + len(line)
            seen.add(line)

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        return sorted({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)})

    inside = [sum(len(words[i]) for i in covered(n)) for n in repetition.NGRAM_LIMITS]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup_lines, len(covered(5)), line_chars, dup_chars, inside


def test_repetition_equals_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice("a b c dé # x<").replace(" ", "q") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += ["a b c d e " * 2, "a b c d", "a b c d e", None]
    for t in texts:
        assert repetition.measure(t) == brute_repetition(t)
    rows = repetition.repetition_coverage(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["doc_id"], r["base_failed"], r["kept"]) for r in rows} >= {(0, True, False), (1, True, False), (8, False, True)}
    assert repetition.repetition_coverage(no_docs).count() == 0


def test_token_counts_equal_unigram_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = token_counts.zipf_vocabulary(queries.PIECES)
    names = list(vocabulary)
    model = Tokenizer(Unigram([("<unk>", min(vocabulary.values()) - 1), *((p, vocabulary[p]) for p in names)], unk_id=0, byte_fallback=False))
    rng = random.Random(9)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(40).collect()
    words = sorted({"▁" + w for r in docs for w in (r["text"] or "").split()} | {"▁" + "".join(rng.choice("abcdeéñßt") for _ in range(rng.randrange(1, 25))) for _ in range(500)})
    counter = token_counts.TrieCounter(vocabulary)
    got = counter.counts(words)
    assert counter.nodes < sum(map(len, words))  # prefixes were shared
    for w in words:
        if all(c in vocabulary for c in w):
            found = model.encode(w).tokens
            score = sum(vocabulary[t] for t in found)
            assert got[w] == len(found) or np.isclose(score, best_score(w, vocabulary))
    assert counter.counts(["▁\U0001f9ff"])["▁\U0001f9ff"] == 1 + 4
    rows = token_counts.token_counts(odd_docs, queries.PIECES).collect()
    assert len(rows) == odd_docs.count() and {(r["n_words"], r["n_tokens"]) for r in rows if r["doc_id"] in (0, 1, 2)} == {(0, 0)}
    one = token_counts.token_counts(odd_docs, queries.PIECES, block=2).collect()
    assert sorted(map(str, one)) == sorted(map(str, rows))
    assert token_counts.token_counts(no_docs, queries.PIECES).count() == 0


def best_score(word, vocabulary):
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            if word[begin:end] in vocabulary:
                best[end] = max(best[end], best[begin] + vocabulary[word[begin:end]])
    return best[-1]


def brute_tokens(word, vocabulary):
    """Tokens of the best segmentation, each prefix on its own; of equally good ones that with the longest last piece."""
    lowest = min(vocabulary.values()) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = []
        for begin in range(end):
            piece = word[begin:end]
            if piece in vocabulary:
                found.append((best[begin][0] + vocabulary[piece], -begin, best[begin][1] + 1))
            elif begin == end - 1:
                found.append((best[begin][0] + lowest, -begin, best[begin][1] + len(piece.encode())))
        score, _, count = max(found)
        best.append((score, count))
    return best[-1][1]


def test_token_counts_of_documents_equal_brute_force(spark):
    vocabulary = token_counts.zipf_vocabulary(queries.PIECES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, queries.PIECES).collect()}
    known = {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        for w in {*words} - {*known}:
            known[w] = brute_tokens(token_counts.START + w, vocabulary)
        assert got[r["doc_id"]] == (len(words), sum(known[w] for w in words))


def test_machine_scores_all_pairs():
    rng = np.random.default_rng(2)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.asarray([3, 7, 20, 41]), rng.normal(size=4)
    z = 0.3 + fm.w[index] @ value + sum(fm.v[index[a]] @ fm.v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert np.isclose(fm.score([(index, value)])[0], 1 / (1 + np.exp(-z)))


def accuracy(spark, query, label, sf="/root/testdata/sf0.01"):
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    hit = lambda y: [r["predicted"] == y for r in rows if r[label] == y]
    return np.mean(hit(0)), np.mean(hit(1))


def test_quality_held_out(spark):
    poor, good = accuracy(spark, queries.op1_quality_factorisation_machine, "quality")
    assert good > 0.97 and poor > 0.85


def test_toxicity_held_out(spark):
    clean, toxic = accuracy(spark, queries.op9_toxicity_crf, "toxic", "/root/testdata/sf0.1")
    assert clean > 0.98 and toxic > 0.9


def test_classifiers_bear_odd_rows(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(14)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for module, kind in ((quality_fm, "quality"), (toxicity_crf, "toxic")):
        model = module.train(odd_docs, labels, kind)
        rows = module.score(odd_docs, model, out="found").collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["found"] <= 1 for r in rows)
        blank = module.train(no_docs, no_labels, kind)
        assert {r["found"] for r in module.score(odd_docs, blank, out="found").collect()} == {0.5}
        assert module.score(no_docs, blank, out="found").count() == 0
        with pytest.raises(ValueError, match="already"):
            module.score(odd_docs, blank)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    sizes, trans = np.asarray([3, 1, 4]), rng.normal(size=(2, 2))
    emit = rng.normal(size=8)
    p, pairs = toxicity_crf.marginals(emit, sizes, trans)
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            one += w * np.asarray(y)
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        want += list(one / total)
        expected += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, expected)


def test_long_chains_go_in_blocks():
    rng = np.random.default_rng(5)
    for sizes in ([300], [64, 65, 128, 129, 1, 700, 63], [5, 1000, 2]):
        emit, trans = rng.normal(size=sum(sizes)) * 3, rng.normal(size=(2, 2))
        m, at, want, expected = np.exp(trans), 0, [], np.zeros((2, 2))
        for n in sizes:
            e = np.stack([np.ones(n), np.exp(emit[at : at + n])], 1)
            f, b = e.copy(), np.ones((n, 2))
            for t in range(1, n):
                f[t] = (f[t - 1] @ m) * e[t]
                f[t] /= f[t].sum()
            for t in range(n - 2, -1, -1):
                b[t] = m @ (b[t + 1] * e[t + 1])
                b[t] /= b[t].sum()
            want += ((f * b)[:, 1] / (f * b).sum(1)).tolist()
            for t in range(n - 1):
                x = f[t][:, None] * m * (b[t + 1] * e[t + 1])[None]
                expected += x / x.sum()
            at += n
        p, pairs = toxicity_crf.marginals(emit, np.asarray(sizes), trans)
        assert np.allclose(p, want) and np.allclose(pairs, expected)


def test_excerpts_come_from_the_whole_text():
    text = "\n".join(" ".join(f"w{k}" for k in range(n, n + 100)) for n in range(0, 20000, 100))
    words = [int(w[1:]) for w in toxicity_crf.excerpt(text, 1000).split()]
    assert 900 < len(words) <= 1000 and max(words) > 15000 and min(words) < 5000
    assert toxicity_crf.excerpt("a b\nc", 3) == "a b\nc"


def test_spans_point_at_words(spark):
    # the word stands in many contexts, as copies of one passage would not show that it is the word that counts
    texts = [f"good words{k} {w} and é more" for k in range(20) for w in ("vile", "nasty")] + [f"good words{k} and é more" for k in range(40)]
    field = toxicity_crf.fit(texts, np.asarray([1.0] * 40 + [0.0] * 40))
    df = spark.createDataFrame([(1, "é you vile thing"), (2, "good words and more")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity_crf.score(df, field, spans="spans").collect()}
    assert rows[1]["score"] > rows[2]["score"] and not rows[2]["spans"]
    assert ["é you vile thing".encode()[s["start"] : s["start"] + s["length"]] for s in rows[1]["spans"]] == [b"vile"]


def test_training_rows_have_one_text_of_each_id(spark):
    rows = [(1, f"text {k:04d}", k) for k in range(600)] + [(k, f"doc {k}", k) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    found = common.training_rows(docs, labels, "quality", 100).collect()
    assert len(found) == len({r["doc_id"] for r in found}) > 10
    assert [(r["text"], r["n_chars"], r["y"]) for r in found if r["doc_id"] == 1] == [("text 0000", 0, 1)]
    assert len(common.training_rows(docs, labels, "quality", 5).collect()) == 5


def test_metadata_may_have_any_names(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} and more", float(k), float(k % 2)) for k in range(40)], "doc_id long, text string, y double, place double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    machine = quality_fm.train(docs, labels, metadata=("y", "place"))
    assert quality_fm.score(docs, machine, metadata=("y", "place")).count() == 40
