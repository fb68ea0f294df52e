"""Toxicity: a linear-chain conditional random field that tags toxic tokens.

The field has two states (0 clean, 1 toxic). A token's features are its word, the word's prefixes and suffixes and its
shape; neighbours act through the transitions. Chains are the lines of a text, whole. Forward-backward marginals give each
token a probability; a text's score is a logistic function of them, its spans are the offsets of the tokens above a
threshold.

Messages pass along all chains side by side, a position at a time. Chains longer than STEP go in blocks: what a block does
to any message that enters it is a 2 x 2 matrix, so a pass over the matrices gives each block its messages, and all blocks
go side by side like chains.

Token labels come from document labels: a token of a toxic sample text is labelled toxic where its word is much more
frequent in toxic texts of the sample than in clean ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhire.llm.common import give_back, ship, training_rows

STEP = 64
BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
SUFFIXES = (3, 4)
N_FEATURES = 2 + len(PREFIXES) + len(SUFFIXES)
CACHE_WORDS = 200_000
MARKS = ".,;:!?#*$%&|<>\"'()[]{}-_~+=/\\"
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def core(word: str) -> str:
    """A word without marks around it, lower-cased."""
    return word.strip(MARKS).lower()


def word_features(word: str) -> list[int]:
    """N_FEATURES feature numbers of a word; 0 where a prefix or suffix is as long as the word or longer."""
    mask = (1 << BITS) - 1
    shape = "d" if any(c.isdigit() for c in word) else "a" if word.isascii() else "u"
    out = [crc32(f"w {word}".encode()) & mask, crc32(f"s {shape} {min(9, len(word))}".encode()) & mask]
    out += [crc32(f"p {word[:n]}".encode()) & mask if len(word) > n else 0 for n in PREFIXES]
    out += [crc32(f"e {word[-n:]}".encode()) & mask if len(word) > n else 0 for n in SUFFIXES]
    return out


def chains(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and the number of words in each of its chains."""
    words: list[bytes] = []
    sizes: list[int] = []
    for line in data.split(b"\n"):
        found = line.split()
        if found:
            words += found
            sizes.append(len(found))
    return words, np.asarray(sizes, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def side_by_side(starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each position the places of the blocks' tokens there; blocks come longest first."""
    return [starts[: int(np.searchsorted(-sizes, -t, "left"))] + t for t in range(int(sizes[0]) if len(sizes) else 0)]


def block_messages(e: np.ndarray, m: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, entering, returning) of the chains' blocks: the messages that enter each from the left and from the right."""
    n = -(-sizes // STEP)
    chain = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[chain] + nth * STEP
    lengths = np.minimum(sizes[chain] - nth * STEP, STEP)
    entering, returning = np.ones((len(chain), 2)), np.ones((len(chain), 2))
    long = np.flatnonzero(n[chain] > 1)
    if not len(long):
        return starts, lengths, entering, returning
    long = long[np.argsort(-lengths[long], kind="stable")]
    through = np.empty((len(long), 2, 2))  # row x: what leaves a block's last token when only state x enters
    a = None
    for t, at in enumerate(side_by_side(starts[long], lengths[long])):
        k = len(at)
        b = np.broadcast_to(np.eye(2), (k, 2, 2)) if t == 0 else a[:k] @ m
        a = b * np.stack([np.ones(k), e[at]], 1)[:, None, :]
        a = a / a.sum(axis=(1, 2), keepdims=True)
        through[:k] = a
    of = dict(zip(long.tolist(), through.tolist(), strict=True))
    (m00, m01), (m10, m11) = m.tolist()
    order = np.sort(long).tolist()
    u0 = u1 = 1.0
    for j in order:
        if nth[j] == 0:
            u0 = u1 = 1.0
        entering[j] = u0, u1
        (a, b), (c, d) = of[j]
        x, y = u0 * a + u1 * c, u0 * b + u1 * d
        u0, u1 = x * m00 + y * m10, x * m01 + y * m11
        u0, u1 = u0 / (u0 + u1), u1 / (u0 + u1)
    for j in reversed(order):
        if nth[j] == n[chain[j]] - 1:
            u0 = u1 = 1.0
        returning[j] = u0, u1
        (a, b), (c, d) = of[j]
        x, y = a * u0 + b * u1, c * u0 + d * u1
        u0, u1 = m00 * x + m01 * y, m10 * x + m11 * y
        u0, u1 = u0 / (u0 + u1), u1 / (u0 + u1)
    return starts, lengths, entering, returning


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token; the expected number of each transition over all chains, if asked for.

    emit: score of state 1 against state 0 of each token; chains of the given sizes follow each other.
    """
    if not len(emit):
        return np.empty(0), np.zeros((2, 2))
    m, e = np.exp(trans), np.exp(np.clip(emit, -30, 30))
    sizes = np.asarray(sizes)[np.asarray(sizes) > 0]
    starts, lengths, entering, returning = block_messages(e, m, sizes)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, entering, returning = starts[order], lengths[order], entering[order], returning[order]
    places = side_by_side(starts, lengths)
    forward, back = np.empty((len(emit), 2)), np.empty((len(emit), 2))
    a = None
    for t, at in enumerate(places):
        a = (entering if t == 0 else a[: len(at)] @ m) * 1.0
        a[:, 1] *= e[at]
        a = unit(a)
        forward[at] = a
    now = unit(returning)
    for t in range(len(places) - 1, -1, -1):
        at = places[t]
        if t + 1 < len(places):
            j = len(places[t + 1])
            right = now[:j].copy()
            right[:, 1] *= e[places[t + 1]]
            now[:j] = unit(right @ m.T)
        back[at] = now[: len(at)]
    p = unit(forward * back)[:, 1]
    if not transitions:
        return p, np.zeros((2, 2))
    inner = np.ones(len(emit), bool)  # tokens with a successor in their chain
    inner[np.cumsum(sizes) - 1] = False
    left, count = np.flatnonzero(inner), np.zeros((2, 2))
    for lo in range(0, len(left), 1 << 16):
        at = left[lo : lo + (1 << 16)]
        right = back[at + 1] * np.stack([np.ones(len(at)), e[at + 1]], 1)
        both = forward[at][:, :, None] * m * right[:, None, :]
        count += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, count


@dataclass
class Field:
    bias: float
    weights: np.ndarray  # by feature; that of 0 is 0
    trans: np.ndarray
    calibration: np.ndarray  # of 1, largest marginal, log of the expected number of toxic tokens

    def emissions(self, words: list[bytes], cache: dict[bytes, float]) -> np.ndarray:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        get, out = cache.get, np.empty(len(words))
        found = [get(w) for w in words]
        for k, (w, x) in enumerate(zip(words, found, strict=True)):
            if x is None:
                x = cache.get(w)
                if x is None:
                    x = cache[w] = float(self.bias + self.weights[word_features(core(w.decode("utf-8", "replace")))].sum())
                found[k] = x
        out[:] = found
        return out

    def tag(self, texts: list[str | None], cache: dict[bytes, float]) -> list[np.ndarray]:
        """The marginals of each text's words."""
        cut = [chains((t or "").encode("utf-8", "replace")) for t in texts]
        emit = [self.emissions(w, cache) for w, _ in cut]
        if not cut:
            return []
        p, _ = marginals(np.concatenate(emit), np.concatenate([s for _, s in cut]), self.trans, transitions=False)
        return np.split(p, np.cumsum([len(e) for e in emit])[:-1])

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(summary(p) @ self.calibration, -30, 30))))


def summary(p: np.ndarray) -> np.ndarray:
    """What a text's score rests on: only marginals of 0.05 and more count, so that long clean texts add nothing up."""
    sure = p[p >= 0.05]
    return np.asarray([1.0, float(p.max()) if len(p) else 0.0, float(np.log1p(sure.sum()))])


def indicative(texts: list[str], y: np.ndarray, least: int = 4, lift: float = 25.0) -> set[str]:
    """Words that toxic texts hold in so many different contexts, and so many times as often as clean texts hold them.

    A context is the word before: passages that copies share count once, and so don't make their words look toxic.
    """
    toxic, clean = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    numbers: dict[str, int] = {}
    contexts: set[int] = set()  # a word's number and a hash of the word before
    for text in (t for t, label in zip(texts, y, strict=True) if label == 1):
        before = 0
        for word in map(core, text.split()):
            contexts.add(numbers.setdefault(word, len(numbers)) << 32 | before)
            before = crc32(word.encode("utf-8", "replace"))
    found = Counter(c >> 32 for c in contexts)
    counts = Counter({w: found[k] for w, k in numbers.items() if w and found[k] >= min(least, max(2, toxic // 12))})
    del contexts, found
    elsewhere: Counter = Counter()
    for text in (t for t, label in zip(texts, y, strict=True) if label == 0):
        elsewhere.update({w for w in map(core, set(text.split())) if w in counts})
    return {w for w, n in counts.items() if (n / toxic) / ((elsewhere[w] + 0.5) / clean) >= lift}


def fit(texts: list[str], y: np.ndarray, rounds: int = 40, rate: float = 0.5, decay: float = 1e-5, per_label: int = 1200) -> Field:
    """Labels tokens (see above), maximises the chains' conditional likelihood with AdaGrad, then calibrates on the texts.

    All texts tell which words are toxic; the first per_label texts of each label, in the order given (train's is that of
    a hash), make the chains. Without texts of both labels, every score is the share of toxic texts (0.5 without any).
    """
    mean = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    field = Field(-5.0, np.zeros(1 << BITS), np.zeros((2, 2)), np.asarray([np.log(mean / (1 - mean)), 0.0, 0.0]))
    if len(np.unique(y)) < 2:
        return field
    marked = indicative(texts, y)
    chosen = np.sort(np.concatenate([np.flatnonzero(y == label)[:per_label] for label in (0, 1)]))
    texts, y = [texts[k] for k in chosen.tolist()], y[chosen]
    numbers: dict[bytes, int] = {}
    tokens, sizes, ends = [], [], [0]
    for t in texts:
        words, s = chains(t.encode("utf-8", "replace"))
        tokens.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        sizes.append(s)
        ends.append(ends[-1] + len(words))
    cores = [core(w.decode("utf-8", "replace")) for w in numbers]
    hit = np.asarray([c in marked for c in cores], bool)
    feats = np.asarray([word_features(c) for c in cores], np.int64).reshape(-1, N_FEATURES)
    tok, size = np.concatenate(tokens), np.concatenate(sizes)
    gold = hit[tok] & np.repeat(y == 1, np.diff(ends))
    inner = np.ones(len(tok), bool)  # tokens with a predecessor in their chain
    inner[(np.cumsum(size) - size)[size > 0]] = False
    g = gold.astype(int)
    pairs = (g[:-1] * 2 + g[1:])[inner[1:]]
    seen = np.bincount(pairs, minlength=4).reshape(2, 2)
    bias, trans, weights = -5.0, np.zeros((2, 2)), field.weights
    gw, gb, gt = np.full(len(weights), 1.0), 1.0, np.ones((2, 2))
    for _ in range(rounds):
        emit = bias + weights[feats].sum(1)
        p, expected = marginals(emit[tok], size, trans)
        err = gold - p
        by_word = np.bincount(tok, err, len(cores))
        dw = np.bincount(feats.ravel(), np.repeat(by_word, N_FEATURES), len(weights)) - decay * weights
        dw[0] = 0
        gw += dw**2
        weights += rate * dw / np.sqrt(gw)
        db, dt = float(err.sum()), seen - expected - 0.01 * trans
        gb, gt = gb + db**2, gt + dt**2
        bias += rate * db / gb**0.5
        trans = trans + 0.1 * rate * dt / np.sqrt(gt)
        trans[0, 0] = 0.0
    field = Field(bias, weights, trans, field.calibration)
    p, _ = marginals((bias + weights[feats].sum(1))[tok], size, trans, transitions=False)
    x = np.stack([summary(v) for v in np.split(p, ends[1:-1])])
    c = np.asarray([-3.0, 3.0, 1.0])
    for _ in range(400):  # ridge logistic regression by damped Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3) * 0.5
        step = np.linalg.solve(h, x.T @ (y - q) - 0.5 * np.asarray([0, 1, 1]) * c)
        c = c + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    field.calibration = c
    return field


def excerpt(text: str, most: int) -> str:
    """A text of at most `most` words as it is; of a longer one, windows of up to 64 words of its lines, drawn over the whole text by a hash."""
    windows = []
    for line in text.split("\n"):
        words = line.split()
        windows += [" ".join(words[k : k + 64]) for k in range(0, len(words), 64)]
    if sum(w.count(" ") + 1 for w in windows) <= most:
        return text
    kept, left = set(), most
    for k in sorted(range(len(windows)), key=lambda k: (crc32(f"{k} {windows[k]}".encode("utf-8", "replace")), k)):
        left -= windows[k].count(" ") + 1
        if left < 0:
            break
        kept.add(k)
    return "\n".join(windows[k] for k in sorted(kept))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text_col: str = "text", max_rows: int = 8000, max_words: int = 4000, **options) -> Field:
    """A field fitted on at most max_rows labelled texts (see training_rows), of each at most max_words words (see excerpt).

    What the driver collects is bounded by both. doc_id may be of any type; of repeated ids one label and one text count.
    """
    ship(docs.sparkSession)
    sample = training_rows(docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")), labels, label, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([excerpt(t, max_words) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], short], ["place", "y", "text"])

    found = sample.select(F.xxhash64("doc_id").alias("place"), "y", "text").mapInArrow(run, "place long, y int, text string").toArrow()
    found = found.sort_by([("place", "ascending"), ("text", "ascending")])
    texts, y = found["text"].to_pylist(), np.asarray(found["y"].to_pylist(), np.float64)
    del found
    give_back()
    return fit(texts, y, **options)


def score(docs: DataFrame, field: Field, text_col: str = "text", out: str = "score", spans: str | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with a score from 0 to 1 for every text (rounded to 6 places), null and empty ones too.

    spans: name of a further column, array<struct<start,length,probability>>, the words with marginals of at least
    threshold by their byte offsets in UTF-8. Row-local; all columns and repeated rows stay.
    """
    ship(docs.sparkSession)
    names = docs.columns
    if {out, spans} & {*names}:
        raise ValueError(f"docs already has a column {out} or {spans}")
    # of fixed size: 2 MB
    shared = docs.sparkSession.sparkContext.broadcast((field.bias, field.weights, field.trans, field.calibration))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` double"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("probability", pa.float64())]))
    if spans:
        schema += f", `{spans}` array<struct<start:long,length:int,probability:double>>"
    at = names.index(text_col)

    def offsets(text: str | None, p: np.ndarray) -> list[dict]:
        if not len(p) or p.max() < threshold:
            return []
        where = [m.span() for m in TOKEN.finditer((text or "").encode("utf-8", "replace"))]
        return [{"start": where[k][0], "length": where[k][1] - where[k][0], "probability": round(float(p[k]), 6)} for k in np.flatnonzero(p >= threshold).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Field(*shared.value), {}
        for batch in batches:
            scores, found = [], []
            for lo in range(0, batch.num_rows, 512):
                texts = batch.column(at).slice(lo, 512).to_pylist()
                tagged = model.tag(texts, cache)
                scores += [round(model.score(p), 6) for p in tagged]
                if spans:
                    found += [offsets(t, p) for t, p in zip(texts, tagged, strict=True)]
            more = [pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, out, *([spans] if spans else [])])
        give_back()

    return docs.mapInArrow(run, schema)
