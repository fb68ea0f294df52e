"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions of the
features with rank-k weights, in time linear in the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhire.llm.common import give_back, ship, training_rows

WORD_BITS = 18
BINS = 16
#: Structure statistics, each put in one of BINS bins; then the metadata columns.
STATISTICS = ("log_chars", "upper", "digit", "blank", "newline", "symbol", "stop", "other", "mark", "unicode", "distinct", "word_length", "dup_lines", "line_length")


def byte_classes() -> np.ndarray:
    """0 lower-case, 1 upper-case, 2 digit, 3 blank, 4 newline, 5 symbol, 6 sentence end, 7 other ASCII, 8 ! and ?, 9 beyond ASCII."""
    out = np.full(256, 7, np.uint8)
    out[128:] = 9
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", "#*$%&|<>~^_=\\{}[]@", ".,;:", "", "!?")):
        out[[ord(c) for c in chars]] = k
    return out


CLASSES = byte_classes()


def share_bin(x: float) -> int:
    """Bins of a share between 0 and 1, finer near 0."""
    return min(BINS - 1, int(BINS * x**0.5))


def features(text: str | None, metadata: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (ascending, distinct) and values of a text. Null is as an empty text; a null datum has a bin of its own."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    distinct = set(words)
    mask = (1 << WORD_BITS) - 1
    hashed = np.unique(np.fromiter((crc32(w) & mask for w in distinct), np.int64, len(distinct)))
    n = max(1, len(data))
    by = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=10) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    per_word, per_line = len(data) / max(1, len(words)), len(data) / max(1, len(lines))
    stats = [
        min(BINS - 1, n.bit_length() - 1), *(share_bin(x) for x in by[1:]), min(BINS - 1, int(BINS * len(distinct) / max(1, len(words)))),
        min(BINS - 1, int(per_word)), share_bin(1 - len(set(lines)) / max(1, len(lines))), min(BINS - 1, int(per_line).bit_length()),
    ]
    for x in metadata:
        stats.append(0 if x is None or not np.isfinite(x) else 1 + min(BINS - 2, int(max(0, x)).bit_length()))
    offset = (1 << WORD_BITS) + BINS * np.arange(len(stats))
    index = np.concatenate([hashed, offset + np.asarray(stats)])
    value = np.ones(len(index), np.float32)
    value[: len(hashed)] = 1 / max(1, len(hashed)) ** 0.5
    value[len(hashed) :] = 0.5
    return index.astype(np.int32), value


def width(n_metadata: int) -> int:
    return (1 << WORD_BITS) + BINS * (len(STATISTICS) + n_metadata)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid of texts whose features begin at starts; also the gathered factors and their sums."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, vx, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        z, _, _ = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_metadata: int, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss over the sample. Without rows of both labels the score is the labels' mean everywhere (0.5 without any)."""
    rng = np.random.default_rng(seed)
    d = width(n_metadata)
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    fm = FactorisationMachine(float(np.log(mean / (1 - mean))), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, rank)).astype(np.float32))
    if len(np.unique(y)) < 2:
        fm.v[:] = 0
        return fm
    gw, gv, gb = np.full(d, 1e-2, np.float32), np.full((d, rank), 1e-2, np.float32), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            index = np.concatenate([rows[k][0] for k in batch])
            value = np.concatenate([rows[k][1] for k in batch])
            n = np.asarray([len(rows[k][0]) for k in batch])
            z, vx, sums = fm.raw(index, value, np.cumsum([0, *n[:-1]]))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]).astype(np.float32) / len(batch) ** 0.5
            each = np.repeat(err, n)
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, each * value, len(used)).astype(np.float32) + decay * fm.w[used]
            grad = (each * value)[:, None] * (np.repeat(sums, n, axis=0) - vx)
            dv = np.stack([np.bincount(place, grad[:, f], len(used)) for f in range(rank)], 1).astype(np.float32) + decay * fm.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            fm.w[used] -= rate * dw / np.sqrt(gw[used])
            fm.v[used] -= rate * dv / np.sqrt(gv[used])
            gb += float(err.sum()) ** 2
            fm.bias -= rate * float(err.sum()) / gb**0.5
    return fm


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", metadata: tuple[str, ...] = (), max_rows: int = 6000, **options) -> FactorisationMachine:
    """A machine fitted on at most max_rows labelled rows (see training_rows); only their features go to the driver.

    doc_id may be of any type; of repeated ids one label and one text count. Null texts are as empty ones, a null or
    non-finite datum has a bin of its own. Without labelled rows, every score is 0.5.
    """
    ship(docs.sparkSession)
    data = [f"datum {k}" for k in range(len(metadata))]  # whatever their own names
    own = docs.select("doc_id", F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(d) for c, d in zip(metadata, data, strict=True)))
    sample = training_rows(own, labels, label, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), tuple(m)) for t, *m in zip(batch.column(2), *([x.as_py() for x in batch.column(k)] for k in range(3, batch.num_columns)), strict=True)]
            index, value = pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), index, value], ["place", "y", "index", "value"])

    found = sample.select(F.xxhash64("doc_id").alias("place"), "y", "text", *data)
    found = found.mapInArrow(run, "place long, y int, index array<int>, value array<float>").toArrow()
    found = found.sort_by([("place", "ascending")]).combine_chunks()
    rows = list(zip((x.values.to_numpy() for x in found["index"]), (x.values.to_numpy() for x in found["value"]), strict=True))
    return fit(rows, np.asarray(found["y"], np.float32), len(metadata), **options)


def score(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", metadata: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 for every text (rounded to 6 places), null and empty ones too.

    Row-local; all columns and repeated rows stay. A column of docs that has the new one's name is an error.
    """
    ship(docs.sparkSession)
    names = docs.columns
    if out in names:
        raise ValueError(f"docs already has a column {out}")
    # its size is fixed by WORD_BITS and the rank: 9 MB
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = [names.index(c) for c in metadata]
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorisationMachine(*shared.value)
        for batch in batches:
            scores = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [[None if x is None else float(x) for x in part.column(k).to_pylist()] for k in at]
                rows = [features(t.as_py(), tuple(d[j] for d in data)) for j, t in enumerate(part.column(text_at))]
                scores.append(fm.score(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(np.concatenate(scores) if scores else np.empty(0), 6))], [*names, out])
        give_back()

    return docs.mapInArrow(run, f"{schema}, `{out}` double")
