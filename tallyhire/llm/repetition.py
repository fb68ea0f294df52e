"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams a text holds twice or more; what counts is how many characters
lie inside them, and inside lines that repeat an earlier line. A text fails where a share passes its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhire.llm.common import ship

#: Largest share of a text's word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of a text's characters in lines equal to an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def scrambled(ids: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each word number."""
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def repeated(h: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """The positions inside windows of n that begin where starts is true."""
    step = np.zeros(length + 1, np.int64)
    step[: len(starts)] += starts
    step[n : n + len(starts)] -= starts
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, dup_line_chars, [characters in duplicated n-grams])."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # at the six ASCII white-space characters
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)
    numbers: dict[bytes, int] = {}
    code = scrambled(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    repeat_words, inside, sizes = 0, dict.fromkeys(lengths, 0), None
    h = code
    for n in range(2, max(5, *lengths) + 1):
        if len(code) <= n:
            break
        h = h[:-1] * BASE + code[n - 1 :]
        if n != 5 and n not in inside:
            continue
        again = repeated(h)
        if not again.any():
            if n >= 5:
                break  # longer ones don't repeat either
            continue
        at = covered(again, n, len(words))
        if n == 5:
            repeat_words = int(at.sum())
        if n in inside:
            if sizes is None:
                sizes = np.fromiter(map(len, words) if text.isascii() else (len(w.decode()) for w in words), np.int64, len(words))
            inside[n] = int(sizes[at].sum())
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dup_lines, repeat_words, line_chars, dup_chars, list(inside.values())


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The counts of measure() for every text, base_failed and kept.

    Null and empty texts have no words and so fail. Repeated rows and null ids are kept as they come. Row-local.
    Shares are compared as whole numbers of parts in 100, so that no rounding decides.
    """
    limits = NGRAM_LIMITS if limits is None else limits
    lengths, percent = tuple(limits), [round(100 * x) for x in limits.values()]
    line_percent = round(100 * line_limit)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, chars, symbols, lines, repeat, line_chars, dup_chars, inside = measure(text.as_py(), lengths)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                kept = not failed and 100 * dup_chars <= line_percent * line_chars and all(100 * x <= p * chars for x, p in zip(inside, percent, strict=True))
                rows.append((n, chars, symbols, lines, repeat, line_chars, dup_chars, inside, failed, kept))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {'array<long>' if n == 'dup_ngram_chars' else 'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in NAMES)
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars", "dup_ngram_chars", "base_failed", "kept")
