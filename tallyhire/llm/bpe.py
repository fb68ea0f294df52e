"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never lie inside a token of an encoded text, so between its two
bytes is a certain cut: what is left and right of it merges independently. Two kinds of cuts are used.

* In a whole text: before an ASCII white-space byte, where the pair (previous byte, white space) is in no token. The
  pre-tokenizer's pattern agrees with these cuts: a pre-token has white space only at its start, or only white space;
  of a white-space run it splits off the last character, which a cut further left does not change. So the stretches
  between these cuts, most of which repeat, go through the pattern on their own.
* In a pre-token: between any two bytes whose pair is in no token.

The fragments between all cuts are merged one by one, each distinct one once in a unit of UNIT_BYTES, and their ids are
put together again.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyhire.llm.common import give_back, ship

UNIT_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ForcedBoundaryBPE:
    """Encoder and decoder over a byte-level BPE file of the tokenizers library (no normalizer, its usual pattern)."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"] if t["special"]}
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        order = [vocab[a + b] for a, b in merged]
        if order != sorted(order):
            raise ValueError("the ids of merged tokens must follow the merges' order")
        inside = np.zeros(65536, bool)
        for t in self.token_bytes.values():
            a = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[a[:-1] * 256 + a[1:]] = True
        self.never = ~inside
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.text_cut = self.never & np.tile(space, 256)
        self.pattern = regex.compile(pattern)
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in self.token_bytes.items()}, special_tokens={})
        self._merge = core._encode_single_piece
        self.token_bytes |= {i: t for t, i in self.special.items()}
        self._special_pattern = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")")
        self._table = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self._lengths = np.asarray([len(t) for t in self._table], np.int64)

    @staticmethod
    def _distinct(data: np.ndarray, cut: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
        """The distinct pieces of data between cuts (a flag before each byte), the number of each piece, and where pieces begin."""
        at = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices), at

    @staticmethod
    def _gather(flat: np.ndarray, count: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of flat, whose lengths are count, in the order of code; and where each of them begins, with the end."""
        start, n = np.cumsum(count) - count, count[code]
        to = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(start[code] - to[:-1], n) + np.arange(to[-1])], to

    def fragments(self, stretches: pa.BinaryArray, usual: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, flags of the cuts before each): the stretches one after the other, cut at their pre-tokens and at all never pairs.

        The first `usual` ones are ASCII and meet at cuts of a whole text, so the pattern goes over all of them at once.
        """
        ends = np.frombuffer(stretches.buffers()[1], np.int32)[: len(stretches) + 1]
        data = np.frombuffer(stretches.buffers()[2], np.uint8)[: ends[-1]]
        find = self.pattern.findall
        sizes = [*map(len, find(data[: ends[usual]].tobytes().decode()))]
        for stretch in stretches[usual:].to_pylist():
            sizes += (len(p.encode()) for p in find(stretch.decode()))
        cut = np.zeros(len(data), bool)
        cut[1:] = self.never[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        cut[np.cumsum([0, *sizes[:-1]])] = True
        return data, cut

    def _encode_distinct(self, stretches: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all stretches one after the other in some order, the number of each one's, and each stretch's place there."""
        ends = np.frombuffer(stretches.buffers()[1], np.int32)[: len(stretches) + 1]
        data = np.frombuffer(stretches.buffers()[2], np.uint8)
        wide = np.concatenate([[0], np.cumsum(data[: ends[-1]] > 127)])[ends]
        first, last = data[ends[:-1]], data[ends[1:] - 1]
        usual = (first == 32) & self.text_cut[(last.astype(np.uint16) << 8) | 32] & (np.diff(wide) == 0)
        order = np.argsort(~usual, kind="stable")
        stretches = stretches.take(pa.array(order))
        data, cut = self.fragments(stretches, int(usual.sum()))
        parts, code, at = self._distinct(data, cut)
        merged = [self._merge(p) for p in parts.to_pylist()]
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(itertools.chain.from_iterable(merged), np.uint32, int(count.sum()))
        ids, to = self._gather(flat, count, code)
        ends = np.frombuffer(stretches.buffers()[1], np.int32)[: len(stretches) + 1]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return ids, np.diff(to[np.searchsorted(at, ends)]), place

    def _encode_buffer(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other in data, each beginning at one of starts; ids and their ends."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.text_cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        cut[starts[starts < len(data)]] = True
        cut[0] = True
        stretches, code, at = self._distinct(data, cut)
        flat, count, place = self._encode_distinct(stretches)
        ids, to = self._gather(flat, count, place[code])
        return ids, to[np.searchsorted(at, np.append(starts[1:], len(data)))]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The uint32 ids of each whole text; null is empty. The strings of special tokens are those tokens."""
        texts = texts.cast(pa.large_string()).fill_null("")
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= np.asarray(pc.match_substring(texts, token.decode()))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + UNIT_BYTES, "right")) - 1)
            hi = min(hi, len(texts))
            part = data[offsets[lo] : offsets[hi]]
            if len(part):
                ids, ends = self._encode_buffer(part, offsets[lo:hi] - offsets[lo])
                for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    out[lo + k] = ids[i:j]
            lo = hi
        for k in np.flatnonzero(special).tolist():
            out[k] = self._encode_special(texts[k].as_py().encode())
        return out

    def each(self, texts: pa.Array, rows: int = 512) -> Iterator[np.ndarray]:
        """encode_all, so many texts at a time."""
        for lo in range(0, len(texts), rows):
            yield from self.encode_all(texts.slice(lo, rows))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def _encode_special(self, data: bytes) -> np.ndarray:
        found = []
        for k, piece in enumerate(self._special_pattern.split(data)):
            if k % 2:
                found.append(np.asarray([self.special[piece]], np.uint32))
            elif piece:
                found.append(self._encode_buffer(np.frombuffer(piece, np.uint8), np.zeros(1, np.int64))[0])
        return np.concatenate(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self._table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and file."""
    if path not in _loaded:
        import public_tokenizers

        _loaded[path] = ForcedBoundaryBPE(path, public_tokenizers.PATTERN)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text.

    Null and empty texts have no ids and decode to ''. Repeated rows and null ids are kept as they come; other columns
    are dropped, whatever their names. An empty table gives no rows. Row-local: nothing is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = [x.view(np.int32) for x in bpe.encode_all(part.column(1))]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([bpe.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode_documents' results as digests, taken where the ids are made."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        decimal = [str(i) for i in range(len(bpe._table))]
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.each(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
