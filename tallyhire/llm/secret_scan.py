"""Secret scans: an Aho-Corasick prefilter, anchored regular expressions near its hits, checksums inside the finds.

One automaton over all keywords reads each whole text once, as lower-cased UTF-8. An expression is tried only where one of
its keywords begins (or, for keys that follow a keyword at a short distance, within that distance), anchored there. Runs of
hexadecimal digits have no keyword: they are found from every 16th byte, as a run of 32 can't avoid two of these.

The base kinds are patterns alone. The kinds that the method adds carry a checksum in themselves, which must be right: a
CRC-32 in base 62 (github, npm) or the double SHA-256 of Base58Check (xprv: extended private keys, wif: private keys).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhire.llm.common import ship

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
PLACE62 = {c: k for k, c in enumerate(BASE62)}
PLACE58 = {c: k for k, c in enumerate(BASE58)}
#: A find of the base kinds at least so long: group 2 of assign, the whole of access and hex.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
STRIDE = 16


def crc62(body: bytes, check: bytes) -> bool:
    """Whether check is the CRC-32 of body as a number in base 62."""
    value = 0
    for c in check:
        value = value * 62 + PLACE62[c]
    return value == crc32(body)


def base58check(key: bytes) -> bytes | None:
    """What a Base58Check text holds before its four bytes of checksum, None if these are wrong."""
    value = 0
    for c in key:
        value = value * 58 + PLACE58[c]
    data = value.to_bytes((value.bit_length() + 7) // 8, "big")
    data = bytes(len(key) - len(key.lstrip(b"1"))) + data
    return data[:-4] if len(data) > 4 and sha256(sha256(data[:-4]).digest()).digest()[:4] == data[-4:] else None


@dataclass(frozen=True)
class Kind:
    """A pattern to be tried where a keyword (lower case) begins; within > 0: the first match that begins so many bytes after it at most.

    good judges a match; a match that is no good still hides what begins inside it, as leftmost matches do.
    """

    name: str
    base: bool
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    good: Callable[[re.Match[bytes]], bool]
    within: int = 0


# The patterns of the base kinds, and the public formats of keys with a checksum.
KINDS = (
    Kind("assign", True, (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"), re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), lambda m: len(m[2]) >= LEAST_ASSIGN),
    Kind("access", True, (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= LEAST_ACCESS),
    Kind("hex", True, (), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= LEAST_HEX),
    Kind("github", False, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: crc62(m[1], m[2])),
    Kind("npm", False, (b"npm_",), re.compile(rb"(?<![A-Za-z0-9])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: crc62(m[1], m[2])),
    Kind("xprv", False, (b"xprv", b"yprv", b"zprv", b"tprv"), re.compile(rb"(?<![A-Za-z0-9])[xyzt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), lambda m: len(base58check(m[0]) or b"") == 78),
    Kind("wif", False, (b"wif", b"privkey", b"private"), re.compile(rb"(?<![A-Za-z0-9])[5KLc9][1-9A-HJ-NP-Za-km-z]{50,51}(?![A-Za-z0-9])"), lambda m: (base58check(m[0]) or b" ")[0] in (0x80, 0xEF), within=80),
)
ORDER = {kind.name: k for k, kind in enumerate(KINDS)}
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def automaton() -> ahocorasick.Automaton:
    """Each keyword yields its length and the kinds that it starts. Bytes are its letters, as Latin-1."""
    kinds: dict[bytes, list[int]] = {}
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            kinds.setdefault(word, []).append(k)
    found = ahocorasick.Automaton()
    for word, starts in kinds.items():
        found.add_word(word.decode("latin-1"), (len(word), starts))
    found.make_automaton()
    return found


def hex_runs(data: bytes, kind: Kind, place: int) -> Iterator[Span]:
    """Runs of lower-case hexadecimal digits, looked for around sampled bytes: a run of 32 holds two neighbouring samples."""
    if len(data) < LEAST_HEX:
        return
    sampled = IS_HEX[np.frombuffer(data, np.uint8)[::STRIDE]]
    end = 0
    for at in (np.flatnonzero(sampled[:-1] & sampled[1:]) * STRIDE).tolist():
        if at < end:
            continue
        start = at
        while start > end and IS_HEX[data[start - 1]]:
            start -= 1
        m = kind.pattern.match(data, start)
        end = m.end()
        if kind.good(m):
            yield start, place, end


def byte_spans(data: bytes, keywords: ahocorasick.Automaton) -> list[Span]:
    """All good finds in a text, by start and then kind, in bytes."""
    hits: dict[int, list[int]] = {}
    for last, (length, kinds) in keywords.iter(data.lower().decode("latin-1")):
        for k in kinds:
            hits.setdefault(k, []).append(last - length + 1)
    found: list[Span] = []
    for k, kind in enumerate(KINDS):
        end = 0
        for at in sorted(hits.get(k, ())):
            if kind.within:
                m = kind.pattern.search(data, max(at, end), min(len(data), max(at, end) + kind.within + 64))
                if m and m.start() > at + kind.within:
                    m = None
            else:
                m = kind.pattern.match(data, at) if at >= end else None
            if m:
                end = m.end()
                if kind.good(m):
                    found.append((m.start(), k, end))
        if kind.name == "hex":
            found += hex_runs(data, kind, k)
    return sorted(found)


def in_code_points(data: bytes, found: list[Span]) -> list[Span]:
    """Spans in bytes of UTF-8 as spans in code points."""
    if not found or data.isascii():
        return found
    places = sorted({x for start, _, end in found for x in (start, end)})
    counts, at, n = [], 0, 0
    for place in places:
        n += len(data[at:place].decode("utf-8", "replace"))
        at = place
        counts.append(n)
    of = lambda x: counts[bisect_left(places, x)]
    return [(of(start), k, of(end)) for start, k, end in found]


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with out, array<struct<kind, start, end, base>>: the secrets of every whole text, in code points, end exclusive.

    By start, then in the order of KINDS. Null and empty texts have none. Row-local: repeated rows, null ids and all other
    columns stay as they are, but a column named out is an error.
    """
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}")
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(lo, 512)
                rows = []
                for data in part.column(at).cast(pa.binary()):
                    text = data.as_py() or b""
                    rows.append([{"kind": KINDS[k].name, "start": start, "end": end, "base": KINDS[k].base} for start, k, end in in_code_points(text, byte_spans(text, keywords))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` array<struct<kind:string,start:long,end:long,base:boolean>>")


def redacted(text: Column, spans: Column, mark: str = "*") -> Column:
    """The text with every character inside a span replaced; spans come by start and may overlap."""
    part = lambda at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("said"))

    def step(done: Column, s: Column) -> Column:
        start, end = F.greatest(done["at"], s["start"]), F.greatest(done["at"], s["end"])
        hidden = F.repeat(F.lit(mark), (end - start).cast("int"))
        return F.struct(end.alias("at"), F.concat(done["said"], part(done["at"], start - done["at"]), hidden).alias("said"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, lambda done: F.concat(done["said"], part(done["at"], F.char_length(text))))).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of scan's rows; a span is written kind:start:end."""
    spans = F.col(spans_col)
    base = F.filter(spans, lambda s: s["base"])
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(F.col(id_col), count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"))
