"""Token counts by trie-shared dynamic programming.

The vocabulary's pieces carry unigram log-probabilities. The best segmentation of a pre-token (a word with the mark for
a word's start before it) is a forward dynamic program over its prefixes, and prefixes that pre-tokens share have the
same scores. So the distinct pre-tokens of a block of texts go through a trie in sorted order: each shared prefix is
scored once, each terminal keeps its token count, and a text's count is the sum over its words.

The trie is walked depth first: only the path from the root to the current pre-token is held.

Probabilities follow Zipf's law by a piece's rank in the vocabulary file, which holds merge ranks in place of
log-probabilities. A character in no piece counts one token for each of its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhire.llm.common import ship

START = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000


def zipf_vocabulary(path: str) -> dict[str, float]:
    """Piece to log-probability, of the normal pieces of a sentencepiece model file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -log(r + 1) - total for r, p in enumerate(pieces)}


class TrieCounter:
    """Token counts of pre-tokens under a unigram vocabulary."""

    def __init__(self, vocabulary: dict[str, float]):
        self.scores = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.nodes = 0  # trie nodes scored, for tests

    def counts(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """Terminal counts of distinct pre-tokens. Of equally good segmentations the one with the longest last piece holds."""
        get, longest, out = self.scores.get, self.longest, {}
        best, count, last = [0.0], [0], ""
        for word in sorted(set(pre_tokens)):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = None, 0
                for begin in range(max(0, end - longest), end):
                    s = get(word[begin:end])
                    if s is None:
                        if begin < end - 1:
                            continue
                        s, n = self.unknown, len(word[begin].encode("utf-8", "replace"))
                    else:
                        n = 1
                    if top is None or best[begin] + s > top:
                        top, tokens = best[begin] + s, count[begin] + n
                best.append(top)
                count.append(tokens)
            self.nodes += len(word) - shared
            out[word] = count[-1]
            last = word
        return out


_loaded: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = 2048) -> DataFrame:
    """(id, n_words, n_tokens) of every text; words are runs of characters other than the six ASCII white-space ones.

    Null and empty texts have no words. Repeated rows and null ids are kept as they come. Row-local. Words longer than
    any piece by far are still counted whole; only their counts are not kept for the next block.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = TrieCounter(zipf_vocabulary(path))
        counter = _loaded[path]
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for lo in range(0, batch.num_rows, block):
                texts = [(t or "").encode("utf-8", "replace").split() for t in batch.column(1).slice(lo, block).to_pylist()]
                new = {w for words in texts for w in words}.difference(known)
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = {w for words in texts for w in words}
                found = counter.counts(START + w.decode() for w in new)
                known.update((w, found[START + w.decode()]) for w in new)
                n_words += map(len, texts)
                n_tokens += [sum(map(known.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
