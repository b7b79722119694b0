"""Token counts by heap-and-linked-list byte-pair merging (``word_bpe_49k.json`` by default).

The symbols of a word are a doubly linked list, its neighbouring pairs with a rank lie in a heap. The pair of lowest rank, of
equal ranks the leftmost, is popped again and again; an entry whose pair has changed since is passed over. A merge takes one
symbol out, so the count of a word is its bytes less its merges; no ids are made. A word of n bytes takes O(n log n), also when a
whole text is one word. A task keeps the counts of up to ``CACHE_WORDS`` words of at most ``CACHE_BYTES`` bytes, so a common word
is merged once.

Words, the normal form and special tokens are those of the file, as in :mod:`postwatch.llm.bpe`; a special token counts 1.

Defined cases: a null or empty text has no bytes and no tokens; texts are taken whole; rows are independent, so repeated rows and
null ids give a row each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import bpe, common

LIMIT = 2048
CACHE_WORDS, CACHE_BYTES = 300_000, 64
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_PLACE = 40  # bits of a heap entry that hold the place; the rank stands above


class Merges(dict):
    """Token counts by word; a word that is not there is merged."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner = [vocab[c] for c in bpe.byte_symbols()]
        self.last = [vocab[c + suffix] for c in bpe.byte_symbols()]
        self.width = max(vocab.values()) + 1
        self.found: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.found[vocab[a] * self.width + vocab[b]] = (rank << _PLACE, vocab[a + b])

    def __missing__(self, word: str) -> int:
        if word[0] == " ":  # a special token, see bpe.Tokenizer.words
            return 1
        raw = word.encode()
        n = len(raw) - self.merges(raw)
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def merges(self, raw: bytes) -> int:
        """How many merges a word takes."""
        width, found, n = self.width, self.found, len(raw)
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [hit[0] | k for k in range(n - 1) if (hit := found.get(symbols[k] * width + symbols[k + 1]))]
        heapq.heapify(heap)
        done, mask = 0, (1 << _PLACE) - 1
        while heap:
            entry = heapq.heappop(heap)
            at = entry & mask
            to = after[at]
            # a symbol taken out is -1 and has no pair
            hit = found.get(symbols[at] * width + symbols[to]) if to < n and symbols[at] >= 0 else None
            if hit is None or hit[0] | at != entry:
                continue
            done += 1
            symbols[at], symbols[to] = hit[1], -1
            after[at] = beyond = after[to]
            if beyond < n:
                before[beyond] = at
                if pair := found.get(symbols[at] * width + symbols[beyond]):
                    heapq.heappush(heap, pair[0] | at)
            if (left := before[at]) >= 0 and (pair := found.get(symbols[left] * width + symbols[at])):
                heapq.heappush(heap, pair[0] | left)
        return done


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = bpe.tokenizer(path).words, merges(path).__getitem__
        for batch, texts in common.chunks(batches):
            n = np.array([sum(map(count, words(text))) for text in texts.to_pylist()], np.int64)
            n_bytes = np.diff(common.flat(texts)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counts(path or bpe.default_path(), limit), COUNTS)
