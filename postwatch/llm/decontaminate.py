"""Benchmark decontamination by Wu-Manber search for the word windows of a benchmark.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A benchmark item gives a window for
each 10 consecutive words, an item of fewer words (but not none) is one window. Texts are brought to ``word word ...`` and
searched for all windows at once: block shift tables skip places where no window can end, a bucket of suffix and prefix
hash picks the test strings, and direct comparison confirms them. Windows are sorted into classes by length, since the
shortest string of a class bounds the shifts.

Defined cases: a null text has no words; a null item text gives no window; a null item_id marks words but is no item;
rows are judged one by one, so repeated rows repeat in the result; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import common

WINDOW = 10
#: Benchmark text searched for in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
LENGTH_CLASSES = (1, 2, 4, 8, 16, 32)
LANE = 1024
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``\\nword word\\n...``: the bytes, word starts, word ends, and how many words precede each text (and the end)."""
    raw, marks = common.separated(texts)
    data = _FOLD[raw]
    is_word = data != 32
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    data[marks] = 10
    keep[marks] = True
    data = data[keep]
    starts, ends = common.words_of(data, data > 32)
    at = np.flatnonzero(data == 10)
    return data, starts, ends, np.searchsorted(starts, at)


def windows(item_ids: list, texts: list) -> dict[bytes, tuple[int, list[str]]]:
    """Window: its number of words, and the items that hold it."""
    found: dict[bytes, tuple[int, set]] = {}
    if not texts:
        return {}
    data, starts, ends, before = normalised(common.utf8(pa.array(texts, pa.string())))
    body = data.tobytes()
    for k, item in enumerate(item_ids):
        first, last = int(before[k]), int(before[k + 1])
        for at in range(first, max(first + 1, last - WINDOW + 1) if last > first else first):
            upto = min(at + WINDOW, last)
            entry = found.setdefault(body[starts[at] : ends[upto - 1]], (upto - at, set()))
            if item is not None:
                entry[1].add(str(item))
    return {k: (n, sorted(items)) for k, (n, items) in found.items()}


class WuManber:
    """Multi-pattern search; ``find`` gives (start, pattern) pairs for patterns that stand between separators."""

    def __init__(self, patterns: list[bytes]):
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(patterns), np.uint8)
        self.classes = []
        for low, high in zip(LENGTH_CLASSES, (*LENGTH_CLASSES[1:], 1 << 60)):
            chosen = np.flatnonzero((self.lengths >= low) & (self.lengths < high))
            if len(chosen):
                self.classes.append(self._tables(chosen, low))

    def _tables(self, chosen: np.ndarray, shortest: int) -> tuple:
        block = min(8, max(1, shortest // 2))
        bits = 12 if block < 2 else 20
        shift = np.full(1 << bits, shortest - block + 1, np.uint8)
        base = self.offsets[chosen]
        for end in range(block, shortest + 1):
            at = self._slot(self._blocks(self.bytes, base + end - block, block), bits)
            np.minimum.at(shift, at, shortest - end)
        key = self._key(self.bytes, base, shortest, block)
        order = np.argsort(key, kind="stable")
        return shortest, block, bits, shift, key[order], chosen[order]

    @staticmethod
    def _blocks(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        value = data[at].astype(np.uint64)
        for j in range(1, block):
            value = (value << np.uint64(8)) | data[at + j]
        return value

    @staticmethod
    def _slot(blocks: np.ndarray, bits: int) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _key(self, data: np.ndarray, start: np.ndarray, shortest: int, block: int) -> np.ndarray:
        """Of the first and the last block of the compared prefix."""
        prefix = self._blocks(data, start, block)
        return common.mixed(prefix * np.uint64(0xC2B2AE3D27D4EB4F) + self._blocks(data, start + shortest - block, block))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = [self._find(data, *tables) for tables in self.classes]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def _find(self, data, shortest, block, bits, shift, keys, patterns):
        # lanes advance side by side, each through its own stretch of the text
        at = np.arange(0, max(0, len(data) - shortest + 1), LANE, dtype=np.int64)
        limit = np.minimum(at + LANE, len(data) - shortest + 1)
        hits = []
        while len(at):
            step = shift[self._slot(self._blocks(data, at + shortest - block, block), bits)].astype(np.int64)
            zero = step == 0
            hits.append(at[zero])
            at = at + np.maximum(step, 1)
            inside = at < limit
            at, limit = at[inside], limit[inside]
        start = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        start = start[data[start - 1] <= 32]  # data begins with a mark, so no pattern starts at 0
        key = self._key(data, start, shortest, block)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        n = high - low
        start = np.repeat(start, n)
        which = patterns[np.repeat(low, n) + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)]
        length = self.lengths[which]
        fits = start + length < len(data)
        start, which, length = start[fits], which[fits], length[fits]
        ends = data[start + length] <= 32
        start, which, length = start[ends], which[ends], length[ends]
        same = np.ones(len(start), bool)
        for part in range(0, len(start), 1 << 14):  # comparison of all bytes, some pairs at a time
            piece = slice(part, part + (1 << 14))
            n = length[piece]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = data[np.repeat(start[piece], n) + within] == self.bytes[np.repeat(self.offsets[which[piece]], n) + within]
            same[piece] = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(n) else True
        return start[same], which[same]


def _search(found: dict[bytes, tuple[int, list[str]]]):
    """A function from texts to (words before each text, first word and word after of each occurrence, its text, its pattern)."""
    patterns = list(found)
    engine = WuManber(patterns)
    n_words = np.array([found[p][0] for p in patterns], np.int64)
    items = [found[p][1] for p in patterns]

    def search(texts: pa.Array):
        data, starts, _, before = normalised(texts)
        at, which = engine.find(data)
        first = np.searchsorted(starts, at)
        return before, first, first + n_words[which], np.searchsorted(before, first, "right") - 1, which

    return search, items


def _result(ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([common.sha(",".join(x).encode()) for x in items]),
            pa.array(n_hit > 0),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def _items_by_text(doc: np.ndarray, which: np.ndarray, items: list[list[str]], n: int) -> list[list[str]]:
    out: list[set] = [set() for _ in range(n)]
    for pair in np.unique(np.stack([doc, which]), axis=1).T if len(doc) else ():
        out[pair[0]].update(items[pair[1]])
    return [sorted(x) for x in out]


def _scan(found):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, items = _search(found)
        for batch, texts in common.chunks(batches):
            before, first, after, doc, which = search(texts)
            hit = np.concatenate([[0], np.cumsum(common.covered(first, after, int(before[-1])))])[before]
            yield _result(batch.column(0), np.diff(before), np.diff(hit), _items_by_text(doc, which, items, len(texts)))

    return scan


def _scan_part(found):
    """The occurrences of one block of a large benchmark: word ranges and items of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, items = _search(found)
        for batch, texts in common.chunks(batches):
            before, first, after, doc, which = search(texts)
            order = np.lexsort((first, doc))
            spans = np.stack([first[order] - before[doc[order]], after[order] - before[doc[order]]], 1).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(np.diff(before), pa.int64()),
                    common.lists(pa.array(spans, pa.int64()), 2 * np.bincount(doc, minlength=len(texts))),
                    pa.array(_items_by_text(doc, which, items, len(texts)), pa.list_(pa.string())),
                ],
                ["doc_id", "row", "n_words", "spans", "items"],
            )

    return scan


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        n_hit = []
        for row in rows:
            spans = np.array([x for part in row["spans"] for x in part], np.int64).reshape(-1, 2)
            n_hit.append(int(common.covered(spans[:, 0], spans[:, 1], row["n_words"]).sum()))
        items = [sorted({x for part in row["items"] for x in part}) for row in rows]
        n_words = np.array([row["n_words"] for row in rows], np.int64)
        yield _result(batch.column(0), n_words, np.array(n_hit, np.int64), items)


def hits(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    The benchmark is cut into blocks of about ``block_bytes`` of text by a hash of its rows; each block is fetched and sent
    to the tasks on its own. With one block (a benchmark of test strings is far smaller) documents are read once and
    nothing is shuffled; with more, each document's word ranges of all blocks are brought together.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text is not null")
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    n_blocks = -(-max(total, 1) // block_bytes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_blocks == 1:
        rows = items.collect()
        return docs.mapInArrow(_scan(windows([r[0] for r in rows], [r[1] for r in rows])), RESULT)
    # a row is its doc_id and text; rows that are equal in both are counted and given back as many times
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    parts = None
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n_blocks)) == block).collect()
        found = windows([r[0] for r in rows], [r[1] for r in rows])
        part = keyed.mapInArrow(_scan_part(found), "doc_id long, row long, n_words long, spans array<long>, items array<string>")
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy("doc_id", "row", "n_words").agg(
        F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"), F.count("*").alias("n")
    )
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / n_blocks).cast("int")))).drop("n", "copy", "row")
    return each.select("doc_id", "n_words", "spans", "items").mapInArrow(_merge, RESULT)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    total = benchmark.where("text is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-max(total, 1) // BLOCK_BYTES)
    kept = documents
    for block in range(n_blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).select("item_id", "text").collect()
        found = windows([r[0] for r in rows], [r[1] for r in rows])

        def keep(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            search, _ = _search(found)
            for batch, texts in common.chunks(batches):
                doc = search(texts)[3]
                yield batch.filter(pa.array(np.bincount(doc, minlength=len(texts)) == 0))

        kept = kept.mapInArrow(keep, documents.schema)
    return kept
