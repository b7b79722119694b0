"""Substring dedup on words: every word in a 13-word window that an earlier document has is removed.

Words are runs of bytes other than space and tab to carriage return, taken unchanged. The work:

1. Each text gives the anchors of its windows (:mod:`postwatch.llm.anchors`); anchors of one text only are done with.
2. Around the others the texts are cut into pieces of consecutive windows with one anchor. Pieces are dealt by anchor, so
   all places of a window meet.
3. A task takes anchors in turn until it holds ``SHARD_WORDS`` words of pieces: it confirms the windows of at least two
   documents, compiles an Aho-Corasick automaton from them (a word is one symbol), and streams all the shard's pieces
   through it. Every place found whose window began in a smaller doc_id is removed.
4. An anchor with more than ``HOT`` places is dealt into salted parts; its windows are confirmed by a grouping over all
   places beforehand, and the confirmed ones go to each part. No place is dropped.

Copies of a text hold nothing new: all their words go if they have a window at all, without a search.

Defined cases: a null text has no words; a null doc_id counts as smaller than any other; rows of one doc_id never remove
each other's words, so repeated rows repeat in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import anchors, common

WINDOW = 13
GRAM = 5
HOT = 2000
SHARD_WORDS = 1 << 18
LONGEST_RUN = 64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_SUMMARY = "id long, x long, cls binary, n_words long, whole string, anchors array<long>"
_PIECES = "id long, x long, m long, salts int, start int, body string"


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (a line feed, then words each followed by one more byte, for each text), word starts and ends, words before each text."""
    data, marks = common.separated(texts)
    is_word = _IS_WORD[data]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    keep[marks] = True
    data[~is_word] = 32
    data[marks] = 10
    data = data[keep]
    starts, ends = common.words_of(data, _IS_WORD[data])
    return data, starts, ends, np.searchsorted(starts, np.flatnonzero(data == 10))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    inside = common.covered(starts[kept], ends[kept] + 1, len(data))
    body = data[inside]
    body[body == 10] = 32
    body = body.tobytes()
    upto = np.concatenate([[0], np.cumsum(np.where(kept, ends - starts + 1, 0))])[before]
    return [body[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


def _windows(data, starts, ends, before):
    """Least gram hash of each window start, and which starts have a whole window, and the text of each word."""
    n = len(starts)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    least = common.sliding_min(common.gram_hashes(common.span_hashes(data, starts, ends), GRAM), WINDOW - GRAM + 1)
    valid = np.zeros(n, bool)
    if n >= WINDOW:
        valid[: n - WINDOW + 1] = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    return np.concatenate([least, np.zeros(n - len(least), np.uint64)]), valid, doc


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        data, starts, ends, before = split(texts)
        least, valid, doc = _windows(data, starts, ends, before)
        first, _ = anchors.runs(least, valid, doc, 1 << 40)
        value, text = least[first], doc[first]
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
        whole = [common.sha(x) for x in joined(data, starts, ends, before, np.ones(len(starts), bool))]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(3)),
                pa.array(np.diff(before), pa.int64()),
                pa.array(whole, pa.string()),
                common.lists(pa.array(value.view(np.int64)), np.bincount(text, minlength=len(texts))),
            ],
            ["id", "x", "cls", "n_words", "whole", "anchors"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts around their recurring anchors."""
    for batch, texts in common.chunks(batches):
        data, starts, ends, before = split(texts)
        least, valid, doc = _windows(data, starts, ends, before)
        known, salts = anchors.wanted(batch.column(batch.schema.get_field_index("marks")))
        first, last = anchors.runs(least, valid, doc, LONGEST_RUN)
        at, here = anchors.among(known, least[first], doc[first])
        at, first, last = at[here], first[here], last[here]
        text = doc[first]
        body = data.tobytes()
        pieces = [body[a:b] for a, b in zip(starts[first].tolist(), ends[last + WINDOW - 2].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(text)),
                batch.column(1).take(pa.array(text)),
                pa.array(least[first].view(np.int64)),
                pa.array(salts[at], pa.int32()),
                pa.array((first - before[text]).astype(np.int32)),
                pa.array(pieces, pa.binary()).cast(pa.string()),
            ],
            ["id", "x", "m", "salts", "start", "body"],
        )


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, salts, id, body of each window of the pieces; a batch names a window once for each anchor, with its least and greatest id."""
    for batch in batches:
        found: dict[tuple, list] = {}
        ids, marks, salts, bodies = (batch.column(k).to_pylist() for k in (0, 2, 3, 5))
        for key, m, n, body in zip(ids, marks, salts, bodies):
            words = body.split(" ")
            for at in range(len(words) - WINDOW + 1):
                seen = found.setdefault((m, n, " ".join(words[at : at + WINDOW])), [key, key])
                seen[0], seen[1] = min(seen[0], key), max(seen[1], key)
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["m", "salts", "body", "low", "high"],
        )


def _symbol(k: int) -> str:
    """The k-th word of a shard as one character (surrogates are left out)."""
    return chr(k + 1 if k < 0xD000 else k + 0x1001)


class Shard:
    """The windows of some anchors: confirmed, compiled, and found again in every piece."""

    def __init__(self):
        self.words: dict[str, str] = {}
        self.confirmed: dict[str, int] = {}
        self.pieces: dict[str, list[tuple[int, int, int]]] = {}
        self.n_words = 0

    def _spell(self, body: str) -> str:
        return "".join([self.words.setdefault(w, _symbol(len(self.words))) for w in body.split(" ")])

    def add_confirmed(self, body: str, first: int) -> None:
        self.confirmed[self._spell(body)] = first
        self.n_words += WINDOW

    def add_piece(self, body: str, place: tuple[int, int, int]) -> None:
        spelled = self._spell(body)
        places = self.pieces.get(spelled)
        if places is None:
            self.pieces[spelled] = places = []
            self.n_words += len(spelled)
        places.append(place)
        self.n_words += 1

    def _confirm(self) -> None:
        """Windows of at least two documents, with the least id that has them."""
        seen: dict[str, tuple[int, int]] = {}
        for spelled, places in self.pieces.items():
            low, high = min(places)[0], max(places)[0]
            for at in range(len(spelled) - WINDOW + 1):
                window = spelled[at : at + WINDOW]
                was = seen.get(window)
                seen[window] = (low, high) if was is None else (min(was[0], low), max(was[1], high))
        for window, (low, high) in seen.items():
            if low < high:
                self.confirmed[window] = min(low, self.confirmed.get(window, low))

    def hits(self) -> Iterator[tuple[int, int, list[int]]]:
        """id, x, and the first words (of the text) of windows to remove."""
        self._confirm()
        if not self.confirmed:
            return
        automaton = ahocorasick.Automaton()
        for window, first in self.confirmed.items():
            automaton.add_word(window, first)
        automaton.make_automaton()
        for spelled, places in self.pieces.items():
            found = [(end - WINDOW + 1, first) for end, first in automaton.iter(spelled)]
            for key, x, start in places:
                gone = [start + at for at, first in found if first < key]
                if gone:
                    yield key, x, gone


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, salt and kind (0: a confirmed window, 1: a piece) to windows that are to be removed."""

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        keys, xs, starts = [], [], []
        hits = shard.hits()
        while True:
            rows = [row for _, row in zip(range(20_000), hits)]
            if not rows:
                return
            keys, xs, starts = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(xs, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["id", "x", "starts"]
            )

    shard, last = Shard(), None
    for batch in batches:
        for m, part, kind, key, x, start, body in zip(*(column.to_pylist() for column in batch.columns)):
            if (m, part) != last and shard.n_words >= SHARD_WORDS:
                yield from out(shard)
                shard = Shard()
            last = (m, part)
            if kind:
                shard.add_piece(body, (key, x, start))
            else:
                shard.add_confirmed(body, key)
    yield from out(shard)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        data, starts, ends, before = split(texts)
        first = anchors.nested(batch.column(batch.schema.get_field_index("starts")), before[:-1])
        dropped = common.covered(first, first + WINDOW, len(starts))
        upto = np.concatenate([[0], np.cumsum(dropped)])[before]
        kept = joined(data, starts, ends, before, ~dropped)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(before), pa.int64()),
                pa.array(np.diff(upto), pa.int64()),
                pa.array([common.sha(x) for x in kept]),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _places(pieces: DataFrame, any_hot: bool) -> DataFrame:
    """Everything the shards need, dealt by anchor and salt; an anchor's confirmed windows come before its pieces."""
    whole = F.lit(0)
    salt = F.when(F.col("salts") > 0, F.pmod(F.xxhash64("id", "x", "start"), F.greatest("salts", F.lit(1)))).otherwise(whole)
    rows = pieces.select("m", salt.cast("int").alias("part"), F.lit(1).alias("kind"), "id", "x", "start", "body")
    if any_hot:
        windows = pieces.where("salts > 0").mapInArrow(_all_windows, "m long, salts int, body string, low long, high long")
        confirmed = windows.groupBy("m", "salts", "body").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        rows = rows.unionAll(
            confirmed.select(
                "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), F.lit(0).alias("kind"),
                F.col("low").alias("id"), F.lit(0).cast("long").alias("x"), F.lit(0).alias("start"), "body",
            )
        )
    return rows.repartition("m", "part").sortWithinPartitions("m", "part", "kind")


def remove_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept_sha256, and kept where words were removed (else null)."""
    docs = anchors.keyed(documents)
    summary = common.staged(docs.mapInArrow(_summarise, _SUMMARY), "phrases")
    classes = anchors.classes(summary)
    firsts = summary.join(classes, "cls").where("id = first").select("id", "x").distinct()
    found = common.staged(anchors.recurring(summary), "phrases")
    marked = docs.drop("cls").join(anchors.candidates(summary, found, firsts, hot), ["id", "x"])
    pieces = common.staged(marked.mapInArrow(_cut, _PIECES), "phrases")
    any_hot = not found.where(F.col("n") > hot).isEmpty()
    hits = common.staged(_places(pieces, any_hot).mapInArrow(_scan, "id long, x long, starts array<int>"), "phrases")

    gone = hits.groupBy("id", "x").agg(F.collect_list("starts").alias("starts"))
    cut = docs.drop("cls").join(gone, ["id", "x"]).mapInArrow(_remove, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    rest = (
        summary.join(hits.select("id", "x").distinct(), ["id", "x"], "left_anti")
        .join(classes, "cls")
        .select(
            "id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
            F.when(copy, F.lit("")).alias("kept"),
        )
    )
    return cut.unionAll(rest).select(anchors.public_id(), "n_words", "n_removed", "kept_sha256", "kept")
