"""Substring dedup on bytes: every byte covered by a 400-byte string that also starts anywhere else is removed.

Texts are UTF-8 bytes; matches stay inside one text, both places count (also two in one text, and overlapping ones). The work:

1. Each text gives the anchors of its 400-byte windows (:mod:`postwatch.llm.anchors`, grams of 64 bytes). An anchor that
   occurs once in all texts is done with.
2. Around the others the texts are cut into pieces of up to 400 consecutive windows with one anchor; equal windows lie in
   pieces of one anchor. Anchors are told apart by value, not by place: text of a short period is one stretch, though its
   anchor moves along, and such a piece may repeat in itself (``inner``). Equal pieces are counted and kept once: a piece that
   stands in several places repeats as a whole.
3. Distinct pieces are dealt by anchor. A task takes anchors in turn until it holds ``SHARD_BYTES`` of pieces. It sorts their
   suffixes, takes the Burrows-Wheeler transform, and derives common prefixes by increasing value: breadth-first backward
   extension of intervals, level by level, stopping at 400. Boundaries that are still open then join suffixes with 400
   bytes in common. What is found goes back to all places of each piece.
4. An anchor with more than ``HOT`` distinct pieces (a passage that very many texts share gives one for each way a text goes
   on) is cut further by anchors of longer grams, ``LEVELS`` in turn, and only what still recurs goes on. Grams of 400 bytes
   are the windows themselves, so the last level always ends.

A text that occurs in several rows needs no search itself: it goes whole if it has a window.

Defined cases: a null text is empty; a null doc_id is an id like others; rows are judged one by one, so a repeated row is a
second place of everything in it. A long text of a short period takes about twice its bytes in pieces, most of them equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import anchors, common

LENGTH = 400
GRAM = 64
HOT = 2000
LEVELS = (256, 384, 400)
SHARD_BYTES = 1 << 20
BATCH_BYTES = 32 << 20

_SUMMARY = "id long, x long, cls binary, n_bytes long, whole string, anchors array<struct<m: long, x: long>>"
_PIECES = "id long, x long, m long, start long, inner boolean, body binary"
_RANGES = "m long, b long, starts array<long>, ends array<long>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _ordered(rank: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of ranks, and the pairs in it; with the place inside the sorted value while three fit into one."""
    n = len(rank)
    bits = int(n + 1).bit_length()
    if 3 * bits > 64:
        key = (rank.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        order = np.argsort(key)
        return order, key[order]
    low = np.uint64(bits)
    packed = (((rank.astype(np.uint64) << low) | follow.astype(np.uint64)) << low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> low


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of the text begin a string of ``length`` symbols that begins elsewhere too, inside the pieces.

    ``text`` holds the pieces one after the other, each closed by one place whose value is ignored; ``ends`` are those places.
    """
    n, n_ends = len(text), len(ends)
    symbols = text.astype(np.uint64) + np.uint64(n_ends + 1)
    symbols[ends] = np.arange(1, n_ends + 1, dtype=np.uint64)  # each end differs from all else
    bits = int(n_ends + 257).bit_length()
    depth = 64 // bits
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key <<= np.uint64(bits)
        key[: n - j] |= symbols[j:]
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    # boundaries whose common prefix is known from the first symbols; intervals of that level go on from there
    prefix = np.full(n, depth, np.int64)
    differ = ranked[1:] ^ ranked[:-1]
    for j in range(depth):
        prefix[1:][(differ >> np.uint64(bits * (depth - 1 - j))) == 0] = j + 1
        if j == 0:
            prefix[1:][(differ >> np.uint64(bits * (depth - 1))) != 0] = 0
    prefix[0] = 0
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    reach = depth
    while reach < length and not new.all():
        follow = np.full(n, 0, np.int64)
        follow[: n - reach] = rank[reach:] + 1
        order, ranked = _ordered(rank, follow)
        new[1:] = ranked[1:] != ranked[:-1]
        rank[order] = np.cumsum(new) - 1
        reach *= 2

    # the transform: the symbol before each suffix, and where the suffix that begins with it stands
    before = symbols[order - 1].astype(np.int64)
    inverse = np.argsort(before.astype(np.uint16) if n_ends + 257 < 1 << 16 else before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[inverse] = np.arange(n)
    sorted_before = before[inverse]
    opens = np.ones(n, bool)
    opens[1:] = sorted_before[1:] != sorted_before[:-1]  # first suffix of each symbol

    is_open = np.ones(n + 1, bool)  # is_open[r]: the common prefix of suffixes r - 1 and r is not known yet
    is_open[0] = is_open[n] = False
    is_open[:n][prefix < depth] = False
    edges = np.append(np.flatnonzero(prefix < depth), n)
    high = edges[1:][np.append(prefix[edges[1:-1]] == depth - 1, True)]
    low = edges[np.searchsorted(edges, high) - 1]
    for level in range(depth, length):
        if not len(low):
            break
        size = high - low
        single = size == 1
        left = lf[low[single]]
        lows, highs = [left], [left + 1]
        if not single.all():
            lo, hi = low[~single], high[~single]
            size = hi - lo
            which = np.repeat(np.arange(len(lo)), size)
            at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            to = lf[at]
            first = opens[to] | (inverse[to - 1] < lo[which])
            after = np.minimum(to + 1, n - 1)
            last = (to == n - 1) | opens[after] | (inverse[after] >= hi[which])
            lows.append(np.sort(which[first] * n + to[first]) % n)
            highs.append(np.sort(which[last] * n + to[last]) % n + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = is_open[high]
        low, high = low[fresh], high[fresh]
        is_open[high] = False
    shared = np.flatnonzero(is_open[:n])
    out = np.zeros(n, bool)
    out[order[shared]] = True
    out[order[shared - 1]] = True
    return out


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes, put together from hashes of widths that are powers of two."""
    parts, h, width, power = [], common._BYTES[data], 1, 0x5851F42D4C957F2D
    while width <= gram:
        if gram & width:
            parts.append((h, width))
        h = h[: len(h) - width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
        power = power * power % (1 << 64)
        width *= 2
    out, at = np.zeros(max(0, len(data) - gram + 1), np.uint64), 0
    for h, width in parts:
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[at : at + len(out)]
        at += width
    return common.mixed(out)


def _windows(data: np.ndarray, marks: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; for each window the place of its anchor (the last of the least grams), whether it is whole, its text."""
    grams = _gram_hashes(data, gram)
    place = np.uint64(0xFFFFFFFF)
    keys = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
    at = (place - (common.sliding_min(keys, LENGTH - gram + 1) & place)).astype(np.int64)
    doc = np.repeat(np.arange(len(marks) - 1), np.diff(marks))[: len(at)]
    here = np.arange(len(at))
    return grams, at, (here > marks[doc]) & (here <= marks[1:][doc] - LENGTH), doc


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        data, marks = common.separated(texts)
        grams, anchor, valid, doc = _windows(data, marks)
        first, last = anchors.runs(grams[anchor], valid, doc, LENGTH)
        first = np.append(first, first[anchor[first] != anchor[last - 1]])  # may repeat in itself: counts as two places
        value, text = grams[anchor[first]].view(np.int64), doc[first]
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        nth = np.zeros(len(value), np.int64)
        nth[1:] = (value[1:] == value[:-1]) & (text[1:] == text[:-1])  # a second place in one text counts as another text
        own = batch.column(1).to_numpy()[text] if len(text) else np.zeros(0, np.int64)
        body = data.tobytes()
        spans = list(zip((marks[:-1] + 1).tolist(), marks[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(3)),
                pa.array(np.diff(marks) - 1, pa.int64()),
                pa.array([common.sha(body[a:b]) for a, b in spans], pa.string()),
                common.lists(
                    pa.StructArray.from_arrays([pa.array(value), pa.array(own ^ nth)], ["m", "x"]), np.bincount(text, minlength=len(texts))
                ),
            ],
            ["id", "x", "cls", "n_bytes", "whole", "anchors"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        data, marks = common.separated(texts)
        grams, anchor, valid, doc = _windows(data, marks)
        known, _ = anchors.wanted(batch.column(batch.schema.get_field_index("marks")))
        first, last = anchors.runs(grams[anchor], valid, doc, LENGTH)
        _, here = anchors.among(known, grams[anchor[first]], doc[first])
        body, n_bytes = data.tobytes(), np.cumsum(last[here] - first[here] + LENGTH - 1)
        cuts = np.searchsorted(n_bytes, np.arange(BATCH_BYTES, n_bytes[-1] if len(n_bytes) else 0, BATCH_BYTES))
        for start, end in zip(np.split(first[here], cuts), np.split(last[here], cuts)):
            text = doc[start]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)),
                    batch.column(1).take(pa.array(text)),
                    pa.array(grams[anchor[start]].view(np.int64)),
                    pa.array(start - marks[text] - 1),
                    pa.array(anchor[start] != anchor[end - 1]),
                    pa.array([body[a : b + LENGTH - 1] for a, b in zip(start.tolist(), end.tolist())], pa.binary()),
                ],
                ["id", "x", "m", "start", "inner", "body"],
            )


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _finer(gram: int):
    """m, b, and for stretches of windows with one anchor of longer grams: its hash joined with m, first byte, length, inner.

    Where a gram is the window each one is a stretch, so that all pieces of an anchor are equal.
    """
    longest = 1 if gram == LENGTH else LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(3).cast(pa.large_binary())
            data, marks = common.separated(bodies)
            grams, anchor, valid, doc = _windows(data, marks, gram)
            first, last = anchors.runs(grams[anchor], valid, doc, longest)
            text = doc[first]
            above = batch.column(0).to_numpy().view(np.uint64)[text]
            finer = common.mixed(grams[anchor[first]] + common.mixed(above.copy()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(text)) for k in range(2)),
                    pa.array(finer.view(np.int64)),
                    pa.array(first - marks[text] - 1),
                    pa.array(last - first + LENGTH - 1),
                    pa.array(anchor[first] != anchor[last - 1]),
                ],
                ["m", "b", "finer", "at", "size", "inner"],
            )

    return run


class Shard:
    """The distinct pieces of some anchors."""

    def __init__(self):
        self.pieces: list[tuple[int, int, int]] = []
        self.bodies: list[bytes] = []
        self.n_bytes = 0

    def add(self, m: int, b: int, n: int, body: bytes) -> None:
        self.pieces.append((m, b, n))
        self.bodies.append(body)
        self.n_bytes += len(body) + 1

    def hits(self) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """m, b, and the ranges of bytes to remove, of each piece that has any and stands in one place only."""
        if not self.bodies:
            return
        text = np.frombuffer(b"\0".join(self.bodies) + b"\0", np.uint8)
        closes = np.cumsum([len(b) + 1 for b in self.bodies]) - 1
        repeated = repeated_starts(text, closes)
        at = 0
        for (m, b, n), body in zip(self.pieces, self.bodies):
            found = _stretches(repeated[at : at + len(body)]) if n == 1 else []
            at += len(body) + 1
            if found:
                yield m, b, [first for first, _ in found], [last + LENGTH - 1 for _, last in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        hits = shard.hits()
        while rows := [row for _, row in zip(range(20_000), hits)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["m", "b", "starts", "ends"])

    shard, last = Shard(), None
    for batch in batches:
        for m, b, n, body in zip(*(column.to_pylist() for column in batch.columns)):
            if m != last and shard.n_bytes >= SHARD_BYTES:
                yield from out(shard)
                shard = Shard()
            last = m
            shard.add(m, b, n, body)
    yield from out(shard)


def _repeats(pieces: DataFrame, hot: int, levels: tuple[int, ...]) -> DataFrame:
    """m, b, starts, ends: the ranges to remove of distinct pieces (m, b: a hash of the body, n: places, inner, body)."""
    kinds = pieces.groupBy("m").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner")).where("kinds > 1 or inner")
    kinds = common.staged(kinds.select("m", "kinds"), "substrings")
    whole = pieces.where("n > 1").select(
        "m", "b", F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.octet_length("body").cast("long")).alias("ends")
    )
    dealt = pieces.join(kinds.where(F.col("kinds") <= hot), "m").select("m", "b", "n", "body").repartition("m").sortWithinPartitions("m")
    ranges = whole.unionAll(dealt.mapInArrow(_scan, _RANGES))
    if kinds.where(F.col("kinds") > hot).isEmpty():
        return ranges
    many = pieces.join(kinds.where(F.col("kinds") > hot), "m", "left_semi").select("m", "b", "n", "body")
    finer = common.staged(many.mapInArrow(_finer(levels[0]), "m long, b long, finer long, at long, size long, inner boolean"), "substrings")
    shared = finer.groupBy("finer").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("finer")
    parts = finer.join(shared, "finer").join(many.drop("n"), ["m", "b"])
    body = F.substring("body", F.col("at").cast("int") + 1, F.col("size").cast("int"))
    parts = common.staged(parts.select("m", "b", "finer", "at", "inner", body.alias("body")), "substrings")
    below = _repeats(_distinct(parts.select(F.col("finer").alias("m"), "inner", "body")), hot, levels[1:])
    places = parts.select("m", "b", "finer", "at", F.xxhash64("body").alias("part"))
    found = places.join(below.select(F.col("m").alias("finer"), F.col("b").alias("part"), "starts", "ends"), ["finer", "part"])
    moved = [F.transform(c, lambda v: v + F.col("at")).alias(c) for c in ("starts", "ends")]
    return ranges.unionAll(found.select("m", "b", *moved))


def _distinct(pieces: DataFrame) -> DataFrame:
    """m, b, n, inner, body of the distinct pieces (m, inner, body); inner follows from the body."""
    counted = pieces.groupBy("m", "body").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
    return common.staged(counted.select("m", F.xxhash64("body").alias("b"), "n", "inner", "body"), "substrings")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        data, marks = common.separated(texts)
        starts, ends = (anchors.nested(batch.column(batch.schema.get_field_index(name)), marks[:-1] + 1) for name in ("starts", "ends"))
        gone = common.covered(starts, ends, len(data))
        bodies, removed, spans = [], [], []
        for a, b in zip((marks[:-1] + 1).tolist(), marks[1:].tolist()):
            bodies.append(data[a:b][~gone[a:b]].tobytes())
            removed.append(b - a - len(bodies[-1]))
            spans.append(len(_stretches(gone[a:b])))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(marks) - 1, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([common.sha(x) for x in bodies]),
                pa.array(bodies, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept where bytes were removed (else null)."""
    docs = anchors.keyed(documents)
    summary = common.staged(docs.mapInArrow(_summarise, _SUMMARY), "substrings")
    classes = anchors.classes(summary)
    firsts = summary.join(classes, "cls").where("id = first").select("id", "x").distinct()
    found = common.staged(anchors.recurring(summary), "substrings")
    marked = docs.drop("cls").join(anchors.candidates(summary, found, firsts, hot), ["id", "x"])
    pieces = common.staged(marked.mapInArrow(_cut, _PIECES), "substrings")
    ranges = common.staged(_repeats(_distinct(pieces.select("m", "inner", "body")), hot, LEVELS), "substrings")
    places = pieces.select("id", "x", "m", "start", F.xxhash64("body").alias("b"))
    moved = [F.transform(c, lambda v: v + F.col("start")).alias(c) for c in ("starts", "ends")]
    hits = common.staged(places.join(ranges, ["m", "b"]).select("id", "x", *moved), "substrings")

    gone = hits.groupBy("id", "x").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    single = gone.join(summary.join(classes.where("copies = 1"), "cls", "left_semi"), ["id", "x"], "left_semi")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = docs.drop("cls").join(single, ["id", "x"]).mapInArrow(_remove, schema)
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    rest = (
        summary.join(classes, "cls")
        .join(hits.select("id", "x", F.lit(True).alias("hit")).distinct(), ["id", "x"], "left")
        .where("hit is null or copies > 1")
        .select(
            "id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(0).alias("n_removed"),
            F.when(copy, 1).otherwise(0).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
            F.when(copy, F.lit("")).cast("binary").alias("kept"),
        )
    )
    return cut.unionAll(rest).select(anchors.public_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
