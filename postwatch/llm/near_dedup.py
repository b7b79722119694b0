"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words (runs of bytes other than ASCII white space); a text of one to four words is one shingle. Its weight
is ``(1 + ln tf) * (1 + ln(N / df) / ln N)``: df is the number of documents with the shingle, counted for each
shingle hash over all documents, and the second factor lies between 1 and 2, so that what many documents share counts less
but a large group of near copies stays together. Each of ``SAMPLES`` samples draws one shingle and weight level of a text
with the probability of the weighted Jaccard similarity to agree; the draws of a shingle come from tables of random numbers
picked by the shingle's hash. Texts that agree in all samples of a band are candidates, and links between candidates are
verified with the weights themselves, ``THRESHOLD`` or more (:mod:`postwatch.llm.linking`).

Counting: documents are dealt into groups of about ``GROUP`` bytes; a group sends each of its shingles once, packed by ranges of
hashes as small differences, to the task of the range, which sends the totals back in the same order and without the hashes. So a
shingle of all documents is no more than one entry per group, and no table is larger than a range's or a group's share.

Copies of a text are one member. The similarity 0.8 is missed by all ``BANDS`` bands with a probability of 0.0003.

Defined cases: a null text is empty; texts without words are alike only to each other; a null doc_id counts as smaller than any
other; the class id is the least doc_id of the group; rows that are equal in doc_id and text are one document of which one row stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import anchors, common, linking, minhash

THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
GROUP, RANGE = 4 << 20, 16 << 20
_TABLE = 1 << 14
_TEXTS, _SHINGLES = 1 << 19, 1 << 15  # bytes of text and shingles worked on at once: what is made of them stays in a core's cache
_LEVELS = 4  # tables of :meth:`Draws.of` that are kept, of 8 MB each
_SOME = 16  # texts of a component from which their keys are worked out
_MARGIN = 1e-6  # more than rounding makes of a bound
_WORDLESS = -1  # the band of texts without words


class Draws:
    """Random numbers of the sampling, one table per sample: r and ln c are of Gamma(2, 1), beta is uniform."""

    def __init__(self):
        unit = (common.random_bits(21, 5 * SAMPLES * _TABLE) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-16
        u = unit.reshape(5, SAMPLES, _TABLE)
        self.r = -np.log(u[0] * u[1]).astype(np.float32) + np.float32(1e-6)
        self.per_r = 1 / self.r
        self.beta = u[4].astype(np.float32)
        self.rest = (np.log(-np.log(u[2] * u[3])) + self.r * (self.beta - 1)).astype(np.float32)  # ln c - r (1 - beta)
        self.turn = common.random_bits(22, SAMPLES) | np.uint64(1)
        self._known: dict[float, np.ndarray] = {}

    def values(self, k: int, at: np.ndarray, level: np.ndarray | np.float32) -> np.ndarray:
        """Of sample k, what is least at the shingle that is drawn (ln c - r (t - beta + 1)); at: places in the tables."""
        r = self.r[k][at]
        return self.rest[k][at] - r * np.floor(level * self.per_r[k][at] + self.beta[k][at])

    def of(self, level: np.float32) -> np.ndarray:
        """For each sample, :meth:`values` at all places for one level, as :func:`ordered`; many shingles share a weight."""
        if float(level) not in self._known:
            if len(self._known) == _LEVELS:
                del self._known[next(iter(self._known))]
            self._known[float(level)] = np.stack([ordered(self.values(k, np.arange(_TABLE), level)) for k in range(SAMPLES)])
        return self._known[float(level)]


def ordered(values: np.ndarray) -> np.ndarray:
    """The float32 values as numbers of 64 bits in the same order, of which the low 32 bits are 0."""
    bits = (values + np.float32(0)).view(np.uint32)  # -0 as 0
    return (bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))).astype(np.uint64) << np.uint64(32)


_draws: list[Draws] = []


def draws() -> Draws:
    if not _draws:
        _draws.append(Draws())
    return _draws[0]


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order: text, shingle hash, occurrences."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for at, upto in common.cuts(common.flat(texts)[1], _TEXTS):
        values, counts, _, _ = minhash.shingles(*common.separated(texts[at:upto], 32))
        ends = np.cumsum(counts)
        for low, high in zip(ends - counts, ends):
            values[low:high].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[ends[counts > 0] - counts[counts > 0]] = True
        first = np.flatnonzero(new)
        found.append((np.repeat(np.arange(at, upto), counts)[first], values[first], np.diff(np.append(first, len(values)))))
    return tuple(map(np.concatenate, zip(*found)))


def planes(values: np.ndarray) -> bytes:
    """How many bytes the largest value takes; then all first bytes of the values, all second ones and so on: mostly zeros compress to nothing."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T[:width]).tobytes()


def from_planes(body: bytes, dtype: str) -> np.ndarray:
    kept = np.frombuffer(body, np.uint8, offset=1).reshape(body[0], -1)
    whole = np.zeros((kept.shape[1], np.dtype(dtype).itemsize), np.uint8)
    whole[:, : len(kept)] = kept.T
    return whole.view(dtype).ravel()


def counts(n: np.ndarray) -> bytes:
    """Counts as planes; nothing if all are 1."""
    return planes(n.astype("<u4")) if (n > 1).any() else b""


def from_counts(body: bytes, k: int) -> np.ndarray:
    return from_planes(body, "<u4") if body else np.ones(k, np.uint32)


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as the planes of their differences."""
    return planes((np.diff(values, prepend=np.uint64(0)) if len(values) else values).astype("<u8"))


def unpacked(body: bytes) -> np.ndarray:
    return np.cumsum(from_planes(body, "<u8"), dtype=np.uint64)


def _parts(values: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges in which any of the ascending values lie, and where each one's begin (one more than ranges)."""
    part = ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.diff(part, prepend=np.int32(-1)))
    return part[first], np.append(first, len(values))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, the first column: all rows of a group at once, about GROUP bytes of text."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        group = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for at, upto in zip(cuts, cuts[1:]):
            if upto == at:
                continue
            if held and group[at] != last:
                yield pa.concat_batches(held)
                held = []
            last = group[at]
            held.append(batch.slice(at, upto - at))
    if held:
        yield pa.concat_batches(held)


def _hashes(ranges: int):
    """Per group of documents and range of hashes: the distinct shingles in ascending order, and how many of its documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            values, n = np.unique(counted(common.utf8(rows.column(1)))[1], return_counts=True)
            some, ends = _parts(values, ranges)
            cuts, group = list(zip(ends, ends[1:])), pa.array(np.full(len(some), rows.column(0)[0].as_py()), pa.int64())
            bodies = [pa.array([packed(values[a:b]) for a, b in cuts], pa.binary()), pa.array([counts(n[a:b]) for a, b in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), group, *bodies], ["part", "g", "h", "n"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range; per group: in how many documents each of its shingles is, in the order in which it sent them."""

    def added(part: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        lists = [unpacked(h) for _, h, _ in held]
        own = [from_counts(n, len(values)) for (_, _, n), values in zip(held, lists)]
        every = np.sort(np.concatenate(lists))
        again = every[1:][every[1:] == every[:-1]]  # of several groups
        again = again[np.diff(again, prepend=again[:1] + np.uint64(1)) != 0]
        del every
        places = [np.searchsorted(again, values) for values in lists]
        hits = [np.flatnonzero(again[np.minimum(at, len(again) - 1)] == values) if len(again) else at[:0] for at, values in zip(places, lists)]
        places = [at[hit] for at, hit in zip(places, hits)]
        n = np.bincount(np.concatenate(places), np.concatenate([c[hit] for c, hit in zip(own, hits)]), len(again)).astype("<u4")
        for total, at, hit in zip(own, places, hits):
            total[hit] = n[at]
        for at in range(0, len(held), common.BATCH_ROWS):
            told = own[at : at + common.BATCH_ROWS]
            groups, parts = pa.array([g for g, _, _ in held[at : at + len(told)]], pa.int64()), pa.array([part] * len(told), pa.int32())
            bodies = [pa.array([len(total) for total in told], pa.int32()), pa.array([counts(total) for total in told], pa.binary())]
            yield pa.RecordBatch.from_arrays([groups, parts, *bodies], ["g", "part", "k", "n"])

    last, held = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != last and held:
                yield from added(last, held)
                held = []
            last = part
            held.append(row)
    if held:
        yield from added(last, held)


_WITH_DF = "id long, x long, cls binary, df binary, bands array<long>"


def _with_frequencies(n_docs: int):
    """Rows sorted by group and part, the totals of its shingles first: each document's df of its distinct shingles, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            own = rows.column(1).is_null().to_numpy(zero_copy_only=False)
            told, docs = rows.filter(pa.array(~own)), rows.filter(pa.array(own))
            totals = [from_counts(n, k) for k, n in zip(*(told.column(c).to_pylist() for c in (6, 7)))]
            total = np.concatenate([np.zeros(0, np.uint32), *totals])
            doc, values, tf = counted(common.utf8(docs.column(5)))
            df = total[np.unique(values, return_inverse=True)[1]]
            ends = np.searchsorted(doc, np.arange(len(docs) + 1))
            has, keys = drawn(doc, values, weighted(tf, idf_table(df, n_docs)))
            for at in range(0, len(docs), common.BATCH_ROWS):
                upto = min(at + common.BATCH_ROWS, len(docs))
                some = slice(*np.searchsorted(has, [at, upto]))
                listed = np.ones(upto - at, np.int64)
                listed[has[some] - at] = BANDS
                flat = np.full(listed.sum(), _WORDLESS, np.int64)
                flat[np.repeat(listed == BANDS, listed)] = keys[some].ravel().view(np.int64)
                bodies = pa.array([df[a:b].astype("<u4").tobytes() for a, b in zip(ends[at:upto], ends[at + 1 : upto + 1])], pa.binary())
                columns = [*(docs.column(k).slice(at, upto - at) for k in (2, 3, 4)), bodies, common.lists(pa.array(flat), listed)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "x", "cls", "df", "bands"])

    return run


def with_frequencies(docs: DataFrame, n_docs: int, n_bytes: int) -> DataFrame:
    """Per row of docs: id, x, cls, df of its distinct shingles in ascending order (packed), bands."""
    g = F.pmod(F.xxhash64("id", "x"), F.lit(-(-n_bytes // GROUP) + 1)).alias("g")
    ranges = n_bytes // RANGE + 1
    dealt = docs.select(g, "text").repartition("g").sortWithinPartitions("g")
    hashes = dealt.mapInArrow(_hashes(ranges), "part int, g long, h binary, n binary")
    totals = common.staged(hashes.repartition("part").sortWithinPartitions("part").mapInArrow(_totals, "g long, part int, k int, n binary"), "near")
    common.release(docs.sparkSession)  # the texts and hashes that were moved to count; texts are moved once more
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = docs.select(g, nothing("int", "part"), "id", "x", "cls", "text", nothing("int", "k"), nothing("binary", "n"))
    told = totals.select("g", "part", nothing("long", "id"), nothing("long", "x"), nothing("binary", "cls"), nothing("string", "text"), "k", "n")
    # a document's part is null and comes last
    both = own.unionByName(told).repartition("g").sortWithinPartitions("g", F.col("part").asc_nulls_last())
    return both.mapInArrow(_with_frequencies(n_docs), _WITH_DF)


def idf_table(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    most = np.log(max(n_docs, 2))
    share = np.clip(np.log(max(n_docs, 1) / np.clip(frequencies, 1, max(n_docs, 1))) / most, 0, 1)
    return (1 + share).astype(np.float32)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(tf)).astype(np.float32) * idf).astype(np.float32)


def _least(least: np.ndarray, some: np.ndarray, text: np.ndarray, values: np.ndarray, table: np.ndarray | None, level: np.ndarray | None) -> None:
    """Lower ``least`` (by sample and text: a value as :func:`ordered`, and the first place that has it) to that of the shingles at the
    places ``some``, whose values come from the table of their level, or are worked out one by one."""
    own, shift = draws(), np.uint64(64 - _TABLE.bit_length() + 1)
    begins = np.append(np.flatnonzero(np.diff(text[some], prepend=-1)), len(some))
    held, place, value, level = text[some[begins[:-1]]], some.astype(np.uint64), values[some], None if level is None else level[some]
    stretches = [(slice(low, high), slice(begins[low], begins[high]), begins[low:high] - begins[low]) for low, high in common.cuts(begins, _SHINGLES)]
    places, found = (np.empty(max((len(place[part]) for _, part, _ in stretches), default=0), np.uint64) for _ in range(2))
    lowest = np.empty(len(held), np.uint64)
    for k in range(SAMPLES):
        for texts, part, starts in stretches:
            at, key = places[: part.stop - part.start], found[: part.stop - part.start]
            np.multiply(value[part], own.turn[k], out=at)
            at >>= shift
            if level is None:
                np.take(table[k], at.view(np.int64), out=key, mode="clip")
                key |= place[part]
            else:
                np.bitwise_or(ordered(own.values(k, at.view(np.int64), level[part])), place[part], out=key)
            np.minimum.reduceat(key, starts, out=lowest[texts])
        least[k, held] = np.minimum(least[k, held], lowest)


def drawn(doc: np.ndarray, values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and a row of BANDS keys for each."""
    new = np.diff(doc, prepend=-1) != 0
    has, text = doc[new], np.cumsum(new) - 1
    if not len(has):
        return has, np.zeros((0, BANDS), np.uint64)
    level = np.log(weight)
    own, least = draws(), np.full((SAMPLES, len(has)), ~np.uint64(0))
    levels, times = np.unique(level[:: -(-len(level) // _SHINGLES)], return_counts=True)
    usual = levels[np.argsort(-times, kind="stable")[:_LEVELS]]
    usual = usual[np.isin(usual, levels[8 * times >= times.sum()])]
    rare = np.ones(len(level), bool)
    for one in usual:
        same = level == one
        rare &= ~same
        _least(least, np.flatnonzero(same), text, values, own.of(one), None)
    _least(least, np.flatnonzero(rare), text, values, None, level)
    out, shift = np.empty((SAMPLES, len(has)), np.uint64), np.uint64(64 - _TABLE.bit_length() + 1)
    for k in range(SAMPLES):
        chosen = (least[k] & np.uint64(0xFFFFFFFF)).view(np.int64)
        at = ((values[chosen] * own.turn[k]) >> shift).view(np.int64)
        t = np.floor(level[chosen] * own.per_r[k][at] + own.beta[k][at])
        out[k] = values[chosen] ^ common.mixed(t.astype(np.int64).astype(np.uint64))
    keys = np.zeros((BANDS, len(has)), np.uint64)
    for k in range(SAMPLES):
        band = k // ROWS
        keys[band] = common.mixed(keys[band] * np.uint64(0xC2B2AE3D27D4EB4F) + out[k] + np.uint64(band))
    return has, keys.T


def _carried(bodies: list[bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and weight of texts that come with their bands and df, see :func:`classes`."""
    sizes = [[int.from_bytes(body[k : k + 4], "big") for k in (0, 4)] for body in bodies]
    doc, values, tf = counted(pa.array([body[8 + a + b :] for body, (a, b) in zip(bodies, sizes)], pa.large_binary()))
    df = np.concatenate([np.frombuffer(body, np.uint32, b // 4, 8 + a) for body, (a, b) in zip(bodies, sizes)])
    return doc, values, weighted(tf, idf_table(df, n_docs))


def _bands_of(bodies: list[bytes]) -> list[list[int]]:
    return [np.frombuffer(body, ">i8", int.from_bytes(body[:4], "big") // 8, 8).tolist() for body in bodies]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts given as ascending distinct shingles and their weights; texts without words are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    shared, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][at], b[1][to]).sum(dtype=np.float64))
    return low / max(float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low, 1e-9)


def _keys(doc: np.ndarray, places: np.ndarray, weight: np.ndarray, n_texts: int, threshold: float) -> list[list[int]]:
    """Of each text the shingles (``places`` in a list of all) of which two texts that are alike share one at least.

    All shingles are ordered, those of the fewest texts first. What two texts share has ``threshold`` of the weight of each, so not all of
    it can come after the first of the two places behind which less than that is left: the shingles up to there are the keys.
    """
    times = np.bincount(places)
    order = np.lexsort((places, times[places], doc))
    places, weight = places[order], weight[order].astype(np.float64)
    total = np.bincount(doc, weight, n_texts)
    begins = np.searchsorted(doc, np.arange(n_texts))
    before = np.append(0, np.cumsum(weight))
    left = total[doc] - (before[:-1] - before[begins[doc]])
    some = (left >= threshold * (1 - _MARGIN) * total[doc]) & (times[places] > 1)
    keys = np.split(places[some], np.searchsorted(doc[some], np.arange(1, n_texts)))
    return [own.tolist() if weight else [_WORDLESS] for own, weight in zip(keys, total.tolist())]


def _measure(n_docs: int, threshold: float):
    def of(bodies: list[bytes]) -> tuple[Callable[[int, int], bool], list[list[int]] | None]:
        doc, values, weight = _carried(bodies, n_docs)
        every, places = np.unique(values, return_inverse=True)
        total = np.bincount(doc, weight, len(bodies)).tolist()  # exact in any order, as weights are multiples of 2**-23
        ends = np.searchsorted(doc, np.arange(1, len(bodies)))
        held, weights = np.split(places, ends), np.split(weight, ends)
        spread, at = np.zeros(len(every), np.float32), 0
        spread[held[0]] = weights[0]

        def alike(a: int, b: int) -> bool:
            """As :func:`similarity`; the weights of a are spread over all shingles as long as a stays the same."""
            nonlocal at
            if a != at:
                spread[held[at]] = 0
                spread[held[a]] = weights[a]
                at = a
            if not total[a] and not total[b]:
                return 1.0 >= threshold
            if min(total[a], total[b]) < threshold * (1 - _MARGIN) * max(total[a], total[b]):
                return False  # they can't share more than the lighter one has
            low = float(np.minimum(spread[held[b]], weights[b]).sum(dtype=np.float64))
            return low / max(total[a] + total[b] - low, 1e-9) >= threshold

        return alike, _keys(doc, places, weight, len(bodies), threshold) if len(bodies) > _SOME and threshold > 0 else None

    return of


def classes(documents: DataFrame, threshold: float = THRESHOLD, group_bytes: int = linking.GROUP_BYTES) -> DataFrame:
    """Per row of documents: id (a null doc_id: the least value), x, class_id (likewise), kept: the row's text is the one that stays."""
    docs = anchors.keyed(documents)
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    summary = common.staged(with_frequencies(docs, n_docs, n_bytes), "near")
    common.release(docs.sparkSession)
    # a text goes to its comparisons together with its bands and df, so nothing is drawn again there
    keys = F.unhex(F.array_join(F.transform("bands", lambda b: F.lpad(F.hex(b), 16, "0")), ""))
    known = summary.select("id", "x", "df", keys.alias("keys")).dropDuplicates(["id", "x"])
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 8, "0"))
    body = F.concat(size("keys"), size("df"), "keys", "df", F.encode("text", "utf-8")).alias("text")
    carrying = lambda rows: rows.join(known.hint("merge"), ["id", "x"]).withColumn("text", body).drop("df", "keys")
    return linking.classes(docs, summary, _bands_of, _measure(n_docs, threshold), "near", group_bytes, carrying)


def groups(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of documents: doc_id, class_id (the least doc_id of its group), kept (it is the one that stays)."""
    return linking.public(classes(documents, threshold))


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one row of each group."""
    stays = common.staged(classes(documents, threshold).where("kept").groupBy("id", "x").agg(F.count("*").alias("n")), "near")
    own = [common.unused(documents, name) for name in ("id", "x")]
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(anchors.NO_ID)), F.xxhash64(common.text_of()))
    keyed = documents.withColumns(dict(zip(own, keys)))
    left = keyed.join(stays.select(*[F.col(c).alias(name) for c, name in zip(("id", "x"), own)]).hint("merge"), own, "left_semi")
    if not stays.where("n > 1").isEmpty():
        left = left.dropDuplicates(own)
    return left.select(*documents.columns)
