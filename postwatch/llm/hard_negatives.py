"""Hard negatives by Kronecker-packed products: exact integer scores of several candidates with one multiplication each.

A vector's components are ``floor(SCALE * x)``. The components of several candidates at one place of the vector are biased to be
no less than 0 and put side by side into fields of one wide integer. An anchor's component is multiplied with that integer
once, and the sum over the places holds in each field the candidate's score, shifted by the bias times the sum of the anchor's
components. All of it is arithmetic modulo 2**64, so only the final scores have to fit their fields; the field width follows
from the longest vector, as no score exceeds the product of two lengths. Where not even one score fits a 64-bit word, the wide
integers are Python's, of any width.

Plan: the integer vectors are written once. Anchors are dealt into sets, all rows into parts, and each pair of a set and a part
is a cell: one group of rows whose anchors come first and whose candidates then stream past them in blocks. A cell sends its best
rows for each anchor, and a ranking over the cells keeps the first of them. Done twice: for the positives (blocks sorted by label,
so an anchor meets its own label only), and for the negatives, when the positives' scores say which scores qualify. One label
may hold all rows: cells are dealt by row, not by label.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; a null vec_id is no anchor and
counts as smaller than any other; rows of one vec_id are different rows, in an order that the written table fixes; a shorter vector
counts as filled up with zeros; an anchor without other rows of its label gives no rows. Components are taken as 64-bit integers
(larger ones saturate), and a score beyond 64 bits counts as the nearest 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postwatch.llm import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Scores that qualify, in hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHORS = 4096  # of a set: what a task holds at once
PART_ROWS, LEAST_ROWS = 1 << 18, 2048  # rows of a part at most; parts get no smaller than LEAST_ROWS to occupy more tasks
BLOCK = 8192  # candidates that are scored at once
_TILE = 64  # anchors that are scored at once
_NARROW = 1 << 48  # scores below this are ordered together with their places as one 64-bit integer
_NO_ID = -(1 << 63)
_NONE = np.iinfo(np.int64).min  # stands for no score
_RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
_FOUND = "anchor_row long, anchor_id long, found_id long, found_row long, score long, nth long, positive_id long, positive_score long"


def integers(vectors: DataFrame, is_anchor: Column, scale: int = SCALE) -> DataFrame:
    """id (never null), label, v (whole components), asks (it is an anchor) of the rows that take part."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, shorter lists filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy().astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Packed:
    """Candidates side by side in wide integers, see the module; ``most``: no score is larger."""

    def __init__(self, rows: np.ndarray, most: int):
        self.n, width = rows.shape
        self.bits = (2 * most + 1).bit_length()
        self.wide = self.bits > 64
        self.fields = 8 if self.wide else 64 // self.bits
        kind = object if self.wide else np.uint64
        padded = np.zeros((-(-self.n // self.fields) * self.fields, width), np.int64)  # zeros fill the last integer up
        padded[: self.n] = rows
        self.bias = -min(0, int(padded.min(initial=0)))
        biased = padded.astype(kind) + kind(self.bias) if not self.wide else padded.astype(object) + self.bias
        by_field = biased.reshape(-1, self.fields, width)
        self.words = np.zeros((width, len(by_field)), kind)
        for k in range(self.fields):
            self.words += by_field[:, k].T << self._whole(self.bits * k)
        self.ones = sum(1 << self.bits * k for k in range(self.fields))

    def _whole(self, value: int):
        return value if self.wide else np.uint64(value % (1 << 64))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors x candidates."""
        own = anchors.astype(object if self.wide else np.uint64)
        # each component of an anchor is multiplied once with the wide integer of several candidates
        total = own.dot(self.words) if self.wide else np.einsum("ad,dw->aw", own, self.words)
        half = 1 << (self.bits - 1)
        shift = own.sum(axis=1) * self._whole(self.bias) * self._whole(self.ones)
        total = total - shift[:, None] + self._whole(half * self.ones)  # a field holds its score plus half a field
        out = np.empty((len(anchors), self.words.shape[1], self.fields), np.int64)
        for k in range(self.fields):
            field = (total >> self._whole(self.bits * k)) & self._whole((1 << self.bits) - 1)
            out[:, :, k] = np.clip(field - half, _NONE + 1, -_NONE - 1) if self.wide else field.astype(np.int64) - np.int64(half - (half >> 63 << 64))
        return out.reshape(len(anchors), -1)[:, : self.n]


class Best:
    """The first ``k`` candidates so far of each anchor, or anchor and positive: by score, then id, then row (-1: none)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.full((n, k), -1)

    def merge(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        score, id_, row = (np.concatenate([old[at], new], axis=1) for old, new in ((self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, row < 0), axis=-1)[:, : self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, axis=1) for x in (score, id_, row))


def _ordered(score: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores in ascending order, of equal ones the later place first, and their places; what is not valid comes first, as -1."""
    places = np.arange(score.shape[1])
    if most >= _NARROW:
        score = np.where(valid, score, _NONE)
        order = np.lexsort((np.broadcast_to(-places, score.shape), score), axis=-1)
        score = np.take_along_axis(score, order, axis=1)
        return score, np.where(score == _NONE, -1, order)
    bits = BLOCK.bit_length()
    key = np.where(valid, (score << bits) | ((1 << bits) - 1 - places), _NONE)
    key.sort(axis=1)
    none = key == _NONE
    return np.where(none, _NONE, key >> bits), np.where(none, -1, (1 << bits) - 1 - (key & ((1 << bits) - 1)))


def _taken(score: np.ndarray, place: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the ``k`` last before ``end`` in each row, the last one first; place -1 where there are fewer."""
    at = end[:, None] - 1 - np.arange(k)
    there = np.maximum(at, 0)
    return np.take_along_axis(score, there, axis=1), np.where(at >= 0, np.take_along_axis(place, there, axis=1), -1)


class Cell:
    """The anchors of one set, and the best of what has streamed past them; without ``window`` of their own label, else of others."""

    def __init__(self, rows: pa.RecordBatch, width: int, most: int, k: int, window: tuple[int, int] | None):
        self.row, self.id, self.label = (_numbers(rows, c) for c in ("r", "id", "label"))
        self.v, self.most, self.window = matrix(rows.column("v"), width), most, window
        self.positives = [p or [] for p in rows.column("positives").to_pylist()]
        self.per = max(map(len, self.positives), default=0) if window else 1
        self.best = Best(len(self.row) * self.per, k)

    def pass_by(self, rows: pa.RecordBatch) -> None:
        v, row, id_, label = matrix(rows.column("v"), self.v.shape[1]), *(_numbers(rows, c) for c in ("r", "id", "label"))
        order = np.lexsort((row, id_))
        if self.window:
            self._others(v[order], row[order], id_[order], label[order])
            return
        for own in np.unique(label):
            if (self.label == own).any():
                some = order[label[order] == own]
                self._same(own, v[some], row[some], id_[some])

    def _same(self, label: int, v: np.ndarray, row: np.ndarray, id_: np.ndarray) -> None:
        packed, asked = Packed(v, self.most), np.flatnonzero(self.label == label)
        for at in range(0, len(asked), _TILE):
            which = asked[at : at + _TILE]
            score, place = _ordered(packed.scores(self.v[which]), row != self.row[which][:, None], self.most)
            score, place = _taken(score, place, np.full(len(which), len(row)), self.best.k)
            self.best.merge(which, score, id_[place], np.where(place < 0, -1, row[place]))

    def _others(self, v: np.ndarray, row: np.ndarray, id_: np.ndarray, label: np.ndarray) -> None:
        packed = Packed(v, self.most)
        for at in range(0, len(self.row), _TILE):
            which = np.arange(at, min(at + _TILE, len(self.row)))
            every, places = _ordered(packed.scores(self.v[which]), label != self.label[which][:, None], self.most)
            for nth in range(self.per):
                has = np.array([k for k, a in enumerate(which) if nth < len(self.positives[a])], np.int64)
                bounds = [self.positives[which[k]][nth]["score"] for k in has]
                # low * positive <= 100 * negative <= high * positive
                least = np.array([-(-self.window[0] * p // 100) for p in bounds], np.int64)
                end = np.array([np.searchsorted(every[k], self.window[1] * p // 100, "right") for k, p in zip(has, bounds)], np.int64)
                score, place = _taken(every[has], places[has], end, self.best.k)
                place = np.where(score >= least[:, None], place, -1)
                self.best.merge(which[has] * self.per + nth, score, id_[place], np.where(place < 0, -1, row[place]))

    def result(self) -> pa.RecordBatch:
        at, nth = np.nonzero(self.best.row >= 0)
        anchor, positive = at // max(self.per, 1), at % max(self.per, 1)
        found = [self.row[anchor], self.id[anchor], self.best.id[at, nth], self.best.row[at, nth], self.best.score[at, nth], positive]
        own = [self.positives[a][p] if self.window else {"id": 0, "score": 0} for a, p in zip(anchor, positive)]
        found += [np.array([p[name] for p in own], np.int64) for name in ("id", "score")]
        names = [field.split()[0] for field in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Cell, role and up to BLOCK rows of one cell and role; the anchors of a cell are one block, they are bounded by their set."""
    held: list[pa.RecordBatch] = []
    key, n = None, 0
    for batch in batches:
        cell, role = _numbers(batch, "cell"), _numbers(batch, "role")
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), batch.num_rows]
        for at, upto in zip(cuts, cuts[1:]):
            while at < upto:
                if held and ((cell[at], role[at]) != key or (key[1] and n == BLOCK)):
                    yield *key, pa.concat_batches(held)
                    held, n = [], 0
                key = (cell[at], role[at])
                take = min(upto - at, BLOCK - n) if role[at] else upto - at
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
    if held:
        yield *key, pa.concat_batches(held)


def _search(width: int, most: int, k: int, window: tuple[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for key, role, rows in _blocks(batches):
            if key != now:
                if cell:
                    yield cell.result()
                now, cell = key, None
            if role == 0:
                cell = Cell(rows, width, most, k, window)
            elif cell:  # a set without anchors asks for nothing
                cell.pass_by(rows)
        if cell:
            yield cell.result()

    return run


def _best(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], width: int, most: int, k: int, window: tuple[int, int] | None = None) -> DataFrame:
    """The first ``k`` of each anchor (and positive), ranked; ``counts``: of rows and of anchors."""
    parts = max(-(-counts[0] // PART_ROWS), min(common.size_partitions(rows.sparkSession), -(-counts[0] // LEAST_ROWS)))
    sets = -(-counts[1] // ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("r", F.lit(salt)), F.lit(n)).cast("int")
    none = F.lit(None).cast("array<struct<rank:int,id:long,score:long>>").alias("positives")
    columns = ["r", "id", "label", "v"]
    asked = anchors.select(dealt(sets, 1).alias("s"), every(parts).alias("p"), F.lit(0).alias("role"), *columns, "positives" if window else none)
    against = rows.select(every(sets).alias("s"), dealt(parts, 2).alias("p"), F.lit(1).alias("role"), *columns, none)
    cells = asked.unionByName(against).select((F.col("s").cast("long") * parts + F.col("p")).alias("cell"), "role", *columns, "positives")
    cells = cells.repartition(sets * parts, "cell").sortWithinPartitions("cell", "role", "label")
    found = cells.mapInArrow(_search(width, most, k, window), _FOUND)
    first = W.partitionBy("anchor_row", "nth").orderBy(F.col("score").desc(), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors``: vec_id, label, embedding.

    The positives of an anchor are its first ``positives`` other rows of its label, its negatives for each of them the first
    ``negatives`` rows of other labels whose score is between ``window`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = common.staged(integers(vectors, is_anchor).withColumn("r", F.monotonically_increasing_id()), "mine")
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    n, n_anchors, width, square = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(length)).first()
    shown = [F.nullif(F.col(c), F.lit(_NO_ID)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    if not n or not n_anchors:
        empty = ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in _RESULT)
        return spark.createDataFrame([], empty)
    # no score exceeds the largest square of a length; the double sum is rounded, hence a little more
    width, most = max(width, 1), int(square * (1 + 1e-9)) + 1
    anchors = rows.where("asks")
    same = _best(anchors, rows, (n, n_anchors), width, most, positives)
    listed = same.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives"))
    asked = common.staged(anchors.join(listed, F.col("r") == F.col("anchor_row")).drop("anchor_row"), "mine")
    found = _best(asked, rows, (n, n_anchors), width, most, negatives, window)
    found = found.withColumnsRenamed({"found_id": "negative_id", "score": "negative_score"})
    return found.withColumns({c: shown[k] for k, c in enumerate(("anchor_id", "positive_id", "negative_id"))}).select(*_RESULT)
