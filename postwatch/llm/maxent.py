"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a unigram base score.

Tokens are words (runs of bytes other than space and tab to carriage return, A-Z lower-cased) and one end for each text. The
model is P(token | before) = P(class | before) * P(token | class, before). The words of the corpus are counted whole; those
frequent enough for the ``FREQUENT`` most frequent get classes of about equal mass, the others one of ``RARE_CLASSES`` by
their hash. The features, all of them hashed:

* the word before (n-gram) and the word before last (skip), each with a weight for every class, in tables of ``2**BITS`` rows;
* the two words before together (the context, 47 bits), with a weight for every class;
* the context and the word, with a weight in the softmax over the words of a class; beside it each word has a weight whose
  optimum is the share of its counts, one more of each counted. In the rare classes only this one is there, and one unseen
  word has a place too.

So what is gathered of contexts and of words after them grows with the text; only the two tables are of fixed size.

Training, first step: the learning rows are split by hash into ``ROUNDS`` parts. In each round the tasks sum the gradient of
the two tables over all rows of a part, blocks of it are added up on the executors, and the weights move by it, scaled by how
often each row of a table was used.

Second step: all tokens are dealt by context into shards of about ``SHARD`` tokens, as packed arrays. A shard holds every
learning token of its contexts, so the gradient of their weights is exact there; they move until they settle (ridge
``CLASS_RIDGE``, ``WORD_RIDGE``) and give the score of each token of the shard, held out or not; about ``_PORTION`` tokens at
a time, whole contexts, so a task never holds all that a shard's training needs. Sums for each text go back, packed as well.
A context that the learning rows hold at least ``HOT`` times is dealt by text into as many parts as that count holds, so that
no shard outgrows its task. The learning rows' counts of its tokens are summed beforehand and go to each of its parts, so all
parts settle at the same weights: those that it would have in one piece.

Counts of frequent words go to all tasks (at most ``FREQUENT`` rows). Rare words are joined with the table of all counts: each
text sends a row for each of its distinct rare words. So no count is ever cut.

Defined cases: a null text has the end only; a null doc_id reads as empty text in the split into learning and held-out rows;
without learning rows N and V are 0 and every token is unknown; repeated rows repeat (and count twice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from postwatch.llm import common, phrases

FOLDS, HELD_OUT = 7, 2
FREQUENT = 100_000
RARE_CLASSES = 8
CLASSES = 32
BITS = 13
ROUNDS = 3
STEP = 0.7
CLASS_RIDGE, WORD_RIDGE = 1.0, 0.25
SHARD = 3 << 19
HOT = 1 << 20
_TOKENS = 1 << 15
_PAIRS = 1 << 20
_CONTEXTS = 1 << 13
_PORTION = 1 << 18  # tokens of a shard whose contexts are trained at once, or those of one context
_STEPS, _SETTLED = 16, 0.02
_FLUSH = 1 << 22
_HELD = 1 << 17  # distinct words or tokens that a task counts before it sends them
_WORD_BITS = 17  # of a packed token: the rank of a frequent word, or a rare class at the upper end
_RARE_WORD = (1 << _WORD_BITS) - RARE_CLASSES
_EXTRA = 64 - _WORD_BITS - 2 * BITS
_LOOK_UP = 18
_END = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words, worked out for about ``CHUNK_BYTES`` at once: they need 40 bytes for each byte of text."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + common.CHUNK_BYTES, "right")))
        out[a:b] = common.span_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return out


def tokens(texts: pa.Array):
    """Lower-cased bytes, word starts and ends, and for all tokens: hash, text, and the word (-1: an end)."""
    data, starts, ends, before = phrases.split(texts)
    data = _LOWER[data]
    n_words = np.diff(before)
    doc = np.repeat(np.arange(len(n_words)), n_words + 1)
    word = np.arange(len(doc)) - doc
    last = np.cumsum(n_words + 1) - 1
    hashes = np.empty(len(doc), np.uint64)
    inside = np.ones(len(doc), bool)
    inside[last] = False
    hashes[inside] = _word_hashes(data, starts, ends)
    hashes[last] = _END
    word[last] = -1
    return data, starts, ends, hashes, doc, word


def before(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before each token and of the one before that."""
    one, two = np.full(len(hashes), _START), np.full(len(hashes), _START)
    one[1:] = np.where(doc[1:] == doc[:-1], hashes[:-1], _START)
    two[2:] = np.where(doc[2:] == doc[:-2], hashes[:-2], _START)
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The rows of the two tables for each token."""
    shift = np.uint64(64 - BITS)
    hashed = [common.mixed(one.copy()), common.mixed(two + np.uint64(77))]
    return np.stack([(h >> shift).astype(np.int64) + (k << BITS) for k, h in enumerate(hashed)])


@dataclass
class Model:
    """What the tasks need: frequent words by hash, class sizes, weights."""

    hashes: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    within: np.ndarray  # log10 P(word | class)
    rare_total: np.ndarray  # of the rare classes: tokens + words + 1
    prior: np.ndarray
    n: int
    v: int
    rank: np.ndarray  # by frequency, of the frequent words
    n_ends: int
    rare_most: int  # the largest count of a rare word
    hot: tuple[np.ndarray, np.ndarray] | None = None  # contexts to be dealt by text, ascending, and into how many parts
    weights: np.ndarray = field(default_factory=lambda: np.zeros((2 << BITS, CLASSES), np.float32))

    @cached_property
    def by_rank(self) -> np.ndarray:
        return np.argsort(self.rank)

    @cached_property
    def _starts(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The hashes with one above all, the place of the first one of each value of the upper ``_LOOK_UP`` bits, the most with one value."""
        first = np.searchsorted(self.hashes, np.arange(1 << _LOOK_UP, dtype=np.uint64) << np.uint64(64 - _LOOK_UP))
        return np.append(self.hashes, np.uint64((1 << 64) - 1)), first, int(np.diff(np.append(first, len(self.hashes))).max())

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (-1: rare), and class, of each token."""
        if not len(self.hashes):
            at = np.full(len(hashes), -1, np.int64)
        else:
            known, first, most = self._starts
            at = first[(hashes >> np.uint64(64 - _LOOK_UP)).astype(np.int64)]
            for _ in range(most):
                at += known[at] < hashes
            at = np.minimum(at, len(self.hashes) - 1)
            at[self.hashes[at] != hashes] = -1
        rare = CLASSES - RARE_CLASSES + (hashes >> np.uint64(61)).astype(np.int64) % RARE_CLASSES
        return at, np.where(at >= 0, self.kinds[at] if len(self.kinds) else 0, rare)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.weights[rows[0]]
        out += self.weights[rows[1]]
        out += self.prior
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task with their counts, added up over its texts; ``_HELD`` distinct words or a few more at once."""

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()).cast(pa.string()), pa.array(known[np.argsort(slot)].view(np.int64)), pa.array(total)], ["word", "h", "c"]
        )

    def nothing():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    known, slot, total, names = nothing()  # hashes ascending, where their counts and names stand
    for _, texts in common.chunks(batches):
        data, starts, ends, hashes, _, word = tokens(texts)
        found, first, n = np.unique(hashes, return_index=True, return_counts=True)
        at = np.searchsorted(known, found)
        old = np.zeros(len(found), bool)
        old[at < len(known)] = known[at[at < len(known)]] == found[at < len(known)]
        total[slot[at[old]]] += n[old]
        body = data.tobytes()
        names += [body[starts[k] : ends[k]] if k >= 0 else b"" for k in word[first[~old]].tolist()]
        known = np.insert(known, at[~old], found[~old])
        slot = np.insert(slot, at[~old], len(total) + np.arange(np.count_nonzero(~old)))
        total = np.append(total, n[~old])
        if len(total) >= _HELD:
            yield rows()
            known, slot, total, names = nothing()
    if names:
        yield rows()


def count_words(learning: DataFrame) -> DataFrame:
    """word, h, c of all tokens of the rows; the end is the empty word."""
    rows = learning.select("text").mapInArrow(_counts, "word string, h long, c long")
    return common.staged(rows.groupBy("word", "h").agg(F.sum("c").alias("c")), "maxent")


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` words have it or more."""
    level = F.floor(F.log2("c") * 8).cast("int").alias("level")
    seen, limit = 0, None
    for row in sorted(counts.groupBy(level).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        seen += row.n
        if seen > most:
            break
        limit = row.c
    return limit if limit is not None else 1 << 62


def prepare(counts: DataFrame, frequent: int = FREQUENT) -> Model:
    """Classes and their words' probabilities, without weights."""
    n, v, n_ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    n = n or 0
    limit = _least_frequent(counts, frequent)
    rows = sorted(counts.where(F.col("c") >= limit).select("c", "h").collect(), key=lambda r: (-r.c, r.h))
    c = np.array([r.c for r in rows], np.int64)
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    plain = CLASSES - RARE_CLASSES
    kinds = np.minimum((np.cumsum(c) - c) * plain // max(1, c.sum()), plain - 1) if len(c) else np.zeros(0, np.int64)
    mass, size = np.bincount(kinds, c, plain), np.bincount(kinds, minlength=plain)
    within = np.log10((c + 1) / (mass + size)[kinds]) if len(c) else np.zeros(0)
    kind = F.pmod(F.shiftrightunsigned("h", 61), F.lit(RARE_CLASSES)).cast("int").alias("kind")
    rare = counts.where(F.col("c") < limit).groupBy(kind).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max("c").alias("most")).collect()
    rare_mass, rare_total = np.zeros(RARE_CLASSES), np.ones(RARE_CLASSES)
    for r in rare:
        rare_mass[r.kind], rare_total[r.kind] = r.n, r.n + r.v + 1
    prior = np.log(np.concatenate([mass, rare_mass]) + 1)
    prior[:plain][size == 0] = -1e4  # a class without words gets no mass
    prior -= np.log(np.exp(prior).sum())
    order = np.argsort(h)
    most = max((r.most for r in rare), default=0)
    return Model(h[order], c[order], kinds[order], within[order], rare_total, prior.astype(np.float32), n, v, order, n_ends or 0, most)


def _by_class(model: Model, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logits of :meth:`Model.logits`, a row for each class; so are the weights. Sums over classes then run along whole arrays."""
    out = weights.take(rows[0], axis=1)
    out += weights.take(rows[1], axis=1)
    out += model.prior[:, None]
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place; classes are rows."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _expected(model: Model, pairs: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Adds the class probabilities of each pair of rows (one number) to ``total`` at both rows; equal pairs are worked out once."""
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    times = np.diff(np.append(first, len(pairs))).astype(np.float32)
    pairs = pairs[first].astype(np.int64)
    rows = np.stack([pairs >> BITS, (pairs & ((1 << BITS) - 1)) + (1 << BITS)])
    for at in range(0, len(pairs), _TOKENS):
        part = rows[:, at : at + _TOKENS]
        p = _softmax(_by_class(model, part, weights))
        p *= times[at : at + _TOKENS]
        for k, row in enumerate(part):
            if k:  # the first rows ascend as they are; rows below 2**16 are sorted by counting
                order = np.argsort(row.astype(np.uint16), kind="stable")
                p, row = p.take(order, axis=1), row[order]
            edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            total[:, row[edge]] += np.add.reduceat(p, edge, axis=1)


def _gradient(model: Model):
    """A task's summed gradient with the number of uses of each row as last column, in blocks.

    It is the counts of the classes less what the model expects. Without weights yet that is the same for all tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_rows = 2 << BITS
        counts, expected = np.zeros(n_rows * CLASSES, np.int64), np.zeros((CLASSES, n_rows))
        weights, pairs, n = (np.ascontiguousarray(model.weights.T) if model.weights.any() else None), [], 0
        for _, texts in common.chunks(batches):
            _, _, _, hashes, doc, _ = tokens(texts)
            rows, kinds = features(*before(hashes, doc)), model.look_up(hashes)[1]
            counts += np.bincount((rows * CLASSES + kinds).ravel(), minlength=len(counts))
            if weights is None:
                continue
            pairs.append(((rows[0] << BITS) | (rows[1] - (1 << BITS))).astype(np.uint32))
            n += len(hashes)
            if n >= _PAIRS:
                _expected(model, np.concatenate(pairs), weights, expected)
                pairs, n = [], 0
        if pairs:
            _expected(model, np.concatenate(pairs), weights, expected)
        counts = counts.reshape(n_rows, CLASSES)
        uses = counts.sum(axis=1)
        if weights is None:
            expected = _softmax(model.prior.astype(float))[:, None] * uses
        total = np.column_stack([counts - expected.T, uses]).astype(np.float32)
        yield from common.block_rows(total.reshape(-1, 64 * (CLASSES + 1)))

    return run


def train(learning: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    for turn in range(rounds):
        part = learning.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("text")
        total = np.zeros((2 << BITS, CLASSES + 1)).reshape(-1, 64 * (CLASSES + 1))
        for block, values in common.summed(part.mapInArrow(_gradient(model), common.BLOCKS), "float32"):
            total[block] = values
        total = total.reshape(-1, CLASSES + 1)
        # a diagonal Newton step: the curvature of a class is about uses * p * (1 - p)
        p = np.exp(model.prior.astype(float))
        move = total[:, :CLASSES] / (total[:, CLASSES:] * p * (1 - p) + 4)
        model.weights = (model.weights + STEP / 2 * np.clip(move, -4, 4)).astype(np.float32)
    return model


_SUMMARY = "doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, rare array<struct<word: string, n: long>>"
_PACKED = "group long, shard int, texts boolean, body binary"
_REPLIED = "group long, texts boolean, body binary"


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed planes of their bytes."""
    planes, at = np.empty((sum(a.itemsize for a in arrays), len(arrays[0])), np.uint8), 0
    for a in arrays:
        planes[at : at + a.itemsize] = a[:, None].view(np.uint8).T
        at += a.itemsize
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _from_planes(body: bytes, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(sum(sizes), -1)
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(planes[e - k : e].T).view(t).ravel() for k, e, t in zip(sizes, ends, types)]


def _table_bytes(columns: list[pa.Array]) -> bytes:
    """Columns of texts, packed whole: they pass two shuffles."""
    batch, out = pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_frequent", "base", "rare"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue().to_pybytes())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Rows with about ``_FLUSH`` bytes of text."""
    rows, texts, size = [], [], 0
    for batch, part in common.chunks(batches):
        rows.append(batch.select(["doc_id", "held_out"]))
        texts.append(part)
        size += len(common.flat(part)[0])
        if size >= _FLUSH:
            yield pa.Table.from_batches(rows), pa.concat_arrays(texts)
            rows, texts, size = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), pa.concat_arrays(texts)


def _packed(model: Model, one, two, at, kinds) -> np.ndarray:
    """Contexts and words as 64 bits."""
    rows = features(one, two).astype(np.uint64)
    rows[1] -= np.uint64(1 << BITS)
    extra = common.mixed(one * np.uint64(0xC2B2AE3D27D4EB4F) + two) >> np.uint64(64 - _EXTRA)
    key = (rows[0] << np.uint64(BITS + _EXTRA)) | (rows[1] << np.uint64(_EXTRA)) | extra
    word = np.where(at >= 0, model.rank[at] if len(model.rank) else 0, _RARE_WORD + kinds - (CLASSES - RARE_CLASSES))
    return (key << np.uint64(_WORD_BITS)) | word.astype(np.uint64)


def _most(model: Model, one, two, at) -> np.ndarray:
    """How often the learning rows can hold the context of each token at most."""
    count = np.full(len(at), model.rare_most)
    count[at >= 0] = model.counts[at[at >= 0]]
    first, second = np.full(len(at), model.n_ends), np.full(len(at), model.n_ends)
    first[1:] = np.where(one[1:] == _START, model.n_ends, count[:-1])
    second[2:] = np.where(two[2:] == _START, model.n_ends, count[:-2])
    return np.minimum(first, second)


def _shards(key: np.ndarray, part: np.ndarray, n_shards: int) -> np.ndarray:
    return (common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(n_shards)).astype(np.int32)


def _parts(model: Model, key: np.ndarray) -> np.ndarray:
    """Into how many parts each context is dealt, as the counted contexts say."""
    keys, parts = model.hot
    out = np.ones(len(key), np.uint64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out[keys[at] == key] = parts[at[keys[at] == key]]
    return out


def _hot_tokens(model: Model):
    """Tokens after two words that both occur at least ``HOT`` times, counted over a task's texts."""
    some = np.append(model.hashes[model.counts >= HOT], _START if model.n_ends >= HOT else model.hashes[:0])
    some = np.sort(some.astype(np.uint64))

    def frequent(hashes: np.ndarray) -> np.ndarray:
        if model.rare_most >= HOT or not len(some):
            return np.full(len(hashes), model.rare_most >= HOT)
        return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, texts in common.chunks(batches):
            _, _, _, hashes, doc, _ = tokens(texts)
            one, two = before(hashes, doc)
            kept = np.flatnonzero(frequent(one) & frequent(two))
            found = _packed(model, one[kept], two[kept], *model.look_up(hashes[kept]))
            token, place = np.unique(np.append(token, found), return_inverse=True)
            n = np.bincount(place, np.append(n, np.ones(len(found))), len(token)).astype(np.int64)
            if len(token) >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])
                token, n = token[:0], n[:0]
        if len(token):
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def hot_contexts(learning: DataFrame, model: Model) -> DataFrame | None:
    """Counts of the tokens that may stand in a context to be dealt, and the list of those contexts into the model: one for
    ``HOT`` tokens at most. None where no two words are frequent enough."""
    if max([model.n_ends, model.rare_most, *model.counts.tolist()]) < HOT:
        model.hot = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return None
    rows = learning.select("text").mapInArrow(_hot_tokens(model), "token long, n long")
    counted = common.staged(rows.groupBy("token").agg(F.sum("n").alias("n")), "maxent")
    found = counted.groupBy(F.shiftrightunsigned("token", _WORD_BITS).alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).collect()
    found.sort()
    model.hot = np.array([r.key for r in found], np.uint64), np.array([r.n // HOT + 1 for r in found], np.uint64)
    return counted


def _deal_counts(model: Model, n_shards: int):
    """Counts of the tokens of dealt contexts, packed for each shard that holds a part; their group is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            key = token >> np.uint64(_WORD_BITS)
            parts = _parts(model, key).astype(np.int64)
            parts[parts == 1] = 0
            row = np.repeat(np.arange(len(token)), parts)
            if not len(row):
                continue
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            shard = _shards(key[row], part.astype(np.uint64), n_shards)
            order = np.lexsort((token[row], shard))
            row, shard = row[order], shard[order]
            new = np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))  # two parts may share a shard
            row, shard = row[new], shard[new]
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            bodies = [
                _planes(np.diff(token[row[a:b]], prepend=np.uint64(0)), np.ones(b - a, np.uint32), n[row[a:b]].astype(np.uint32))
                for a, b in zip(edge.tolist(), np.append(edge[1:], len(row)).tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(edge), -1), pa.int64()), pa.array(shard[edge]), pa.array(np.zeros(len(edge), bool)), pa.array(bodies, pa.binary())],
                ["group", "shard", "texts", "body"],
            )

    return run


def packs(model: Model, n_shards: int, group: int, one, two, at, kinds, doc, held_out):
    """Shards, and for each the packed distinct (token, text) with how often they occur."""
    token = _packed(model, one, two, at, kinds)
    key = token >> np.uint64(_WORD_BITS)
    parts = (_most(model, one, two, at) // HOT + 1).astype(np.uint64) if model.hot is None else _parts(model, key)
    own = common.mixed((np.arange(len(held_out)) + (group << 20)).astype(np.uint64))[doc]
    shard = _shards(key, own % parts, n_shards)
    order = np.argsort(token, kind="stable")  # texts stay in order
    order = order[np.argsort(shard[order].astype(np.uint16) if n_shards <= 1 << 16 else shard[order], kind="stable")]
    token, doc, shard = token[order], doc[order], shard[order]
    new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1]))
    places = np.flatnonzero(new)
    n = np.diff(np.append(places, len(token))).astype(np.uint32)
    token, doc, shard = token[places], doc[places], shard[places]
    flags = (doc.astype(np.uint32) << np.uint32(1)) | ~held_out[doc]
    edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist()):
        yield int(shard[a]), _planes(np.diff(token[a:b], prepend=np.uint64(0)), flags[a:b].astype(np.uint32), n[a:b])


def _pack(model: Model, n_shards: int):
    """Each text's sums over what the task knows with its distinct rare words, and the packed tokens."""

    def rows(known: pa.Table, texts: pa.Array, group: int, shard: int) -> pa.RecordBatch:
        n = len(texts)
        data, starts, ends, hashes, doc, word = tokens(texts)
        at, kinds = model.look_up(hashes)
        common_word = at >= 0
        base = np.bincount(doc[common_word], np.log10(model.counts[at[common_word]] + 1.0), n).astype(float)
        rare = np.flatnonzero(~common_word)  # the end, too, should it be rare
        order = rare[np.lexsort((hashes[rare], doc[rare]))]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        first = np.flatnonzero(new)
        body = data.tobytes()
        names = [body[starts[w] : ends[w]] if w >= 0 else b"" for w in word[order[first]].tolist()]
        listed = pa.StructArray.from_arrays(
            [pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.diff(np.append(first, len(order))), pa.int64())], ["word", "n"]
        )
        lists = common.lists(listed, np.bincount(doc[order[first]], minlength=n))
        held_out = known.column("held_out").combine_chunks()
        found = [(shard, _table_bytes(
            [
                known.column("doc_id").combine_chunks(),
                held_out,
                pa.array(np.bincount(doc, minlength=n), pa.int64()),
                pa.array(np.bincount(doc[common_word], minlength=n), pa.int64()),
                pa.array(base),
                lists,
            ]
        ))]
        del data, starts, ends, word, common_word, rare, order, new, first, body, names, listed, lists  # not for packing
        found += packs(model, n_shards, group, *before(hashes, doc), at, kinds, doc, held_out.to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(found), group), pa.int64()),
                pa.array([k for k, _ in found], pa.int32()),
                pa.array(np.arange(len(found)) == 0),
                pa.array([b for _, b in found], pa.binary()),
            ],
            ["group", "shard", "texts", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for serial, (known, texts) in enumerate(_held(batches)):
            group = (task << 24) + serial
            yield rows(known, texts, group, (group + task) % n_shards)

    return run


def _class_scores(model: Model, keys: np.ndarray, context: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(class | context) of each (context, class); ``n``: how often it was seen, ``context`` ascending.

    A context whose weights have settled leaves the steps with them.
    """
    out = np.empty(len(kinds))
    mask, table, by_class = np.uint64((1 << BITS) - 1), 1 << BITS, np.ascontiguousarray(model.weights.T)
    for a in range(0, len(keys), _CONTEXTS):
        part = keys[a : a + _CONTEXTS]
        lo, hi = np.searchsorted(context, np.array([a, a + len(part)], context.dtype))
        own, kind = context[lo:hi] - a, kinds[lo:hi]
        rows = np.stack([(part >> np.uint64(BITS + _EXTRA)), (part >> np.uint64(_EXTRA)) & mask]).astype(np.int64)
        rows[1] += table
        logits = _by_class(model, rows, by_class)
        seen = np.zeros((CLASSES, len(part)), np.float32)
        seen[kind, own] = n[lo:hi]
        total = seen.sum(axis=0)
        some = np.flatnonzero(total > 0)
        now, seen, total = logits.take(some, axis=1), seen.take(some, axis=1), total[some]
        weights = np.zeros_like(now)
        for _ in range(_STEPS):
            p = _softmax(now.copy())
            p *= total
            move = seen - p
            move -= CLASS_RIDGE * weights
            p += CLASS_RIDGE
            move /= p
            np.clip(move, -2, 2, out=move)
            weights += move
            now += move
            moving = np.maximum(move.max(axis=0), -move.min(axis=0)) >= _SETTLED
            settled, still = np.flatnonzero(~moving), np.flatnonzero(moving)
            logits[:, some[settled]] = now.take(settled, axis=1)
            if len(settled):
                some, now, seen, total, weights = some[still], now.take(still, axis=1), seen.take(still, axis=1), total[still], weights.take(still, axis=1)
            if not len(still):
                break
        logits[:, some] = now
        logits -= logits.max(axis=0)
        out[lo:hi] = logits[kind, own] - np.log(np.exp(logits).sum(axis=0))[own]
    return out


def token_scores(model: Model, token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P of each distinct packed token of a shard (ascending; a rare word without its count); ``n``: how often the
    learning rows hold it."""
    key, word = token >> np.uint64(_WORD_BITS), (token & np.uint64((1 << _WORD_BITS) - 1)).astype(np.int64)
    plain = word < _RARE_WORD
    kinds = CLASSES - RARE_CLASSES + word - _RARE_WORD
    share = np.empty(len(word))
    kinds[plain] = model.kinds[model.by_rank[word[plain]]]
    share[plain] = model.within[model.by_rank[word[plain]]] * np.log(10)
    share[~plain] = -np.log(model.rare_total[word[~plain] - _RARE_WORD])
    new = np.append(True, key[1:] != key[:-1])
    context = np.cumsum(new, dtype=np.int32) - 1
    edge = np.flatnonzero(new | np.append(True, kinds[1:] != kinds[:-1]))  # words of a class are neighbours: ranks ascend
    group = np.repeat(np.arange(len(edge), dtype=np.int32), np.diff(np.append(edge, len(token))))
    seen = np.add.reduceat(n, edge).astype(float)
    out = share + _class_scores(model, key[new], context[edge], kinds[edge], seen)[group]
    learnt = np.flatnonzero(plain & (n > 0))
    if not len(learnt):
        return out / np.log(10)
    size = np.zeros(len(edge))
    q, times = np.exp(share[learnt]), n[learnt].astype(float)
    weights = np.zeros(len(learnt))
    for _ in range(_STEPS):  # groups that have settled leave the steps
        first = np.flatnonzero(np.append(True, np.diff(group[learnt]) > 0))
        lengths = np.diff(np.append(first, len(learnt)))
        p = q * np.exp(weights)
        p *= np.repeat(seen[group[learnt[first]]] / (1 + np.add.reduceat(p - q, first)), lengths)
        move = np.clip((times - p - WORD_RIDGE * weights) / (p + WORD_RIDGE), -2, 2)
        weights += move
        out[learnt] += move
        size[group[learnt[first]]] = np.log1p(np.add.reduceat(q * np.expm1(weights), first))
        still = np.repeat(np.maximum.reduceat(np.abs(move), first) >= _SETTLED, lengths)
        if not still.any():
            break
        learnt, q, times, weights = learnt[still], q[still], times[still], weights[still]
    out -= np.where(plain, size[group], 0)
    return out / np.log(10)


def _occurrence_scores(model: Model, token: np.ndarray, flags: np.ndarray, n: np.ndarray, summed: np.ndarray) -> np.ndarray:
    """log10 P of each packed token of a shard, as they come; ``summed``: counts of a dealt context.

    A context needs its own tokens only, so about ``_PORTION`` of them are trained at once.
    """
    order = np.argsort(token).astype(np.uint32)
    ranked = token[order]
    out = np.empty(len(token))
    a = 0
    while a < len(ranked):
        b = len(ranked)
        if a + _PORTION < b:  # up to the end of a context
            b = int(np.searchsorted(ranked, ((ranked[a + _PORTION] >> np.uint64(_WORD_BITS)) + np.uint64(1)) << np.uint64(_WORD_BITS)))
            b = len(ranked) if b <= a else b  # no context above the last
        part, here = ranked[a:b], order[a:b]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        seen = np.where(flags[here] & 1, n[here], 0).astype(np.int64)
        own = summed[here]
        if own.any():  # of a dealt context the counts of all its parts are here
            dealt = np.unique(part[own] >> np.uint64(_WORD_BITS))
            seen[~own & np.isin(part >> np.uint64(_WORD_BITS), dealt)] = 0
        learnt = np.add.reduceat(seen, edge)
        out[here] = np.repeat(token_scores(model, part[edge], learnt), np.diff(np.append(edge, len(part))))
        a = b
    return out


def _fit(model: Model):
    """Trains the weights of a shard's contexts and replies each group's sums by text; rows of texts pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, parts = [], []
        for batch in batches:
            texts = batch.column("texts")
            rows = batch.filter(pc.invert(texts))
            groups += rows.column("group").to_pylist()
            parts += [_from_planes(body.as_py(), "uint64", "uint32", "uint32") for body in rows.column("body")]
            passed = batch.filter(texts).select(["group", "texts", "body"])
            del batch, texts, rows
            yield passed
            del passed
        if not parts:
            return
        lengths = [len(p[0]) for p in parts]
        token = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        flags, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        del parts
        values = _occurrence_scores(model, token, flags, n, np.repeat(np.array(groups) < 0, lengths))
        values *= n
        del token, n
        at, replies = 0, []
        for group, k in zip(groups, lengths):
            if group < 0:
                at += k
                continue
            doc = (flags[at : at + k] >> 1).astype(np.int64)
            sums = np.bincount(doc, values[at : at + k])
            some = np.flatnonzero(np.bincount(doc))
            replies.append(_planes(np.diff(some, prepend=0).astype(np.uint32), sums[some].astype(np.float32)))
            at += k
        groups = [group for group in groups if group >= 0]
        for a in range(0, len(groups), 4096):
            m = len(groups[a : a + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups[a : a + m], pa.int64()), pa.array(np.zeros(m, bool)), pa.array(replies[a : a + m], pa.binary())], ["group", "texts", "body"]
            )

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the replies to the texts of their group; rows come ordered by group."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bodies, is_texts = rows.column("body"), rows.column("texts")
        packed = zstandard.ZstdDecompressor().decompress(bodies.filter(is_texts)[0].as_py())
        texts = pa.ipc.open_stream(packed).read_all()
        sums = np.zeros(len(texts))
        for body in bodies.filter(pc.invert(is_texts)):
            step, values = _from_planes(body.as_py(), "uint32", "float32")
            sums[np.cumsum(step)] += values
        yield from texts.append_column("model", pa.array(sums)).to_batches(max_chunksize=common.BATCH_ROWS)

    held, current = [], None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(ids)).tolist()):
            if held and ids[a] != current:
                yield from whole(held)
                held = []
            current = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from whole(held)


def scores(documents: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, token_score (score by token) of each row; the
    learning rows train the model first."""
    if frequent > _RARE_WORD:
        raise ValueError(f"at most {_RARE_WORD} frequent words")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    learning = docs.where(remainder() != HELD_OUT)
    counts = count_words(learning)
    model = train(learning, prepare(counts, frequent))
    counted = hot_contexts(learning, model)
    common.release(spark)
    n_shards = max(common.size_partitions(spark), -(-model.n * FOLDS // (FOLDS - 1) // SHARD))
    rows = docs.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "text")
    packed = rows.mapInArrow(_pack(model, n_shards), _PACKED)
    if counted is not None:
        packed = packed.unionByName(counted.mapInArrow(_deal_counts(model, n_shards), _PACKED))
    replied = packed.repartitionById(n_shards, F.col("shard")).mapInArrow(_fit(model), _REPLIED).repartition(n_shards, "group").sortWithinPartitions("group")
    folded = replied.mapInArrow(_fold, _SUMMARY + ", model double")
    summary = common.staged(folded.withColumn("row", F.monotonically_increasing_id()), "maxent")  # the row numbers are fixed from here on
    common.release(spark)
    rare = summary.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    known = rare.join(counts.select("word", "c"), "word").groupBy("row")
    sums = known.agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"), F.sum("n").alias("rare_known"))
    extra = F.coalesce("rare_sum", F.lit(0.0))
    size = float(np.log10(model.n + model.v + 1))
    score = F.col("model") + extra
    return summary.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * size).alias("base_score"),
        score.alias("score"),
        (score / F.col("n_tokens")).alias("token_score"),
    )
