"""Ranked lexical search by per-term geometric blocking: the exact best documents for each item of a query table.

A posting list is cut into blocks of similar documents: the documents of a list go to the pivot whose projected vector is
nearest. A block keeps the coordinatewise maximum of its documents' term impacts, so the summary's product with an item is no less
than the score of any document in the block. An item goes through its terms' lists, the ones that can add most first, and scores
the documents of a block only if the block's bound reaches its ``k``-th best score so far; it stops when all lists that are left
cannot add up to that score. A document that stands in an earlier list was scored or passed over by its bound there, so a bound
counts the terms from the current one on. No bound is an estimate: what is passed over scores less than ``k`` others.

Plan: one pass over the texts keeps for each document its length and the occurrences of those terms that items have (no other
term adds to a score), written once. Document counts and totals are aggregates over that table. Its rows then fill shards of
``SHARD`` postings, each with its lists and blocks, and the best of each task are ranked by Spark; the best scores a task has
found hold for its next shards. A summary has the coordinates of terms that share an item with its list's term, as only those are
ever asked for. Items are taken in blocks of ``ITEM_BYTES`` of text, each with its own pass.

Score, all 64-bit integers: a term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``; its impact in a document is
``10**9 * tf div (1000 * tf + 8 * m)`` with ``m = 25 + 75 * n * N div L``.

Defined cases: a null or empty text has no terms and no rank, as document and as item; a null doc_id counts as smaller than any
other; rows of documents or items that are equal are ranked each for itself; an item's repeated terms count repeatedly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from postwatch.llm import common

BEST = 10
SHARD = 1 << 19  # postings that are indexed together
ITEM_BYTES = 8 << 20
BLOCK, BLOCKS = 64, 128  # documents of a block as a rule; blocks of a list at most
DIMENSIONS = 16  # of the projected vectors that measure likeness
ROUND = 8  # blocks that are scored before the bounds are looked at again
_NO_ID = -(1 << 63)
_IMPACT_BITS = 20  # an impact is below 10**6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and of each term its start, end and text."""
    data, marks = common.separated(texts, 32)
    data = _FOLD[data]
    starts, ends = common.words_of(data, _IN_TERM[data])
    return data, starts, ends, np.searchsorted(marks, starts) - 1


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Items:
    """Items as term numbers and occurrences, and their vocabulary; ``ids`` is an Arrow array."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        data, starts, ends, item = terms_of(common.utf8(texts))
        words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        self.ids, self.vocabulary = ids, sorted(set(words))
        number = {w: k for k, w in enumerate(self.vocabulary)}
        term = np.array([number[w] for w in words], np.int64)
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(ids)):
            self.terms.append(np.unique(term[item == k], return_counts=True))
        self.data, self.offsets = common.flat(pa.array(self.vocabulary, pa.large_binary()))
        self.data = self.data.copy()
        hashes = common.span_hashes(self.data, self.offsets[:-1], self.offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each term, -1 for one that it does not have: hashes select, the bytes decide."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.vocabulary):
            return out
        h = common.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        number = self.order[at[hit]]
        sizes = (ends - starts)[hit]
        same = sizes == np.diff(self.offsets)[number]
        hit, number, sizes = hit[same], number[same], sizes[same]
        if len(hit):
            equal = data[stretches(starts[hit], sizes)] == self.data[stretches(self.offsets[number], sizes)]
            whole = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            out[hit[whole]] = number[whole]
        return out


def _postings(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(items.vocabulary), 1)
        for batch, texts in common.chunks(batches):
            data, starts, ends, doc = terms_of(texts)
            number = items.numbers(data, starts, ends)
            key, tf = np.unique(doc[number >= 0] * size + number[number >= 0], return_counts=True)
            listed = np.bincount(key // size, minlength=len(texts))
            n = np.bincount(doc, minlength=len(texts))
            columns = [batch.column(0), pa.array(n, pa.int64()), common.lists(pa.array(key % size, pa.int32()), listed), common.lists(pa.array(tf, pa.int32()), listed)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tf"])

    return run


class Weights:
    """What the items' terms weigh, and which terms share an item."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, df: dict[int, int]):
        self.n_docs, self.n_terms, self.size = n_docs, n_terms, max(len(items.vocabulary), 1)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(self.size)], np.int64)
        self.items = [(t, c * self.weight[t]) for t, c in items.terms]
        self.holders: dict[int, list[int]] = {}
        for k, (terms, _) in enumerate(self.items):
            for t in terms.tolist():
                self.holders.setdefault(t, []).append(k)
        signs = common.random_bits(31, self.size * DIMENSIONS).reshape(self.size, DIMENSIONS) >> np.uint64(63)
        self.signs = signs.astype(np.float32) * 2 - 1

    def company(self, term: int) -> np.ndarray:
        return np.unique(np.concatenate([self.items[k][0] for k in self.holders[term]]))


class Best:
    """The first documents of an item so far: by score, then id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A score that a document must reach to come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        high = score >= self.least()
        score, id_ = np.concatenate([self.score, score[high]]), np.concatenate([self.id, id_[high]])
        order = np.lexsort((id_, -score))[: self.k]
        self.score, self.id = score[order], id_[order]


class Shard:
    """The posting lists of some documents; a list's blocks are made when it is first asked for."""

    def __init__(self, weights: Weights, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.weights, self.ids = weights, ids
        m = 25 + 75 * n * weights.n_docs // max(weights.n_terms, 1)
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.first, self.sizes, self.term = np.cumsum(sizes) - sizes, sizes, term
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(term[order], np.arange(weights.size + 1))
        self.most = np.zeros(weights.size, np.int64)
        np.maximum.at(self.most, term, self.impact)
        share = (weights.weight[term] * self.impact).astype(np.float32)
        self.vectors = np.stack([np.bincount(doc, share * weights.signs[term, k], len(ids)) for k in range(DIMENSIONS)], axis=1).astype(np.float32)
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the list in the order of its blocks, the blocks' offsets, and the summaries: sorted (coordinate, block), maximum."""
        if term not in self.made:
            docs = self.list_doc[self.list_at[term] : self.list_at[term + 1]]
            wanted = min(-(-len(docs) // BLOCK), BLOCKS)
            pivots = docs[:: -(-len(docs) // wanted)]
            block = np.argmax(self.vectors[docs] @ self.vectors[pivots].T, axis=1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            offsets = np.searchsorted(block, np.arange(len(pivots) + 1))
            self.made[term] = (docs, offsets, *self._summaries(docs, block, len(pivots), self.weights.company(term)))
        return self.made[term]

    def _summaries(self, docs: np.ndarray, block: np.ndarray, n_blocks: int, company: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = self.list_at[company + 1] - self.list_at[company]
        if self.sizes[docs].sum() <= lists.sum():  # from the documents' terms, or from the lists, whichever is less to read
            place = stretches(self.first[docs], self.sizes[docs])
            coordinate, impact, of = self.term[place], self.impact[place], np.repeat(block, self.sizes[docs])
            keep = np.isin(coordinate, company)
        else:
            place = stretches(self.list_at[company], lists)
            known = np.full(len(self.ids), -1, np.int64)
            known[docs] = block
            coordinate, impact, of = np.repeat(company, lists), self.list_impact[place], known[self.list_doc[place]]
            keep = of >= 0
        packed = np.sort((coordinate[keep] * n_blocks + of[keep]) << _IMPACT_BITS | impact[keep])
        key = packed >> _IMPACT_BITS
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        return key[last], packed[last] & ((1 << _IMPACT_BITS) - 1)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        sizes = self.sizes[docs]
        place = stretches(self.first[docs], sizes)
        return np.add.reduceat(weight[self.term[place]] * self.impact[place], np.cumsum(sizes) - sizes)

    def search(self, item: int, best: Best) -> None:
        terms, weight = self.weights.items[item]
        share = weight * self.most[terms]
        order = np.argsort(-share, kind="stable")
        terms, weight, share = terms[order], weight[order], share[order]
        left = np.cumsum(share[::-1])[::-1]
        every = np.zeros(self.weights.size, np.int64)
        every[terms] = weight
        seen = np.zeros(len(self.ids), bool)
        for k, term in enumerate(terms.tolist()):
            if left[k] < best.least():
                return
            if not share[k]:
                continue
            docs, offsets, key, most = self.blocks(term)
            n_blocks = len(offsets) - 1
            begin, end = np.searchsorted(key, terms[k:] * n_blocks), np.searchsorted(key, (terms[k:] + 1) * n_blocks)
            place = stretches(begin, end - begin)
            bound = np.zeros(n_blocks, np.int64)
            np.add.at(bound, key[place] % n_blocks, np.repeat(weight[k:], end - begin) * most[place])
            open_ = np.argsort(-bound, kind="stable")
            for at in range(0, n_blocks, ROUND):
                some = open_[at : at + ROUND]
                some = some[bound[some] >= best.least()]
                if not len(some):
                    break
                found = docs[stretches(offsets[some], offsets[some + 1] - offsets[some])]
                found = found[~seen[found]]
                if len(found):
                    seen[found] = True
                    best.add(self.scores(found, every), self.ids[found])


def _search(weights: Weights, ids: pa.Array, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in weights.items]

        def index(held: list[pa.RecordBatch]) -> None:
            rows = pa.concat_batches(held)
            terms, tf = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            sizes = rows.column(2).value_lengths().to_numpy().astype(np.int64)
            own = Shard(weights, rows.column(0).to_numpy(), rows.column(1).to_numpy(), sizes, terms, tf)
            for item, first in enumerate(best):
                own.search(item, first)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= shard:
                index(held)
                held, n = [], 0
        if n:
            index(held)
        for item, first in enumerate(best):
            if len(first.score):
                at = pa.array(np.full(len(first.score), item), pa.int64())
                yield pa.RecordBatch.from_arrays([at, ids.take(at), pa.array(first.id), pa.array(first.score)], ["item", "item_id", "id", "score"])

    return run


def search(documents: DataFrame, queries: DataFrame, k: int = BEST, shard: int = SHARD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``queries`` (item_id, text)."""
    spark = documents.sparkSession
    asked = queries.select("item_id", common.text_of().alias("text"), F.monotonically_increasing_id().alias("r"))
    asked = common.staged(asked, "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes) or 1
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("r"), F.lit(blocks)) == block).orderBy("r").toArrow()
        one = _ranked(documents, Items(part.column(0).combine_chunks(), part.column(1).combine_chunks()), queries.schema["item_id"].dataType.simpleString(), k, shard)
        found = one if found is None else found.unionByName(one)
    return found


def _ranked(documents: DataFrame, items: Items, id_type: str, k: int, shard: int) -> DataFrame:
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    postings = common.staged(rows.mapInArrow(_postings(items), "id long, n long, terms array<int>, tf array<int>"), "postings")
    n_docs, n_terms, n_postings = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").count()  # as many rows as the items have terms
    weights = Weights(items, n_docs, n_terms, {row[0]: row[1] for row in df.collect()})
    # tasks of at least a shard: blocks pay off in long lists, and no shuffle is needed to bring rows together
    held = postings.where(F.size("terms") > 0).coalesce(max(1, n_postings // shard))
    best = held.mapInArrow(_search(weights, items.ids, k, shard), f"item long, item_id {id_type}, id long, score long")
    first = W.partitionBy("item").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif(F.col("id"), F.lit(_NO_ID)).alias("doc_id"), "score")
