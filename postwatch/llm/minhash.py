"""Document fingerprints by MinHash over five-word shingles, and near-duplicate pairs from their bands.

Words are runs of bytes other than ASCII white space; a text of one to four words is one shingle; one without words has the
empty fingerprint. Shingle hashes go through ``PERMUTATIONS`` universal hashes ``(a * h + b) mod 2**64`` (a odd; the high half
counts), the least value of each is found, and 16 bits of it are kept. The likeness of two fingerprints is the share of
equal components; two texts without words are alike (1), one without and one with words are not (0).

The edited text of a document replaces its last quarter by the beginning of the next document. The shingles of the kept
three quarters go through the permutations once for both fingerprints. To bring neighbours together, documents are dealt
into stretches of ids, whose bounds come from a sample of the ids, and sorted inside them; the first document of each
stretch is also sent to the stretch before. The driver sees the bounds only.

Near copies: texts whose signatures agree in all ``ROWS`` components of one of ``BANDS`` bands are candidates, joined to the
least member of their band, and links between candidates are verified by the exact Jaccard similarity of their distinct
shingles, ``THRESHOLD`` or more (:mod:`postwatch.llm.linking`). Copies of a text are one member. The similarity 0.8 is missed
by all bands with a probability of 0.00005. Two texts without words are alike there, too.

Defined cases: a null text is empty; a null doc_id comes before all others; rows of one doc_id are ordered by their text,
equal rows follow one another; the next of the last row is the first one, also if that is itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import anchors, common, linking

SHINGLE = 5
PERMUTATIONS = 128
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
NO_WORDS = np.uint32(0xFFFFFFFF)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A = common.random_bits(11, PERMUTATIONS) | np.uint64(1)
_B = common.random_bits(12, PERMUTATIONS)


def _lowest(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least value of every permutation over each stretch of hashes (all ones where a stretch is empty)."""
    out = np.full((PERMUTATIONS, len(counts)), NO_WORDS, np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        begins = (np.cumsum(counts) - counts)[some]
        buffer, high = np.empty(len(hashes), np.uint64), np.empty(len(hashes), np.uint32)
        for k in range(PERMUTATIONS):
            np.multiply(hashes, _A[k], out=buffer)
            buffer += _B[k]
            buffer >>= np.uint64(32)
            high[:] = buffer
            out[k, some] = np.minimum.reduceat(high, begins)
    return out


def shingles(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of separated texts, how many each text has, where each ends in the data, and words per text."""
    starts, ends = common.words_of(data, ~_SPACE[data])
    before = np.searchsorted(starts, marks)
    n_words = np.diff(before)
    words = common.span_hashes(data, starts, ends)
    grams = common.gram_hashes(words, SHINGLE)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    n = len(grams)
    whole = doc[:n] == doc[len(doc) - n :] if n else np.zeros(0, bool)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):  # a short text: its words make one shingle
        spelled = np.array([common.gram_hashes(words[a:b], b - a)[0] for a, b in zip(before[few], before[few + 1])], np.uint64)
        values = np.concatenate([grams[whole], spelled])
        text = np.concatenate([doc[:n][whole], few])
        closes = np.concatenate([ends[SHINGLE - 1 :][whole], ends[before[few + 1] - 1]])
        order = np.argsort(text, kind="stable")
        values, text, closes = values[order], text[order], closes[order]
    else:
        values, text, closes = grams[whole], doc[:n][whole], ends[SHINGLE - 1 :][whole] if n else np.zeros(0, np.int64)
    return values, np.bincount(text, minlength=len(n_words)), closes, n_words


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of components per text."""
    values, counts, _, _ = shingles(*common.separated(texts, 32))
    return (_lowest(values, counts).T & np.uint32(0xFFFF)).astype(np.uint16)


def hexed(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key of each band of the signatures; keys of different bands differ."""
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for band in range(BANDS):
        for k in range(band * ROWS, (band + 1) * ROWS):
            keys[:, band] = common.mixed(keys[:, band] * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, k] + np.uint64(band + 1))
    return keys.view(np.int64)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        listed = common.lists(pa.array(band_keys(signatures(texts)).ravel()), np.full(len(texts), BANDS))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), listed], ["id", "x", "cls", "bands"])


def _bands_of(texts: list[str]) -> list[list[int]]:
    return [row for _, part in common.portions(texts) for row in band_keys(signatures(part)).tolist()]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two texts given as distinct shingles; texts without words are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _measure(threshold: float):
    def of(texts: list[str]) -> tuple[Callable[[int, int], bool], None]:
        known: dict[int, np.ndarray] = {}

        def distinct(k: int) -> np.ndarray:
            if k not in known:
                known[k] = np.unique(shingles(*common.separated(common.utf8(pa.array([texts[k]], pa.string())), 32))[0])
            return known[k]

        return lambda a, b: jaccard(distinct(a), distinct(b)) >= threshold, None

    return of


def near_copies(documents: DataFrame, threshold: float = THRESHOLD, group_bytes: int = linking.GROUP_BYTES) -> DataFrame:
    """Per row of documents: doc_id, class_id (the least doc_id of its group), kept (it is the one that stays)."""
    docs = anchors.keyed(documents)
    summary = common.staged(docs.mapInArrow(_summarise, "id long, x long, cls binary, bands array<long>"), "minhash")
    return linking.public(linking.classes(docs, summary, _bands_of, _measure(threshold), "minhash", group_bytes))


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Components of all texts, and of the edited texts of all but the last, and these as bytes."""
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    kept = np.array([len(t[: len(t) - len(t) // 4].encode()) for t in texts[:-1]] + [0], np.int64)
    values, counts, closes, n_words = shingles(*(plain := common.separated(common.utf8(pa.array(texts)), 32)))
    edits, edit_counts, edit_closes, edit_words = shingles(*(other := common.separated(pa.array(changed, pa.large_binary()), 32)))
    kept[:-1][(n_words[:-1] < SHINGLE) | (edit_words < SHINGLE)] = 0
    # shingles that end before the cut, with a space behind them, belong to both texts
    text = np.repeat(np.arange(len(texts)), counts)
    same = closes < plain[1][text] + 1 + kept[text]
    n_same = np.bincount(text[same], minlength=len(texts))
    parts = _lowest(values, np.stack([n_same, counts - n_same], 1).ravel())
    both, rest = parts[:, ::2], parts[:, 1::2]
    text = np.repeat(np.arange(len(changed)), edit_counts)
    fresh = edit_closes >= other[1][text] + 1 + kept[text]
    tail = _lowest(edits[fresh], np.bincount(text[fresh], minlength=len(changed)))
    cut = lambda least: (least.T & np.uint32(0xFFFF)).astype(np.uint16)
    return cut(np.minimum(both, rest)), cut(np.minimum(both[:, :-1], tail)), changed


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stretch and order; the last of a stretch only serves the one before it."""
    carried: list[tuple] = []
    for batch, _ in common.chunks(batches):
        rows = carried + list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        carried = rows[-1:]
        if len(rows) < 2:
            continue
        texts = [r[2] for r in rows]
        own, changed, bodies = fingerprints(texts)
        real = np.flatnonzero([a[0] == b[0] for a, b in zip(rows, rows[1:])])
        take = lambda values: [values[k] for k in real]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(take([r[1] for r in rows]), pa.int64()),
                pa.array(take([len(t) for t in texts]), pa.int64()),
                pa.array(take([common.sha(b) for b in bodies]), pa.string()),
                pa.array(take(hexed(own)), pa.string()),
                pa.array(take(hexed(changed)), pa.string()),
                pa.array(likeness(own[:-1], changed)[real]),
                pa.array(likeness(own[:-1], own[1:])[real]),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _stretch(bounds: list[tuple[int, int]]):
    """A function that numbers the stretch of (id, x) rows; the bounds are the first rows of all stretches but the first."""
    ids, xs = (np.array(c, np.int64) for c in zip(*bounds)) if bounds else (np.zeros(0, np.int64),) * 2

    @F.pandas_udf("int")
    def number(key: pd.Series, x: pd.Series) -> pd.Series:
        key, x = key.to_numpy(), x.to_numpy()
        low, high = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
        out = low.astype(np.int32)
        for k in np.flatnonzero(high > low):  # an id that is a bound itself
            out[k] += np.searchsorted(xs[low[k] : high[k]], x[k], "right")
        return pd.Series(out)

    return number


def _bounds(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """About n - 1 rows that cut the ordered rows into even stretches, from a sample of about 64 rows a stretch."""
    total = keys.count()
    share = max(1, total // (64 * n))
    sample = sorted({(r[0], r[1]) for r in keys.where(F.pmod(F.hash("id", "x"), F.lit(share)) == 0).collect()})
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def with_edits(documents: DataFrame, stretches: int | None = None) -> DataFrame:
    """Per row of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    docs = anchors.keyed(documents).drop("cls")
    n = stretches or 2 * common.size_partitions(spark)
    number = _stretch(_bounds(docs.select("id", "x"), n))
    numbered = docs.withColumn("part", number("id", "x"))
    firsts = docs.select("id", "x").withColumn("part", number("id", "x")).groupBy("part").agg(F.min(F.struct("id", "x")).alias("k"))
    heads = sorted((r.part, r.k.id, r.k.x) for r in firsts.collect())  # as many rows as there are stretches
    if not heads:
        return spark.createDataFrame([], RESULT)
    before = [(heads[k - 1][0], *heads[k][1:]) for k in range(len(heads))]  # the first stretch of all follows the last
    places = spark.createDataFrame(before, "to int, id long, x long")
    tails = docs.join(F.broadcast(places), ["id", "x"]).dropDuplicates(["to"]).select("id", "x", "text", F.col("to").alias("part"))
    rows = numbered.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    dealt = rows.repartition(n, "part").sortWithinPartitions("part", "tail", "id", "x").select("part", "id", "text")
    schema = RESULT.replace("doc_id", "id")
    return dealt.mapInArrow(_neighbours, schema).select(anchors.public_id(), *[c.split()[0] for c in RESULT.split(", ")[1:]])
