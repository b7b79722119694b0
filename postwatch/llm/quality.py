"""Quality classifier by compression: one zstandard dictionary from good and one from bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, each compressed with either dictionary; with the sums g and b of the compressed
sizes, the normalised difference (b - g) / (b + g) tells which kind of text it is more like. A logistic calibration on
other labelled rows turns the difference, together with the compressed share of the text, into a score from 0 to 1.

Learned from: labelled rows whose crc32 of the doc_id (as text) modulo 5 is not 0, half of them for the dictionaries (the
``DICT_ROWS`` of least id hash for each label, of these all that fit into ``DICT_BYTES``; a text of more than ``LONG_BYTES`` gives
as many bytes in blocks spread over it), half for the calibration (``FIT_ROWS``). Only these dictionaries' texts are brought
to the driver. Everything else covers all rows and whole texts.

Defined cases: a null text is empty and gets a score like any other; labels that are null, or whose document is missing,
teach nothing; with one kind of label only, or none, every score is the share of good labels (one more of each counted);
rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from postwatch.llm import common

BLOCK = 512
LEVEL = 3
DICT_SIZE = 32768
DICT_ROWS = 4000
DICT_BYTES = 4 << 20
LONG_BYTES = DICT_BYTES // 16
FIT_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def _blocks(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]


def spread(text: bytes) -> bytes:
    """The text, or of a long one ``LONG_BYTES`` in blocks that are spread over it evenly."""
    if len(text) <= LONG_BYTES:
        return text
    n, most = len(text) // BLOCK, LONG_BYTES // BLOCK
    return b"".join(text[at : at + BLOCK] for at in (k * n // most * BLOCK for k in range(most)))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spread(t.encode()) for t in texts.to_pylist()], pa.binary())], ["doc_id", "body"])


def dictionary(texts: list[bytes]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_SIZE, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"".join(blocks)[-DICT_SIZE:]


class Sizes:
    """Compressed sizes of texts with the two dictionaries."""

    def __init__(self, bad: bytes, good: bytes):
        self.pair = [self._compressor(body) for body in (bad, good)]

    @staticmethod
    def _compressor(body: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(body)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float]:
        """Normalised difference, and compressed bytes per byte."""
        blocks = _blocks(text)
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return ((bad - good) / (bad + good), good / len(text)) if blocks else (0.0, 0.0)


@dataclass
class Model:
    bad: bytes
    good: bytes
    weights: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_inputs(features) @ np.array(self.weights)))


def _inputs(features: np.ndarray) -> np.ndarray:
    difference, share = features[:, 0] * 10, np.minimum(features[:, 1], 1.0)
    short = np.exp(-8 * share)
    columns = [np.ones(len(share)), difference, share, short, difference * share, difference**2]
    return np.stack(columns, 1)


def calibrated(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a small penalty."""
    x = _inputs(features)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 0.01 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _featured(bad: bytes, good: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bad, good)
        for batch, texts in common.chunks(batches):
            pairs = np.array([sizes.features(t.encode()) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["y", "difference", "share"])

    return run


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").where(remainder() != 0).withColumn("h", F.xxhash64("doc_id"))
    texts: list[list[bytes]] = []
    for y in (0, 1):
        chosen = known.where(F.col("y") == y).where("h % 2 = 0").orderBy("h", "doc_id").limit(DICT_ROWS).select("doc_id", "h").distinct()
        n = F.sum(F.least(F.octet_length("text"), F.lit(LONG_BYTES))).alias("n")
        sized = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h").agg(n)
        take, held = [], 0
        for row in sorted(sized.collect(), key=lambda r: (r.h, r.doc_id)):  # at most DICT_ROWS rows without texts
            if row.n and held + row.n <= DICT_BYTES:  # one that does not fit takes no room from the others
                held += row.n
                take.append(row.doc_id)
        rows = docs.where(F.col("doc_id").isin(take)).mapInArrow(_spread, "doc_id long, body binary").collect() if take else []
        texts.append([bytes(r.body) for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.body))) if r.body])
    counts = dict(known.groupBy("y").count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    constant = Model(b"", b"", [float(np.log(share / (1 - share))), 0, 0, 0, 0, 0])
    if not all(texts):
        return constant
    bad, good = map(dictionary, texts)
    rest = known.where("h % 2 <> 0").orderBy("h", "doc_id").limit(FIT_ROWS).select("doc_id", "y")
    pairs = docs.join(rest, "doc_id").select("y", "text").mapInArrow(_featured(bad, good), "y int, difference double, share double").collect()
    rows = np.array([tuple(r) for r in pairs], float).reshape(-1, 3)
    if not 0 < rows[:, 0].sum() < len(rows):
        return constant
    rows = rows[np.lexsort(rows.T)]
    return Model(bad, good, calibrated(rows[:, 1:], rows[:, 0]))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.bad, model.good) if model.good else None
        for batch, texts in common.chunks(batches):
            features = np.array([sizes.features(t.encode()) if sizes else (0.0, 0.0) for t in texts.to_pylist()])
            score = model.score(features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), "text")
    return rows.mapInArrow(_scores(model), RESULT)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted good, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.bad, model.good) if model.good else None
        for batch, texts in common.chunks(batches):
            features = np.array([sizes.features(t.encode()) if sizes else (0.0, 0.0) for t in texts.to_pylist()])
            yield batch.filter(pa.array(model.score(features) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
