"""Helpers shared by the operators: session settings, the shared folder, Arrow batches as flat byte arrays, hashing."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch; a batch is cut further by bytes (:func:`chunks`), so one task's memory stays bounded.
BATCH_ROWS = 256
#: Text bytes that are worked on at once in a task; a single longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_own: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def configure(spark: SparkSession) -> SparkSession:
    # Python workers on this machine import the package from where the driver has it; a cluster gets it by --py-files
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, *paths]))
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; unset, a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="run-llm-", dir="/tmp")
    return _own[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: lineage ends there, a lost executor loses nothing."""
    spark, path = frame.sparkSession, fresh_dir(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are over: its cleaner follows the driver's garbage collector, in a thread
    of its own, and what holds a plan together becomes free in a second round only."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(frame: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = frame.sparkSession
    for name in {path.rsplit("/", 1)[0] for path in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_class(column: str | Column = "text") -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(text_of(column)))


def utf8(values: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty) and with 64-bit offsets."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if pa.types.is_large_binary(values.type) else pc.fill_null(values.cast(pa.large_string()), "")


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large string array, and the offsets of its texts (one more than there are texts)."""
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def separated(values: pa.Array, mark: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ``mark`` before each text and after the last; offsets of the marks (one more than there are texts)."""
    data, offsets = flat(values)
    marks = offsets + np.arange(len(offsets))
    out = np.empty(len(data) + len(offsets), np.uint8)
    keep = np.ones(len(out), bool)
    keep[marks] = False
    out[keep] = data
    out[marks] = mark
    return out, marks


def cuts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and one-past-last of consecutive stretches of about ``most`` (at least one item); offsets: where each item begins, and the end."""
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, upto
        at = upto


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut so that one holds about ``most`` bytes of text (at least one row), each with its texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = utf8(batch.column(batch.schema.get_field_index(text)))
        for at, upto in cuts(flat(values)[1], most):
            yield batch.slice(at, upto - at), values.slice(at, upto - at)


def portions(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The place of the first text of each portion of about ``most`` characters, and the portion's texts."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < most):
            size += len(texts[upto])
            upto += 1
        yield at, utf8(pa.array(texts[at:upto], pa.string()))
        at = upto


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def random_bits(seed: int, n: int) -> np.ndarray:
    """A reproducible table of 64-bit values; counter hashing, so the same on every executor."""
    return mixed(mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)))


_BYTES = random_bits(7, 256)
_POWER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_POWER, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, the same wherever the span stands."""
    power, inverse = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; the first and the last byte of data are none."""
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    return edge[::2], edge[1::2]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[j : n + j]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: block-wise running minima from both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list column of consecutive stretches of the values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def unused(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def size_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BLOCKS = "block int, salt int, body binary"
_SALTS = 8


def block_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's table that are not all zero, as rows to be added up."""
    from pyspark import TaskContext

    some = np.flatnonzero(table.any(axis=1))
    salt = TaskContext.get().partitionId() % _SALTS
    for part in np.array_split(some, max(1, len(some) // 64)):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(np.full(len(part), salt), pa.int32()),
                pa.array([table[k].tobytes() for k in part], pa.binary()),
            ],
            ["block", "salt", "body"],
        )


def _adder(dtype: str, wide: str, out: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, body in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(body, dtype)
                if (block, salt) in total:
                    total[block, salt] += values
                else:
                    total[block, salt] = values.astype(wide)
        for (block, salt), values in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([values.astype(out).tobytes()], pa.binary())], ["block", "salt", "body"]
            )

    return add


def summed(rows: DataFrame, dtype: str) -> Iterator[tuple[int, np.ndarray]]:
    """The sums of the tasks' blocks, added up in two steps on the executors; the result has the fixed size of one table."""
    wide = "int64" if dtype.startswith("int") else "float64"
    between = wide if wide == "int64" else dtype  # counts may outgrow their type, gradients do not
    once = rows.repartition("block", "salt").mapInArrow(_adder(dtype, wide, between), BLOCKS)
    again = once.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(_adder(between, wide, wide), BLOCKS)
    for row in again.toLocalIterator():
        yield row.block, np.frombuffer(row.body, wide)
