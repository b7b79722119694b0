"""URL queues kept as CSV: all columns text, quoted newlines allowed, file order kept in ``pos``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType

_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


def _header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    """Column names; reads the first record of one file only."""
    return spark.read.options(**_OPTIONS, multiLine=multi_line, inferSchema=False).csv(path).columns


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False, whole: bool = False) -> DataFrame:
    """Header-named scan with ``pos``, the row number of each file from 0; with ``whole`` of all files, taken by their names.

    Spark splits large files. ``multi_line=True`` allows line breaks in quoted fields; each file is then one task's work.
    """
    names = columns or _header(spark, path, multi_line)
    schema = StructType([StructField(name, StringType()) for name in names])
    rows = spark.read.schema(schema).options(**_OPTIONS, multiLine=multi_line, enforceSchema=True).csv(path)
    return with_row_index(rows, whole)


def with_row_index(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Number the rows of every file (``whole``: of all files) from 0 in file order, as ``pos`` beside ``source_file``.

    Each split counts its own rows (map side) and the running totals run over split counts. These are one short row
    per split and are joined back by split: a broadcast while they are small, otherwise a join whose keys hold no more
    rows than one split does.
    """
    tagged = rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_serial"),
    )
    splits = tagged.groupBy("source_file", "_block").agg(F.min("_serial").alias("_first"), F.count("*").alias("_rows"))
    order = W.orderBy("source_file", "_block") if whole else W.partitionBy("source_file").orderBy("_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("source_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    return (
        tagged.join(offsets, ["source_file", "_block"])
        .withColumn("pos", F.col("_base") + F.col("_serial") - F.col("_first"))
        .drop("_block", "_serial", "_first", "_base")
    )


def positional(queue: DataFrame, column: int = 1) -> DataFrame:
    """Rows whose n-th column (from 0) holds a URL, under the index they have among **all** rows."""
    named = [name for name in queue.columns if name not in ("pos", "source_file")]
    url = F.col(f"`{named[column]}`")
    return queue.select("pos", url.alias("url")).where(url.isNotNull() & (url != ""))
