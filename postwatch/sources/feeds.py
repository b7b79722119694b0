"""Landed JSON: search responses, score responses, change requests. One document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postwatch import schemas


def landed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one document each, with the file as ``source``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("body")
    )


# Landed lines name what was asked for: the search or the pair that was scored, and the run.
RESPONSE_LINES = "position string, location string, run string, body string"
SCORE_LINES = "user_id string, link string, run string, body string"


def _landed(spark: SparkSession, path: str, lines: str, stream: bool) -> DataFrame:
    """Lines with ``arrived``, when their file was last written: it orders the lines of one run."""
    rows = (spark.readStream if stream else spark.read).schema(lines).json(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def landed_responses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Search responses as JSON lines, each with its search and run; a directory of such files is split like any other."""
    return _landed(spark, path, RESPONSE_LINES, stream)


def landed_scores(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Score responses as JSON lines, each with the pair it is for and the run."""
    return _landed(spark, path, SCORE_LINES, stream)


def change_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines of (seq, kind, body) as a stream over a growing directory."""
    reader = spark.readStream.schema(schemas.CHANGE_FEED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
