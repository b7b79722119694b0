"""The postings store: parsed search responses as runs, dealt into parts by search; the newest response of a search counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postwatch import schemas
from postwatch.operators import postings
from postwatch.schemas import SEARCH_KEY
from postwatch.sinks import generations, runs


def _part():
    return runs.part_of(*[F.col(c) for c in SEARCH_KEY])


def _schema(spark: SparkSession) -> StructType:
    landed = schemas.empty(spark, schemas.RESPONSES)
    return postings.parse_responses(landed.withColumn("version", F.xxhash64("body"))).schema


def write(landed: DataFrame, root: str, run_id: str) -> DataFrame:
    """Parse landed responses (SEARCH_KEY, run, arrived, body), keep the newest of each search, and return the run's rows.

    A response that breaks the rules is kept without postings, with its reason: it takes the place of older ones all the same.
    """
    spark = landed.sparkSession
    given = landed.select(*schemas.RESPONSES.names).withColumn("version", F.xxhash64("body"))
    rows = postings.parse_responses(postings.newest(given)).withColumn("part", _part())
    runs.write_run(rows, f"{root}/responses", run_id, ["part"])
    return runs.read_runs(spark, f"{root}/responses", StructType([*_schema(spark).fields, runs.PART])).where(F.col("run_id") == run_id)


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = StructType([*_schema(spark).fields, runs.PART])
    return runs.read_runs(spark, f"{root}/responses", schema)


def read(spark: SparkSession, root: str, searches: DataFrame | None = None) -> DataFrame:
    """Typed postings of the newest response of each search, of all or of ``searches`` (SEARCH_KEY) from their parts only."""
    rows = _rows(spark, root).where(generations.visible(generations.current(spark, f"{root}/responses")))
    if searches is not None:
        dealt = searches.select(*SEARCH_KEY, _part()).distinct()
        rows = runs.in_parts(rows, dealt).join(dealt.drop("part"), SEARCH_KEY, "left_semi")
    kept = postings.newest(rows.drop("run_id", "part"))
    return postings.explode_postings(kept).drop("run", "arrived", "version")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, root).where("reject_reason IS NOT NULL").select("run_id", *SEARCH_KEY, "run", "reject_reason")


def compact(spark: SparkSession, root: str, which: Callable[[str], bool] = lambda run: True) -> bool:
    """Fold the runs that ``which`` takes: the newest response of each search is kept."""
    path = f"{root}/responses"
    taken = generations.folded_rows(generations.current(spark, path), which, generations.run_ids(spark, [path]))

    def fold(base: str) -> None:
        rows = postings.newest(_rows(spark, root).where(taken).drop("run_id", "part"))
        runs.write_run(rows.withColumn("part", _part()), path, base, ["part"])

    return generations.compact(spark, path, [path], fold, which)
