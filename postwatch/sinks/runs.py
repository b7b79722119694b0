"""Append-only tables made of one directory per run: ``<table>/run_id=<run>``, and below that ``part=<n>`` where rows are dealt by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from postwatch import schemas
from postwatch.sinks import files

#: Fixed value of the layout: parts of a table that is dealt by key.
PARTS = 64
PART = StructField("part", IntegerType())


def part_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int").alias("part")


def write_run(rows: DataFrame, table: str, run_id: str, by: list[str] | None = None) -> None:
    """``by``: columns that become folders below the run, each combination one file."""
    if by:
        rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(f"{table}/run_id={run_id}")
    else:
        rows.write.mode("overwrite").parquet(f"{table}/run_id={run_id}")


def read_runs(spark: SparkSession, table: str, schema: StructType, without: str | None = None) -> DataFrame:
    """All runs, ``run_id`` included; ``without`` leaves one run's directory unread."""
    whole = StructType([*schema.fields, StructField("run_id", StringType())])
    if not files.names(spark, table):
        return schemas.empty(spark, whole)
    rows = spark.read.schema(whole).parquet(table)
    return rows if without is None else rows.where(F.col("run_id") != without)


def in_parts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows in whose part any of the keys lies; both have ``part``.

    The parts of the keys are at most :data:`PARTS` numbers, so they are broadcast, and the scan of the rows takes them as a dynamic
    partition filter: the folders of other parts are not read. The comparison with 0 is always true; it tells the optimizer that
    the keys are a choice, without which it would not derive that filter.
    """
    return rows.join(F.broadcast(keys.where("part >= 0").select("part").distinct()), "part", "left_semi")


def observed(seen: Observation, names: list[str]) -> dict[str, int]:
    """Counts taken by an action that is over; 0 where the rows to be counted could be none and the optimizer left them out."""
    return seen.get if seen._jo.getRow().length() else dict.fromkeys(names, 0)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Written once and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
