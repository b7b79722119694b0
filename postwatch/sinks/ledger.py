"""The sent ledger: what was delivered to whom. It only grows, and every run anti-joins against all of it.

It is kept in two layouts, and each run owns a folder in both:

- ``<root>/sent_email``, an external table bucketed and sorted by the whole key, for runs over all subscriptions. A run shuffles its
  candidates only: the base, which compaction leaves with one sorted file per bucket, is merged as it lies, and the runs since
  then are small.
- ``<root>/sent_by_key``, dealt into parts by subscription, for polls: they read the parts of their few subscriptions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postwatch import schemas
from postwatch.schemas import LEDGER_KEY, USER_KEY
from postwatch.sinks import files, generations, runs

#: Take about one bucket per 500 MB expected. The number is written down with the first run and holds from then on.
BUCKETS = 64


def paths(root: str) -> tuple[str, str]:
    return f"{root}/sent_email", f"{root}/sent_by_key"


def table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> str:
    """The catalog's name of the bucketed table under ``root``, made known to this session's catalog where it is not yet."""
    path, _ = paths(root)
    name = f"ledger_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        try:
            files.create(spark, f"{path}/_layout/buckets", str(buckets))
        except FileExistsError:
            buckets = int(files.read(spark, f"{path}/_layout/buckets"))
        columns, key = ", ".join(f"{c} string" for c in LEDGER_KEY), ", ".join(LEDGER_KEY)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, run_id string) USING parquet PARTITIONED BY (run_id) "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def append(rows: DataFrame, root: str, run_id: str, buckets: int = BUCKETS) -> None:
    """The run's rows in both layouts, each bucket and each part one file; replaces the rows of ``run_id`` and no others."""
    _write(rows, root, run_id, "OVERWRITE", buckets)


def _write(rows: DataFrame, root: str, run_id: str, how: str, buckets: int = BUCKETS) -> None:
    spark = rows.sparkSession
    name = table(spark, root, buckets)
    n = int(files.read(spark, f"{paths(root)[0]}/_layout/buckets"))
    key = rows.select(*LEDGER_KEY)
    spark.sql(f"INSERT {how} TABLE {name} PARTITION (run_id = {_quoted(run_id)}) SELECT * FROM {{rows}}", rows=key.repartition(n, *LEDGER_KEY))
    runs.write_run(key.withColumn("part", runs.part_of(*[F.col(c) for c in USER_KEY])), paths(root)[1], run_id, ["part"])


def parts(spark: SparkSession, root: str, without: str | None = None) -> list[DataFrame]:
    """The base and the runs since, without one run: what a run over all subscriptions is to be joined with, in turn."""
    if not files.names(spark, paths(root)[0]):
        return []
    if without is not None:
        generations.refuse_folded(spark, paths(root)[0], without)
    now = generations.current(spark, paths(root)[0])
    rows = spark.table(table(spark, root))
    since = rows.where(generations.recent(now))
    found = [since if without is None else since.where(F.col("run_id") != without)]
    if now.base:
        found.insert(0, rows.where(F.col("run_id") == now.base))
    return [part.select(*LEDGER_KEY) for part in found]


def of_subscriptions(spark: SparkSession, root: str, keys: DataFrame, without: str | None = None) -> DataFrame:
    """Ledger rows of some subscriptions, from their parts only."""
    if without is not None:
        generations.refuse_folded(spark, paths(root)[0], without)
    dealt = keys.select(*USER_KEY, runs.part_of(*[F.col(c) for c in USER_KEY])).distinct()
    return runs.in_parts(_by_key(spark, root, without), dealt).join(dealt.drop("part"), USER_KEY, "left_semi").select(*LEDGER_KEY)


def _by_key(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    now = generations.current(spark, paths(root)[0])
    return runs.read_runs(spark, paths(root)[1], StructType([*schemas.LEDGER.fields, runs.PART]), without).where(generations.visible(now))


def read(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """Ledger rows of all runs but ``without``, so that a run done again does not see its own rows."""
    found = parts(spark, root, without) or [schemas.empty(spark, schemas.LEDGER)]
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    return rows


def after_run(ledger: DataFrame, delivered: DataFrame) -> DataFrame:
    """The ledger as it stands once ``delivered`` is appended."""
    return ledger.unionByName(delivered)


def compact(spark: SparkSession, root: str, which: Callable[[str], bool] = lambda run: True) -> bool:
    """Fold the runs that ``which`` takes (never a run that may be done again) into the base, each key once.

    Bucketed by the whole key, so equal keys meet without a shuffle.
    """
    path, by_key = paths(root)
    if not files.names(spark, path):
        return False
    now, there = generations.current(spark, path), generations.run_ids(spark, [path, by_key])
    taken = generations.folded_rows(now, which, there)
    name = table(spark, root)

    def drop(run: str) -> None:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (run_id = {_quoted(run)})")

    def fold(base: str) -> None:
        for table_path in (path, by_key):  # what a compaction that was lost under this name has left
            files.delete(spark, f"{table_path}/run_id={base}")
        # added, not put in the place of anything: Spark does not overwrite a table that it reads
        _write(spark.table(name).where(taken).select(*LEDGER_KEY).distinct(), root, base, "INTO")

    return generations.compact(spark, path, [path, by_key], fold, which, drop)
