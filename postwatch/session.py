"""Session settings the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Answers depend on the first two; the rest steer the physical plan only.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # a repeated JSON key: the last one counts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a bucket that is one sorted file is read as sorted
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; unset, a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="run-postwatch-", dir="/tmp")
    return _own[app]


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from the caller."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # small test tables: let adaptive execution keep more than one task per stage
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
