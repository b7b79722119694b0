"""Small files and folders in whatever file system Spark writes to, by Hadoop's interface."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing when it is not there."""
    path, system = _at(spark, folder)
    return sorted(entry.getPath().getName() for entry in system.listStatus(path)) if system.exists(path) else []


def read(spark: SparkSession, path: str) -> str:
    at, system = _at(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file that is seen whole or not at all: written under another name, then renamed."""
    at, system = _at(spark, path)
    if system.exists(at):
        raise FileExistsError(path)
    early, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.early")
    stream = system.create(early)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(early, at):
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)
