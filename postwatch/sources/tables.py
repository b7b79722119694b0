"""Parquet tables of the live schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from postwatch import schemas


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet directory; a directory that is not there yet is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, schema)
