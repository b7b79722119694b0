"""Keys Spark does not enforce, as checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def violations(table: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Values of any of the named keys held by more than one row: key, value (its columns as JSON), n_rows.

    The keys are stacked, so the table is read and grouped once however many keys it has; each map task sends one row per
    value. Rows with a NULL in a key column hold no value of that key.
    """
    entries = [F.struct(F.lit(name).alias("key"), F.to_json(F.struct(*columns)).alias("value"), whole_key(columns).alias("whole")) for name, columns in keys.items()]
    held = table.select(F.inline(F.array(*entries))).where("whole")
    return held.groupBy("key", "value").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def whole_key(columns: list[str]) -> Column:
    whole = F.lit(True)
    for name in columns:
        whole = whole & F.col(name).isNotNull()
    return whole


def orphans(children: DataFrame, users: DataFrame) -> DataFrame:
    """Children whose user is not there."""
    return children.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*children.columns)


def null_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a NULL in a key column. An anti join never matches them, so refuse them on the way in."""
    return table.where(~whole_key(keys))
