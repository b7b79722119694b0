"""Hot keys: one key may hold a large share of all rows, and none of these lets it meet one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FANOUT = 64
HOT_ROWS = 1_000_000


def first_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn", fanout: int = FANOUT) -> DataFrame:
    """The first ``k`` rows of every key with their rank from 1. ``order`` must be total within a key.

    Three cuts: each map task keeps k rows per key (Spark's group limit ahead of the shuffle), then each of
    ``fanout`` salts per key, then the key. A hot key brings ``fanout * k`` rows to its last task, whatever its size.
    """
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fanout)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    near = salted.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= k).drop(rank, "_salt")
    return near.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)


def first_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; an aggregate, so every map task sends one row per key."""
    kept = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(kept).select("_row.*")


def hot_keys(rows: DataFrame, keys: list[str], least: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``least`` rows: one row for each ``least`` rows of the table at most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    least: int = HOT_ROWS,
    fanout: int = FANOUT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join for a ``left`` whose keys may be hot and a ``right`` with few rows per key.

    Left rows of a hot key are spread over ``fanout`` salts by the columns ``spread``; right rows of that key are
    repeated once per salt. All other keys take salt 0. ``how``: inner, left, left_semi or left_anti. ``counted``
    stands in for ``left`` when counting keys: a cheaper table with the same rows per key, or more.

    The list of hot keys is broadcast whole: it has a row for ``least`` rows of the table at most, so a million for a
    table of a trillion rows.
    """
    hot = F.broadcast(hot_keys(left if counted is None else counted, keys, least).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*spread), F.lit(fanout)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(fanout - 1))
    spread_left = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    repeated = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    joined = spread_left.join(repeated, [*keys, "_salt"], how).drop("_salt")
    return joined.select(*left.columns) if how in ("left_semi", "left_anti") else joined
