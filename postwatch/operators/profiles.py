"""Profiles: three child tables folded into three lists per subscription.

All children of one subscription come from the lists of the one request that created it (a later add for the same
key changes nothing), so a folded list is never longer than a list one JSON document carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LISTS = {"skills": "skill", "experiences": "experience", "qualifications": "education"}


def fold(skills: DataFrame, experiences: DataFrame, educations: DataFrame) -> DataFrame:
    """One row per user_id with skills, experiences and qualifications in id order.

    The three tables are stacked and grouped once, so they need one shuffle and never meet in a join.
    """
    stacked = None
    for name, table in zip(LISTS, (skills, experiences, educations), strict=True):
        rows = table.select("user_id", entry(name, F.col("id"), F.col(LISTS[name])).alias("e")).select("user_id", "e.*")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return fold_stacked(stacked)


def entry(name: str, place: Column, value: Column) -> Column:
    """An item of the list ``name`` as a row of a stacked table."""
    return F.struct(F.lit(name).alias("kind"), F.struct(place.alias("id"), value.alias("value")).alias("item"))


def fold_stacked(stacked: DataFrame) -> DataFrame:
    """:func:`fold` for children that are one table already: user_id, kind, item."""

    def in_order(name: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.col("item"))))
        return F.transform(items, lambda item: item.value).alias(name)

    return stacked.groupBy("user_id").agg(*[in_order(name) for name in LISTS])


def has_profile() -> Column:
    """True when any of the three lists holds something."""
    some = F.lit(False)
    for name in LISTS:
        some = some | (F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))) > 0)
    return some


def attach(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users with their lists (empty ones when they have none) and ``has_profile``."""
    nothing = F.array().cast("array<string>")
    joined = users.join(profiles.withColumnRenamed("user_id", "id"), "id", "left")
    return joined.select(
        *users.columns,
        *[F.coalesce(F.col(name), nothing).alias(name) for name in LISTS],
        has_profile().alias("has_profile"),
    )
