"""The user store: users, their children and two lists that find them, as runs of changed rows.

Per subscription the newest run counts; run ids must sort in the order the runs happen. Every table is dealt into parts by a hash of
its key, so a poll reads the parts its requests concern and no others:

- ``users``: by subscription; deletions are rows with ``deleted``.
- ``skills``, ``experiences``, ``educations``: by user id. ``ended`` holds the ids of subscriptions that are gone, by user id; children are
  merged with it on read, so they end with their subscription.
- ``lookup``: subscriptions by the confirmation token they were given (``kind=token``) and those written while new (``kind=new``).
  It says where to look; the users' own newest rows decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from postwatch import schemas
from postwatch.operators import subscriptions
from postwatch.schemas import USER_KEY
from postwatch.sinks import generations, runs

STORED = StructType([*schemas.USERS.fields, StructField("deleted", BooleanType())])
CHILDREN = {"skills": schemas.SKILLS, "experiences": schemas.EXPERIENCES, "educations": schemas.EDUCATIONS}
_ENDED = StructType([schemas.SKILLS["user_id"]])
_LOOKUP = StructType([StructField("value", schemas.USERS["email"].dataType), *[schemas.USERS[c] for c in USER_KEY], StructField("kind", schemas.USERS["email"].dataType)])
TABLES = ["users", *CHILDREN, "ended", "lookup"]


def _of_key():
    return runs.part_of(*[F.col(c) for c in USER_KEY])


def _of_id():
    return runs.part_of(F.col("user_id"))


def _read(spark: SparkSession, root: str, name: str, schema: StructType, keys: DataFrame | None = None) -> DataFrame:
    """Rows that count, ``run_id`` and ``part`` included, of the parts of ``keys`` or of all."""
    now = generations.current(spark, root)
    rows = runs.read_runs(spark, f"{root}/{name}", StructType([*schema.fields, runs.PART])).where(generations.visible(now))
    return rows if keys is None else runs.in_parts(rows, keys)


def stored(spark: SparkSession, root: str, before: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """All rows of all runs, or of the runs before one; with ``keys`` (USER_KEY) only rows of those subscriptions."""
    dealt = None if keys is None else keys.select(*USER_KEY, _of_key()).distinct()
    rows = _read(spark, root, "users", STORED, dealt).drop("part")
    rows = rows if before is None else rows.where(F.col("run_id") < before)
    return rows if dealt is None else rows.join(dealt.drop("part"), USER_KEY, "left_semi")


def latest(rows: DataFrame) -> DataFrame:
    """Newest row per subscription, deletions included; every map task sends one row per key."""
    newest = rows.groupBy(*USER_KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in USER_KEY]), "run_id").alias("_r"))
    return newest.select(*USER_KEY, "_r.*").drop("run_id")


def live(rows: DataFrame) -> DataFrame:
    return latest(rows).where("NOT deleted").select(*schemas.USERS.names)


def read(spark: SparkSession, root: str) -> DataFrame:
    return live(stored(spark, root))


def found(spark: SparkSession, root: str, before: str, tokens: DataFrame | None) -> DataFrame:
    """Keys of subscriptions that were once given one of the ``tokens`` (column token), or were written while new."""
    earlier = lambda rows: rows.where(F.col("run_id") < before)
    new = earlier(_read(spark, root, "lookup", _LOOKUP)).where("kind = 'new'").select(*USER_KEY)
    if tokens is None:
        return new
    asked = tokens.select(F.col("token").alias("value"), runs.part_of(F.col("token"))).distinct()
    given = earlier(_read(spark, root, "lookup", _LOOKUP, asked)).where("kind = 'token'")
    return new.unionByName(given.join(asked.drop("part"), "value", "left_semi").select(*USER_KEY))


def write(users: DataFrame, gone: DataFrame | None, root: str, run_id: str, ended: DataFrame | None = None) -> None:
    """Changed rows and, as deletions, the rows in ``gone``; ``ended`` (id): subscriptions whose children end, by default those of ``gone``."""
    rows = users.withColumn("deleted", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.withColumn("deleted", F.lit(True)))
        ended = gone if ended is None else ended
    write_changes(rows, root, run_id, ended)


def write_changes(rows: DataFrame, root: str, run_id: str, ended: DataFrame | None = None) -> None:
    """:func:`write` for rows that have ``deleted``. They are worked out once: the lookup is made of the users as written."""
    runs.write_run(rows.withColumn("part", _of_key()), f"{root}/users", run_id, ["part"])
    written = rows.sparkSession.read.schema(STORED).parquet(f"{root}/users/run_id={run_id}")
    runs.write_run(_lookup(written.where("NOT deleted")), f"{root}/lookup", run_id, ["kind", "part"])
    if ended is not None:
        ids = ended.select(F.col("id").alias("user_id"))
        runs.write_run(ids.withColumn("part", _of_id()), f"{root}/ended", run_id, ["part"])


def _lookup(users: DataFrame) -> DataFrame:
    token = F.col("confirmation_token")
    entry = lambda kind, value, part: F.struct(F.lit(kind).alias("kind"), value.alias("value"), part)
    both = F.array(
        F.when(token != "", entry("token", token, runs.part_of(token))),
        F.when(F.col("is_new"), entry("new", F.lit(None).cast("string"), _of_key())),
    )
    return users.select(*USER_KEY, F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("e.*", *USER_KEY)


def write_children(rows: DataFrame, root: str, name: str, run_id: str) -> None:
    runs.write_run(rows.select(*CHILDREN[name].names).withColumn("part", _of_id()), f"{root}/{name}", run_id, ["part"])


def children(spark: SparkSession, root: str, name: str, ids: DataFrame | None = None) -> DataFrame:
    """Children of subscriptions that are not gone, of all or of ``ids`` (user_id)."""
    dealt = None if ids is None else ids.select("user_id", _of_id()).distinct()
    rows, ended = _read(spark, root, name, CHILDREN[name], dealt), _read(spark, root, "ended", _ENDED, dealt).select("user_id", "part")
    if dealt is not None:
        rows = rows.join(dealt, ["user_id", "part"], "left_semi")
    return rows.join(ended, ["user_id", "part"], "left_anti").select(*CHILDREN[name].names)


def compact(spark: SparkSession, root: str, which: Callable[[str], bool] = lambda run: True) -> bool:
    """Fold the runs that ``which`` takes into the base: live users, their children, and the lookup of what they hold now.

    ``which`` must take all runs up to one and none after, and never a run that may be done again.
    """
    paths = [f"{root}/{name}" for name in TABLES]
    now, there = generations.current(spark, root), generations.run_ids(spark, paths)
    taken = generations.folded_rows(now, which, there)

    def rows(name: str, schema: StructType) -> DataFrame:
        return runs.read_runs(spark, f"{root}/{name}", StructType([*schema.fields, runs.PART])).where(taken)

    def fold(base: str) -> None:
        ended = rows("ended", _ENDED).select("user_id", "part")
        for name, schema in CHILDREN.items():
            write_children(rows(name, schema).join(ended, ["user_id", "part"], "left_anti"), root, name, base)
        write(live(rows("users", STORED).drop("part")), None, root, base)

    return generations.compact(spark, root, paths, fold, which)
