"""The subscription table: filters, lookup, insert-if-absent, delete with cascade, confirm, clear the new flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postwatch.functions import render, urls
from postwatch.operators import skew
from postwatch.schemas import USER_KEY


def confirmed(users: DataFrame) -> DataFrame:
    return users.where("is_confirmed")


def new(users: DataFrame) -> DataFrame:
    return users.where("is_new")


def notify_now(users: DataFrame) -> DataFrame:
    return users.where("is_new AND is_confirmed")


def lookup(users: DataFrame, email: str, position: str, location: str) -> DataFrame:
    """At most one row when the key is unique; see ``integrity.key_violations``."""
    return users.where((F.col("email") == email) & (F.col("position") == position) & (F.col("location") == location))


def lookup_many(users: DataFrame, keys: DataFrame) -> DataFrame:
    """The subscriptions whose key is in ``keys``."""
    return users.join(keys.select(*USER_KEY).distinct(), USER_KEY, "left_semi").select(*users.columns)


def by_token(users: DataFrame, token: str) -> DataFrame:
    return users.where(F.col("confirmation_token") == token)


def welcome_outbox(users: DataFrame, base_url: str) -> DataFrame:
    """One welcome row per new subscription that still holds a token."""
    url = urls.confirm_url(base_url, F.col("confirmation_token"))
    waiting = new(users).where("confirmation_token IS NOT NULL AND confirmation_token <> ''")
    return waiting.select(
        F.col("id").alias("user_id"), "email", "position", "location",
        F.lit(render.WELCOME_SUBJECT).alias("subject"), url.alias("confirm_url"), render.welcome_body(url).alias("body"),
    )


def key_uuid(*key: Column) -> Column:
    """A 36-character id that is the same whenever the row is computed again."""
    digest = F.md5(F.concat_ws("\u001f", *key))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def secret_token(secret: str, *key: Column) -> Column:
    """A token nobody can work out without the secret, yet equal on recomputation."""
    return F.sha2(F.concat_ws("\u001f", F.lit(secret), *key), 256)


def accepted_adds(users: DataFrame, adds: DataFrame) -> DataFrame:
    """Add requests that lead to an insert: the first per key, and only for keys not there yet.

    ``adds``: seq, email, position, location, job_type and the three lists.
    """
    first = skew.first_row(adds, USER_KEY, [F.col("seq")])
    return first.join(users.select(*USER_KEY), USER_KEY, "left_anti").select(*adds.columns)


def users_of_adds(accepted: DataFrame, token: Column, user_id: Column | None = None) -> DataFrame:
    """User rows for accepted adds: new, not confirmed, holding ``token`` (see :func:`secret_token`).

    Ids and tokens are computed from the row, not drawn: a lost task that is run again must give the same ones.
    """
    key = [F.col(c) for c in USER_KEY]
    return accepted.select(
        (user_id if user_id is not None else key_uuid(*key, F.col("seq").cast("string"))).alias("id"),
        *USER_KEY, "job_type",
        F.lit(True).alias("is_new"), F.lit(False).alias("is_confirmed"),
        token.alias("confirmation_token"),
    )


def children_of_adds(accepted: DataFrame, list_column: str, value_name: str, user_id: Column | None = None) -> DataFrame:
    """(user_id, item_no, value) of one of the three lists, in list order."""
    key = [F.col(c) for c in USER_KEY]
    uid = (user_id if user_id is not None else key_uuid(*key, F.col("seq").cast("string"))).alias("user_id")
    return accepted.select(uid, F.posexplode(list_column).alias("item_no", value_name))


def upsert(users: DataFrame, adds: DataFrame, token: Column) -> DataFrame:
    return users.unionByName(users_of_adds(accepted_adds(users, adds), token))


def delete(users: DataFrame, deletes: DataFrame) -> DataFrame:
    """The users whose key is not among ``deletes``; many deletes of one key are one before they are moved."""
    return users.join(deletes.select(*USER_KEY).distinct(), USER_KEY, "left_anti").select(*users.columns)


def cascade(children: DataFrame, users: DataFrame, deletes: DataFrame) -> DataFrame:
    """Children left after ``deletes``. The joined side is the deleted ids, small beside the users kept."""
    gone = users.join(deletes.select(*USER_KEY).distinct(), USER_KEY, "left_semi").select(F.col("id").alias("user_id"))
    return children.join(gone, "user_id", "left_anti").select(*children.columns)


def confirm(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Set ``is_confirmed`` and clear the token where it is among ``tokens``; of several holders of one token the least id.

    Holders are few beside all users, most of whom hold none: only they meet the tokens, and come back by their own id.
    """
    asked = tokens.select(F.col("token").alias("confirmation_token")).where("confirmation_token IS NOT NULL").distinct()
    holders = users.where("confirmation_token IS NOT NULL").select("confirmation_token", "id").join(asked, "confirmation_token", "left_semi")
    first = holders.groupBy("confirmation_token").agg(F.min("id").alias("id"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return users.join(first.withColumn("_hit", F.lit(True)), ["id", "confirmation_token"], "left").select(
        *[c for c in users.columns if c not in ("is_confirmed", "confirmation_token")],
        (F.col("is_confirmed") | hit).alias("is_confirmed"),
        F.when(~hit, F.col("confirmation_token")).alias("confirmation_token"),
    ).select(*users.columns)


def mark_seen(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Clear ``is_new`` for the keys in ``seen``, confirmed or not."""
    flag = seen.select(*USER_KEY).distinct().withColumn("_seen", F.lit(True))
    kept = F.col("is_new") & F.col("_seen").isNull()
    return users.join(flag, USER_KEY, "left").withColumn("is_new", kept).select(*users.columns)
