"""Change requests: parse, check required fields, and replay a mixed feed in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postwatch.operators import once, skew, subscriptions
from postwatch.schemas import CHANGE_BODY, USER_KEY

# Fields that must not be null, by kind of request. Empty text passes.
REQUIRED = {
    "add": ["email", "position", "location", "jobType"],
    "delete": ["email", "position", "location"],
    "confirm": ["token"],
}


def parse(feed: DataFrame) -> DataFrame:
    """(seq, kind, body text) to typed fields and ``reject_reason``, NULL for a valid request."""
    body = F.from_json("body", CHANGE_BODY, {"columnNameOfCorruptRecord": "_malformed"})
    parsed = feed.withColumn("_b", body)
    reason = F.when(F.col("_b").isNull() | F.col("_b._malformed").isNotNull(), "bad_json")
    for kind, names in REQUIRED.items():
        for name in names:
            missing = (F.col("kind") == kind) & F.col(f"_b.{name}").isNull()
            reason = reason.when(missing, F.lit(f"missing_{name}"))
    reason = reason.when(~F.coalesce(F.col("kind").isin(*REQUIRED), F.lit(False)), "unknown_kind")
    fields = {name: F.col(f"_b.{name}") for name in ("email", "position", "location")}
    fields["job_type"] = F.col("_b.jobType")
    fields |= {name: F.col(f"_b.{name}") for name in ("token", "skills", "experience", "education")}
    return once.computed(parsed, ["seq", "kind"], **fields, reject_reason=reason)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL")


def of_kind(requests: DataFrame, kind: str) -> DataFrame:
    return requests.where(F.col("kind") == kind)


def live_adds(users: DataFrame, requests: DataFrame) -> DataFrame:
    """The adds whose insert still stands after all requests, taken in ``seq`` order.

    Per key only two things matter: its last delete, and the first add after it (or, with no delete, the first add
    when the key is absent). Both are aggregates, so a key with many requests shrinks on the map side.
    """
    deletes = of_kind(requests, "delete").groupBy(*USER_KEY).agg(F.max("seq").alias("last_delete"))
    adds = of_kind(requests, "add").drop("kind", "token")
    standing = skew.salted_join(adds, deletes, USER_KEY, "left", ["seq"])
    first = skew.first_row(standing.where("last_delete IS NULL OR seq > last_delete"), USER_KEY, [F.col("seq")])
    there = users.select(*USER_KEY, F.lit(True).alias("_there"))
    return first.join(there, USER_KEY, "left").where("_there IS NULL OR last_delete IS NOT NULL").drop("last_delete", "_there")


def replay(users: DataFrame, requests: DataFrame, token: Column, user_id: Column | None = None, adds: DataFrame | None = None) -> DataFrame:
    """The user table after valid ``requests`` were served one by one in ``seq`` order.

    A token is made by the add itself and nobody can confirm before knowing it, so confirms need no order of their own.
    ``adds``: the :func:`live_adds`, where the caller has them already.
    """
    kept = subscriptions.delete(users, of_kind(requests, "delete"))
    added = subscriptions.users_of_adds(live_adds(users, requests) if adds is None else adds, token, user_id)
    return subscriptions.confirm(kept.unionByName(added), of_kind(requests, "confirm"))
