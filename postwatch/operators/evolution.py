"""Schema revisions of the user table as column work, up and down, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

REVISIONS = ["base", "new_flag", "uuid_key", "details", "confirmation"]
COLUMN_ORDER = ["id", "email", "position", "location", "job_type", "is_new", "is_confirmed", "confirmation_token"]


def _add_confirmation(users: DataFrame) -> DataFrame:
    """Existing users become unconfirmed and hold no token to confirm with."""
    return users.withColumns({"is_confirmed": F.lit(False), "confirmation_token": F.lit(None).cast("string")})


def upgrade(users: DataFrame, since: str, to: str = REVISIONS[-1], user_id: Column | None = None) -> DataFrame:
    """Apply the revisions after ``since`` up to ``to``.

    ``user_id`` defaults to ``uuid()``; write the result once before using it, as a second evaluation
    gives other ids. ``details`` only creates the child tables (see ``schemas``).
    """
    steps: dict[str, Callable[[DataFrame], DataFrame]] = {
        "new_flag": lambda u: u.withColumn("is_new", F.lit(True)),
        "uuid_key": lambda u: u.withColumn("id", user_id if user_id is not None else F.uuid()),
        "details": lambda u: u,
        "confirmation": _add_confirmation,
    }
    for revision in REVISIONS[REVISIONS.index(since) + 1 : REVISIONS.index(to) + 1]:
        users = steps[revision](users)
    return users.select(*[c for c in COLUMN_ORDER if c in users.columns])


def downgrade(users: DataFrame, since: str, to: str) -> DataFrame:
    """Take the revisions after ``to`` back, newest first."""
    dropped = {"new_flag": ["is_new"], "uuid_key": ["id"], "confirmation": ["confirmation_token", "is_confirmed"]}
    for revision in reversed(REVISIONS[REVISIONS.index(to) + 1 : REVISIONS.index(since) + 1]):
        users = users.drop(*dropped.get(revision, []))
    return users
