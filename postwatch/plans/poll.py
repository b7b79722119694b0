"""One poll: serve the requests that came in, welcome and notify new subscriptions, clear their new flag.

A poll comes every few seconds and concerns few subscriptions, so it reads only the parts of the stores that these lie in (see
``sinks.users``, ``sinks.ledger``, ``sinks.postings``), writes only rows that have changed, and leaves out what has nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from postwatch import schemas
from postwatch.operators import changes, matching, profiles, subscriptions
from postwatch.plans import daily
from postwatch.schemas import SEARCH_KEY, USER_KEY
from postwatch.sinks import generations, ledger, runs, users as user_store

# list column of an add request, child table, value column
_CHILD_LISTS = [("skills", "skills", "skill"), ("experience", "experiences", "experience"), ("education", "educations", "education")]


@dataclass(frozen=True)
class PollSettings:
    """``root`` holds users, children, ledger and outboxes. ``secret`` makes the confirmation tokens.

    ``postings`` gives the postings of some searches (SEARCH_KEY); it may give more than those.
    """

    root: str
    secret: str
    confirm_base: str
    unsubscribe_base: str
    postings: Callable[[DataFrame], DataFrame]
    scoring: Callable[[], daily.Scoring] = daily.Scoring
    buckets: int = ledger.BUCKETS


def wanted_keys(spark: SparkSession, root: str, requests: DataFrame, run_id: str, confirms: bool) -> DataFrame:
    """Keys of the subscriptions a set of requests can concern: named by key, by token, or still new."""
    named = requests.where("email IS NOT NULL").select(*USER_KEY)
    tokens = changes.of_kind(requests, "confirm").where("token IS NOT NULL").select("token") if confirms else None
    return named.unionByName(user_store.found(spark, root, run_id, tokens)).distinct()


def concerned(spark: SparkSession, root: str, keys: DataFrame, run_id: str) -> DataFrame:
    """The subscriptions of these keys as earlier runs left them."""
    return user_store.live(user_store.stored(spark, root, before=run_id, keys=keys))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of ``after`` that are new or not as they were, and those of ``before`` whose key is gone, with ``deleted``.

    In both a key stands once and is whole: a poll finds users by their key, and an add without one is refused.
    """
    rows = [users.select(*USER_KEY, F.struct(*schemas.USERS.names).alias(name)) for users, name in ((before, "_was"), (after, "_now"))]
    other = rows[0].join(rows[1], USER_KEY, "full").where(~F.equal_null("_was", "_now"))
    return other.select(F.coalesce("_now", "_was").alias("_row"), F.col("_now").isNull().alias("deleted")).select("_row.*", "deleted")


def to_send(spark: SparkSession, now: DataFrame, settings: PollSettings, run_id: str) -> DataFrame:
    """Ranked rows of the digests of the subscriptions ``now``, from the parts of the stores that they lie in."""
    root, ids = settings.root, now.select(F.col("id").alias("user_id"))
    own = [user_store.children(spark, root, table, ids) for _, table, _ in _CHILD_LISTS]
    sent = ledger.of_subscriptions(spark, root, now, without=run_id)
    searches = matching.search_keys(now).select(*SEARCH_KEY)
    postings = settings.postings(searches).join(searches, SEARCH_KEY, "left_semi")
    return daily.deliverable(now, profiles.fold(*own), postings, sent, settings.scoring())


def poll(spark: SparkSession, feed: DataFrame, run_id: str, day: str, settings: PollSettings) -> dict[str, int]:
    """Done again with the same ``run_id`` it leaves the same tables: each run writes its own directories and reads
    users of earlier runs only, and the ledger of other runs only. Returns counts, taken while writing."""
    root = settings.root
    generations.refuse_folded(spark, root, run_id)
    asked = Observation()
    kinds = {f"n_{kind}": F.count_if((F.col("kind") == kind) & F.col("reject_reason").isNull()) for kind in changes.REQUIRED}
    kinds["n_rejected"] = F.count("reject_reason")
    parsed = changes.parse(feed).observe(asked, *[n.alias(name) for name, n in kinds.items()])
    parsed = runs.staged(parsed, f"{root}/requests/run_id={run_id}")
    counts = runs.observed(asked, list(kinds))
    requests = changes.valid(parsed)

    key = [F.col(c) for c in USER_KEY]
    token = subscriptions.secret_token(settings.secret, *key, F.col("seq").cast("string"), F.lit(run_id))
    # each feed may number its requests from 0, so an id is told from those of other runs by the run
    user_id = subscriptions.key_uuid(*key, F.col("seq").cast("string"), F.lit(run_id))

    wanted = runs.staged(wanted_keys(spark, root, requests, run_id, counts["n_confirm"] > 0), f"{root}/polled_keys/run_id={run_id}")
    before = runs.staged(concerned(spark, root, wanted, run_id), f"{root}/polled_before/run_id={run_id}")
    seen = Observation()
    waiting = F.col("is_new") & (F.coalesce("confirmation_token", F.lit("")) != "")
    added = runs.staged(changes.live_adds(before, requests), f"{root}/polled_adds/run_id={run_id}") if counts["n_add"] else None
    after = changes.replay(before, requests, token, user_id, added).observe(
        seen, F.count_if(F.col("is_new") & F.col("is_confirmed")).alias("n_notify"), F.count_if(waiting).alias("n_welcome")
    )
    after = runs.staged(after, f"{root}/polled_after/run_id={run_id}")
    counts |= runs.observed(seen, ["n_notify", "n_welcome"])

    if counts["n_add"]:
        for column, table, value in _CHILD_LISTS:
            rows = subscriptions.children_of_adds(added, column, value, user_id)
            user_store.write_children(rows.withColumnRenamed("item_no", "id"), root, table, run_id)
    if counts["n_welcome"]:
        runs.write_run(subscriptions.welcome_outbox(after, settings.confirm_base), f"{root}/welcome_outbox", run_id)
    if counts["n_notify"]:
        ranked = to_send(spark, subscriptions.notify_now(after), settings, run_id)
        counts |= daily.write_delivery(ranked, root, run_id, settings.unsubscribe_base, day, settings.buckets)

    ended = before.select("id").join(after.select("id"), "id", "left_anti")
    user_store.write_changes(differences(before, after.withColumn("is_new", F.lit(False))), root, run_id, ended)
    return counts


def compact(spark: SparkSession, root: str, before: str, prefix: str = "") -> None:
    """Fold the polls before one into the bases of the user store and the ledger; they must not be done again.

    Daily runs write to the ledger as well and may be under way; ``prefix`` tells the polls' runs there.
    """
    user_store.compact(spark, root, lambda run: run < before)
    ledger.compact(spark, root, lambda run: run < before and run.startswith(prefix))


def rejected_requests(spark: SparkSession, root: str) -> DataFrame:
    """Every refused request of every poll, with its reason."""
    parsed = changes.parse(schemas.empty(spark, schemas.CHANGE_FEED)).schema
    return runs.read_runs(spark, f"{root}/requests", parsed).where("reject_reason IS NOT NULL")
