"""Every query by name: (spark, sf_dir) to a DataFrame over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import inputs as given
from checks.inputs import Inputs
from postwatch import session
from postwatch.functions import html, render, urls
from postwatch.operators import (
    changes,
    digest,
    evolution,
    integrity,
    matching,
    pages as page_ops,
    postings as posting_ops,
    profiles,
    queue as queue_ops,
    subscriptions,
)
from postwatch.plans import daily, triage
from postwatch.schemas import LEDGER_KEY, SEARCH_KEY, USER_KEY
from postwatch.sinks import crawl, ledger as ledger_sink, users as user_store
from postwatch.sources import queue_csv

Query = Callable[[Inputs], DataFrame]
_queries: dict[str, Query] = {}

CANDIDATE = ["user_id", *USER_KEY, "link", "pos"]


def query(build: Query) -> Query:
    _queries[build.__name__] = build
    return build


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Inputs(session.configure(spark), sf_dir))

    return {name: bind(build) for name, build in _queries.items()}


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# --- subscriptions ---------------------------------------------------------------------------------------------------


@query
def users_all(t: Inputs) -> DataFrame:
    return t.users()


@query
def users_confirmed(t: Inputs) -> DataFrame:
    return subscriptions.confirmed(t.users())


@query
def users_new(t: Inputs) -> DataFrame:
    return subscriptions.new(t.users())


@query
def users_notify_now(t: Inputs) -> DataFrame:
    return subscriptions.notify_now(t.users())


@query
def welcome_outbox(t: Inputs) -> DataFrame:
    return subscriptions.welcome_outbox(t.users(), given.CONFIRM_BASE)


@query
def user_lookup(t: Inputs) -> DataFrame:
    return subscriptions.lookup_many(t.users(), changes.of_kind(t.requests(), "add"))


@query
def users_upsert(t: Inputs) -> DataFrame:
    return subscriptions.upsert(t.users(), changes.of_kind(t.requests(), "add"), t.token())


@query
def users_delete(t: Inputs) -> DataFrame:
    return subscriptions.delete(t.users(), changes.of_kind(t.requests(), "delete"))


@query
def children_cascade(t: Inputs) -> DataFrame:
    return subscriptions.cascade(t.skills(), t.users(), changes.of_kind(t.requests(), "delete"))


@query
def children_added(t: Inputs) -> DataFrame:
    accepted = subscriptions.accepted_adds(t.users(), changes.of_kind(t.requests(), "add"))
    return subscriptions.children_of_adds(accepted, "skills", "skill")


@query
def confirm_users(t: Inputs) -> DataFrame:
    return subscriptions.confirm(t.users(), changes.of_kind(t.requests(), "confirm"))


@query
def users_mark_seen(t: Inputs) -> DataFrame:
    users = t.users()
    return subscriptions.mark_seen(users, subscriptions.new(users).where("cast(id AS long) % 8 = 0"))


@query
def users_after_requests(t: Inputs) -> DataFrame:
    return changes.replay(t.users(), t.requests(), t.token())


@query
def profiles_folded(t: Inputs) -> DataFrame:
    # subscriptions added by request have no rows in the profile tables
    users = subscriptions.upsert(t.users(), changes.of_kind(t.requests(), "add"), t.token())
    rows = profiles.attach(users, t.profiles())
    return rows.select("id", *[_joined(name) for name in profiles.LISTS], "has_profile")


_queries["profiles"] = _queries.pop("profiles_folded")


@query
def evolve_users(t: Inputs) -> DataFrame:
    """Back to the revision before confirmations and up again: flags are kept or lost as the revisions say; and from scratch."""
    key_id = subscriptions.key_uuid(*[F.col(c) for c in USER_KEY])
    earlier = evolution.downgrade(t.users(), "confirmation", "uuid_key")
    again = evolution.upgrade(earlier, "uuid_key").withColumn("path", F.lit("down and up"))
    bare = evolution.downgrade(t.users(), "confirmation", "base")
    fresh = evolution.upgrade(bare, "base", user_id=key_id).withColumn("path", F.lit("from base"))
    return again.unionByName(fresh)


@query
def key_violations(t: Inputs) -> DataFrame:
    return integrity.key_violations(changes.of_kind(t.requests(), "add"), USER_KEY)


@query
def keys_after_migration(t: Inputs) -> DataFrame:
    """Both keys of a migrated table in one pass: ids made from the address alone, and subscriptions asked for more than once."""
    bare = evolution.downgrade(t.users(), "confirmation", "base")
    asked = changes.of_kind(t.requests(), "add").select(*USER_KEY, "job_type")
    migrated = evolution.upgrade(bare.unionByName(asked), "base", user_id=subscriptions.key_uuid(F.col("email")))
    return integrity.violations(migrated, {"primary": ["id"], "unique": USER_KEY})


@query
def orphan_children(t: Inputs) -> DataFrame:
    left = subscriptions.delete(t.users(), changes.of_kind(t.requests(), "delete"))
    return integrity.orphans(t.skills(), left).select("user_id", "id", "skill")


# --- change requests -------------------------------------------------------------------------------------------------

_REQUEST = ["seq", "kind", "email", "position", "location", "job_type", "token"]


@query
def changes_scan(t: Inputs) -> DataFrame:
    parsed = changes.parse(t.feed()).where("reject_reason IS NULL OR reject_reason <> 'bad_json'")
    return parsed.select(*_REQUEST, _joined("skills"), _joined("experience"), "reject_reason")


@query
def changes_valid(t: Inputs) -> DataFrame:
    return t.requests().select(*_REQUEST)


@query
def rejects(t: Inputs) -> DataFrame:
    asked = changes.rejected(changes.parse(t.feed())).select(
        F.lit("request").alias("source"), F.col("seq").cast("string").alias("row_key"), "reject_reason"
    )
    searched = t.responses().where("reject_reason IS NOT NULL").select(
        F.lit("response").alias("source"), F.concat_ws("/", *SEARCH_KEY, "chunk").alias("row_key"), "reject_reason"
    )
    scored = posting_ops.parse_scores(t.landed_scores()).where("reject_reason IS NOT NULL").select(
        F.lit("score").alias("source"), F.concat_ws("/", "user_id", "link").alias("row_key"), "reject_reason"
    )
    return asked.unionByName(searched).unionByName(scored)


# --- polls -----------------------------------------------------------------------------------------------------------


@query
def poll_users(t: Inputs) -> DataFrame:
    """The user store after a poll over the whole feed."""
    held = F.col("confirmation_token").isNotNull().alias("holds_token")
    return user_store.read(t.spark, t.polled()).select(*USER_KEY, "job_type", "is_new", "is_confirmed", held)


@query
def poll_children(t: Inputs) -> DataFrame:
    """Skills after the same poll, by subscription: those of deleted subscriptions are gone, those of new ones there."""
    root = t.polled()
    owners = user_store.read(t.spark, root).select(F.col("id").alias("user_id"), *USER_KEY)
    return user_store.children(t.spark, root, "skills").join(owners, "user_id", "left").select(*USER_KEY, "id", "skill")


@query
def poll_ledger(t: Inputs) -> DataFrame:
    """What the same poll has sent: the postings of subscriptions that were new and confirmed."""
    return ledger_sink.read(t.spark, t.polled())


# --- postings --------------------------------------------------------------------------------------------------------


@query
def postings_scan(t: Inputs) -> DataFrame:
    return posting_ops.explode_postings(t.responses()).drop("first_pos")


@query
def responses_valid(t: Inputs) -> DataFrame:
    return posting_ops.responses_valid(t.responses()).select(*SEARCH_KEY, "chunk", "query", "n_jobs")


@query
def postings_valid(t: Inputs) -> DataFrame:
    form = F.col("pos") % 6
    title = (
        F.when(form == 0, F.concat(F.lit("  \t"), F.col("title"), F.lit("\n ")))
        .when(form == 1, F.lit(" x "))
        .when(form == 2, F.lit(None).cast("string"))
        .otherwise(F.col("title"))
    )
    rows = posting_ops.check_fields(t.postings().withColumn("title", title))
    return rows.select("pos", "title", "company", "job_location", "link", "description", "valid")


@query
def postings_links(t: Inputs) -> DataFrame:
    form, key = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    given_link = (
        F.when(form == 0, F.concat(F.lit("HTTPS://Jobs.Example.ORG:443/"), key))
        .when(form == 1, F.concat(F.lit("http://Jobs.Example.org:8080/A?b="), key))
        .when(form == 2, F.concat(F.lit("ftp://x.org/"), key))
        .when(form == 3, F.concat(F.lit(" https://jobs.example.org?id="), key, F.lit(" ")))
        .when(form == 4, F.concat(F.lit("http://Me:Pw@Jobs.example.org:80#f"), key))
        .when(form == 5, F.concat(F.lit("jobs.example.org/"), key))
        .when(form == 6, F.concat(F.lit("https://jobs.example.org/a b/"), key))
        .otherwise(F.concat(F.lit("https://jobs.example.org:99999/"), key))
    )
    return t.given("orders").select("o_orderkey", urls.canonical(given_link).alias("link"))


@query
def search_keys(t: Inputs) -> DataFrame:
    return matching.search_keys(subscriptions.confirmed(t.users()))


@query
def top_per_search(t: Inputs) -> DataFrame:
    return matching.top_per_search(t.postings()).select(*SEARCH_KEY, "pos", "link", "search_rank")


@query
def scores_scan(t: Inputs) -> DataFrame:
    return posting_ops.parse_scores(t.landed_scores())


@query
def scores_newest(t: Inputs) -> DataFrame:
    """Scores that landed once, again, or twice in one run: one row per pair."""
    return matching.newest_scores(posting_ops.parse_scores(t.relanded_scores()))


# --- matching and digest ---------------------------------------------------------------------------------------------


@query
def candidates(t: Inputs) -> DataFrame:
    return t.candidates().select(*CANDIDATE)


@query
def unsent_candidates(t: Inputs) -> DataFrame:
    return matching.unsent(t.candidates().select(*CANDIDATE), t.ledger())


@query
def overlap_scores(t: Inputs) -> DataFrame:
    return t.scored().select("user_id", "link", "has_profile", "score")


@query
def scores_by_function(t: Inputs) -> DataFrame:
    fresh = matching.unsent(t.scored().drop("score"), t.ledger()).select(
        "user_id", "link", "has_profile", "has_text", "requirements", "skills"
    )
    scored = matching.scores_by_function(fresh, given.overlap_function(), ["requirements", "skills"])
    return scored.select("user_id", "link", "score")


@query
def score_filter(t: Inputs) -> DataFrame:
    table = posting_ops.parse_scores(t.landed_scores()).where("score IS NOT NULL")
    users = profiles.attach(subscriptions.confirmed(t.users()), t.profiles())
    cands = matching.candidates(users, t.top(), counted=subscriptions.confirmed(t.users()))
    fresh = matching.unsent(cands.select(*CANDIDATE, "has_profile", "has_text"), t.ledger())
    kept = matching.score_filter(matching.with_scores(fresh, table))
    return kept.select("user_id", "link", "score")


@query
def outcome_counts(t: Inputs) -> DataFrame:
    rows = matching.outcomes(t.scored(), t.ledger())
    return rows.groupBy("outcome", "score_text").agg(F.count("*").alias("n_candidates"))


@query
def digest_from_responses(t: Inputs) -> DataFrame:
    """From landed JSON to ranked postings; the chunks of a search are its runs, and only the newest counts."""
    landed = t.landed_responses().withColumnRenamed("chunk", "run").drop("first_pos")
    rows = daily.daily_digest(t.users(), t.profiles(), posting_ops.from_responses(landed), t.ledger(), daily.Scoring())
    return rows.select(*CANDIDATE, "date_posted", "card_no")


@query
def digest_from_scores(t: Inputs) -> DataFrame:
    """The digest by landed scores: a pair that was scored several times is delivered once, by its newest score."""
    rows = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), daily.Scoring(landed=t.relanded_scores()))
    return rows.select(*CANDIDATE, "date_posted", "score", "score_error", "card_no")


@query
def outcome_counts_landed(t: Inputs) -> DataFrame:
    """Outcomes by landed scores: a response that broke the rules is an error, a pair never scored is unscored."""
    users = subscriptions.confirmed(t.users())
    cands = matching.candidates(profiles.attach(users, t.profiles()), t.top(), counted=users)
    scored = matching.with_scores(cands, posting_ops.parse_scores(t.relanded_scores()))
    return matching.outcomes(scored, t.ledger()).groupBy("outcome").agg(F.count("*").alias("n_candidates"))


@query
def daily_digest(t: Inputs) -> DataFrame:
    rows = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring())
    return rows.select(*CANDIDATE, "date_posted", "score", "card_no")


@query
def digest_ranked(t: Inputs) -> DataFrame:
    return digest.ranked(t.candidates()).select("user_id", "link", "date_posted", "card_no")


@query
def digest_sizes(t: Inputs) -> DataFrame:
    return digest.sizes(daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring()))


@query
def digest_outbox(t: Inputs) -> DataFrame:
    rows = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring())
    return digest.outbox(rows, given.UNSUBSCRIBE_BASE, given.DAY, greetings=given.GREETINGS)


@query
def ledger_after_run(t: Inputs) -> DataFrame:
    ledger = t.ledger()
    rows = daily.daily_digest(t.users(), t.profiles(), t.postings(), ledger, t.scoring())
    return ledger_sink.after_run(ledger, digest.ledger_rows(rows)).select(*LEDGER_KEY)


@query
def digest_greeting(t: Inputs) -> DataFrame:
    return t.users().select("id", render.greeting(given.DAY, *[F.col(c) for c in USER_KEY], lines=given.GREETINGS).alias("greeting"))


@query
def posted_labels(t: Inputs) -> DataFrame:
    rows = t.postings().withColumn("as_date", F.to_date("date_posted"))
    return rows.select(
        "pos",
        render.posted_label(F.col("date_posted"), rows.schema["date_posted"].dataType).alias("text_label"),
        render.posted_label(F.col("as_date"), rows.schema["as_date"].dataType).alias("date_label"),
    )


@query
def unsubscribe_urls(t: Inputs) -> DataFrame:
    key = [F.col(c) for c in USER_KEY]
    spaced = [F.concat(c, F.lit(" & more")) if i else c for i, c in enumerate(key)]
    return t.users().select(
        "id",
        urls.unsubscribe_url(given.UNSUBSCRIBE_BASE, *spaced).alias("encoded"),
        urls.unsubscribe_url(given.UNSUBSCRIBE_BASE, *spaced, encode=False).alias("as_is"),
    )


# --- pages and queues ------------------------------------------------------------------------------------------------


def _pass(t: Inputs) -> triage.Triage:
    return triage.triage_pass(t.queue(), t.processed(), t.pages(), "html", size=None, keywords=given.KEYWORDS)


@query
def filter_links(t: Inputs) -> DataFrame:
    return queue_ops.filter_links(t.pages().select("page_id", "url"), given.BLOCKED)


@query
def queue_positional(t: Inputs) -> DataFrame:
    no = F.col("page_id")
    url = F.when(no % 4 == 0, "").when(no % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("url"))
    return queue_csv.positional(t.pages().select(no.alias("pos"), no.cast("string").alias("c0"), url.alias("c1")))


@query
def queue_file(t: Inputs) -> DataFrame:
    """A queue written as files in its own order and read back by its lines: ``pos`` is each row's place in the whole queue."""
    path = f"{session.shared_dir(t.spark)}/checks-{uuid.uuid4().hex[:12]}"
    crawl.write_csv(t.queue(), path)
    return queue_csv.scan(t.spark, path, whole=True).select("pos", "job_url", "note")


@query
def queue_next_batch(t: Inputs) -> DataFrame:
    return queue_ops.next_batch(t.queue(), t.processed(), marker=given.MARKER)


@query
def queue_batch_results(t: Inputs) -> DataFrame:
    return triage.triage_pass(t.queue(), t.processed(), t.pages(), "html", keywords=given.KEYWORDS).results


@query
def scores_by_function_failing(t: Inputs) -> DataFrame:
    """The scorer raises on some rows; those keep no score, all others theirs."""
    fresh = matching.unsent(t.scored().drop("score"), t.ledger()).select(
        "user_id", "link", "pos", "has_profile", "has_text", "requirements", "skills"
    )
    scored = matching.scores_by_function(fresh, given.overlap_function(fails=True), ["requirements", "skills", "pos"])
    return scored.select("user_id", "link", "score")


@query
def queue_remaining(t: Inputs) -> DataFrame:
    return _pass(t).remaining.select("pos", "job_url", "note")


@query
def processed_urls(t: Inputs) -> DataFrame:
    newly = _pass(t).newly
    return queue_ops.processed_urls(t.processed(), newly)


@query
def crawl_results(t: Inputs) -> DataFrame:
    return _pass(t).results


@query
def crawl_counts(t: Inputs) -> DataFrame:
    return queue_ops.counts(t.queue(), t.processed(), _pass(t).newly)


@query
def page_triage(t: Inputs) -> DataFrame:
    return page_ops.triage(t.pages(), "html", given.KEYWORDS).drop("html")


@query
def page_store(t: Inputs) -> DataFrame:
    kept = page_ops.store_rows(page_ops.triage(t.pages(), "html", given.KEYWORDS))
    return kept.select("url", "html_file_path", F.md5("html").alias("html_md5"))


@query
def page_has_element(t: Inputs) -> DataFrame:
    page = F.col("html")
    return t.pages().select(
        "page_id",
        html.has_element(page, "article").alias("has_article"),
        html.has_element(page, "table").alias("has_table"),
        html.has_element(page, "div", "jobDescriptionText").alias("has_job_text"),
    )


@query
def page_titles(t: Inputs) -> DataFrame:
    return page_ops.titles(t.pages()).select("page_id", "title")


@query
def file_keys(t: Inputs) -> DataFrame:
    return t.pages().select(
        "page_id",
        urls.path_key(F.col("url"), "html").alias("path_key"),
        urls.indexed_key(F.col("url"), F.col("page_id")).alias("indexed_key"),
    )
