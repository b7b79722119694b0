"""The digest of all confirmed subscriptions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from postwatch import schemas
from postwatch.operators import digest, matching, postings as posting_ops, profiles, skew, subscriptions
from postwatch.sinks import ledger as ledger_sink, runs

# What a candidate needs after scoring. Descriptions and lists are long and stay out of the later shuffles.
NARROW = [
    "user_id", "email", "position", "location", "link", "pos", "date_posted", "title", "company", "job_location", "score",
    "score_error",
]


@dataclass(frozen=True)
class Scoring:
    """One of three ways to a score, or none (then every posting is kept).

    ``table``: (user_id, link, score), and where there are several of a pair run and arrived (``matching.newest_scores``).
    ``landed``: score responses as they landed, with body. ``requirements``: (link, lists) compared with the profile by
    ``pairs`` of (requirement column, profile column). ``function``: called over batches with the columns ``inputs``.
    """

    table: DataFrame | None = None
    landed: DataFrame | None = None
    requirements: DataFrame | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    function: Callable[[pd.DataFrame], pd.Series] | None = None
    inputs: tuple[str, ...] = ("description", "skills", "experiences", "qualifications")
    threshold: float = matching.THRESHOLD


def scored_candidates(users: DataFrame, folded: DataFrame, postings: DataFrame, scoring: Scoring,
                      k: int = matching.PER_SEARCH, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Candidates with profile lists, posting fields and, unless a function scores, ``score``.

    Only a function reads descriptions; without one they are dropped before anything is sorted or moved.
    """
    flagged = matching.with_text_flag(postings)
    top = matching.one_per_link(matching.top_per_search(flagged if scoring.function else flagged.drop("description"), k))
    if scoring.requirements is not None:
        top = matching.with_requirements(top, scoring.requirements)
    cands = matching.candidates(profiles.attach(users, folded), top, hot_rows, counted=users)
    no_error = F.lit(None).cast("string").alias("score_error")
    if scoring.requirements is not None:
        return matching.overlap_scores(cands, list(scoring.pairs)).select("*", no_error)
    if scoring.table is not None or scoring.landed is not None:
        return matching.with_scores(cands, scoring.table if scoring.table is not None else posting_ops.parse_scores(scoring.landed))
    return cands if scoring.function else cands.select("*", F.lit(None).cast("double").alias("score"), no_error)


def _counted(scored: DataFrame, threshold: float, seen: Observation | None) -> DataFrame:
    """The rows as they are; ``seen`` counts them by what scoring made of them while they pass."""
    if seen is None:
        return scored
    outcome = matching.judged(scored, threshold)
    names = (matching.PASSED, matching.BELOW, matching.UNSCORED, matching.ERROR)
    return scored.observe(seen, F.count(F.lit(1)).alias("n_scored"), *[F.count_if(outcome == name).alias(f"n_{name}") for name in names])


def deliverable(users: DataFrame, folded: DataFrame, postings: DataFrame, ledger: DataFrame | Sequence[DataFrame], scoring: Scoring,
                k: int = matching.PER_SEARCH, hot_rows: int = skew.HOT_ROWS, seen: Observation | None = None) -> DataFrame:
    """Ranked rows of every digest for the given subscriptions.

    A score that is an expression or a joined column is free to use before the anti join, which then moves fewer and
    narrower rows. A function is dear, so it runs after the anti join, on what was not sent yet.
    """
    scored = scored_candidates(users, folded, postings, scoring, k, hot_rows)
    if scoring.function is None:
        passed = matching.score_filter(_counted(scored, scoring.threshold, seen), scoring.threshold)
        kept = matching.unsent(passed.select(*NARROW), ledger)
    else:
        fresh = matching.unsent(scored, ledger)
        priced = matching.scores_by_function(fresh, scoring.function, list(scoring.inputs))
        kept = matching.score_filter(_counted(priced, scoring.threshold, seen), scoring.threshold).select(*NARROW)
    return digest.ranked(kept)


def daily_digest(users: DataFrame, folded: DataFrame, postings: DataFrame, ledger: DataFrame | Sequence[DataFrame], scoring: Scoring,
                 **options: object) -> DataFrame:
    return deliverable(subscriptions.confirmed(users), folded, postings, ledger, scoring, **options)


def write_delivery(ranked: DataFrame, root: str, run_id: str, unsubscribe_base: str, day: str,
                   buckets: int = ledger_sink.BUCKETS) -> dict[str, int]:
    """Outbox and ledger of one run, both from rows written once, so a score is paid once and both agree. Returns counts."""
    sent = Observation()
    counted = ranked.observe(sent, F.count(F.lit(1)).alias("n_delivered"), F.count_if(F.col("card_no") == 1).alias("n_digests"))
    rows = runs.staged(counted, f"{root}/delivered/run_id={run_id}")
    runs.write_run(digest.outbox(rows, unsubscribe_base, day), f"{root}/outbox", run_id)
    ledger_sink.append(digest.ledger_rows(rows), root, run_id, buckets)
    return runs.observed(sent, ["n_delivered", "n_digests"])


def run_daily(spark: SparkSession, users: DataFrame, folded: DataFrame, postings: DataFrame | None, scoring: Scoring, root: str,
              run_id: str, unsubscribe_base: str, day: str, responses: DataFrame | None = None,
              buckets: int = ledger_sink.BUCKETS, **options: int) -> DataFrame:
    """One run against the ledger. Done twice with one ``run_id`` it leaves the same tables.

    ``responses``: landed search responses that take the place of ``postings``. What was refused of them, of landed scores, and the
    postings a scorer raised for are the run's rows of ``rejects``; its counts are a row of ``counts``, taken while writing.
    """
    refused = []
    if responses is not None:
        parsed = runs.staged(posting_ops.parse_responses(posting_ops.newest(responses)), f"{root}/parsed_responses/run_id={run_id}")
        postings = posting_ops.explode_postings(parsed).drop("run", "arrived")
        refused.append(parsed.select(F.lit("response").alias("source"), F.concat_ws("/", *schemas.SEARCH_KEY).alias("row_key"), "reject_reason"))
    if scoring.landed is not None:
        parsed = runs.staged(posting_ops.parse_scores(scoring.landed), f"{root}/parsed_scores/run_id={run_id}")
        scoring = replace(scoring, landed=None, table=parsed)
        refused.append(parsed.select(F.lit("score").alias("source"), F.concat_ws("/", "user_id", "link").alias("row_key"), "reject_reason"))
    seen = Observation()
    sent = ledger_sink.parts(spark, root, run_id)
    ranked = daily_digest(users, folded, postings, sent, scoring, seen=seen, **options)
    counts = write_delivery(ranked, root, run_id, unsubscribe_base, day, buckets)
    counts = runs.observed(seen, schemas.DAILY_COUNTS.names[:-2]) | counts
    if scoring.function is not None:
        delivered = spark.read.schema(ranked.schema).parquet(f"{root}/delivered/run_id={run_id}")
        refused.append(delivered.select(F.lit("scorer").alias("source"), F.concat_ws("/", "user_id", "link").alias("row_key"), F.col("score_error").alias("reject_reason")))
    if refused:
        rows = functools.reduce(DataFrame.unionByName, refused).where("reject_reason IS NOT NULL")
        runs.write_run(rows, f"{root}/rejects", run_id)
    runs.write_run(spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts)), f"{root}/counts", run_id)
    return runs.read_runs(spark, f"{root}/outbox", schemas.OUTBOX).where(F.col("run_id") == run_id)


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """What was refused in every daily run, with its reason."""
    return runs.read_runs(spark, f"{root}/rejects", schemas.REJECTS)


def counts(spark: SparkSession, root: str) -> DataFrame:
    """One row per daily run: candidates scored and what became of them, postings delivered, digests."""
    return runs.read_runs(spark, f"{root}/counts", schemas.DAILY_COUNTS)
