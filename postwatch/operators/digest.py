"""Order what is left, fold it into one digest per subscription, and derive the ledger rows.

A subscription has at most ``PER_SEARCH`` postings here (see ``matching``), so its group is bounded.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from postwatch.functions import render, text, urls
from postwatch.schemas import LEDGER_KEY, USER_KEY


def ranked(kept: DataFrame) -> DataFrame:
    """``card_no`` from 1: date text descending, no date last, ties in search order."""
    order = [text.or_empty(F.col("date_posted")).desc(), F.col("pos"), F.col("link")]
    return kept.withColumn("card_no", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))


def sizes(kept: DataFrame) -> DataFrame:
    """Postings per digest; a subscription with none has no row and gets no mail."""
    return kept.groupBy("user_id").agg(F.count("*").alias("n_jobs"))


def with_cards(rows: DataFrame, escape: bool = True) -> DataFrame:
    posted = render.posted_label(F.col("date_posted"), rows.schema["date_posted"].dataType)
    card = render.card(*[F.col(c) for c in ("title", "company", "job_location", "link")], posted, escape)
    return rows.withColumn("card", card)


def outbox(rows: DataFrame, unsubscribe_base: str, day: str | datetime.date, subject: str = render.DIGEST_SUBJECT,
           greetings: Sequence[str] = render.GREETINGS) -> DataFrame:
    """One mail per subscription from ranked rows; cards are made before the rows of a subscription are brought together."""
    ordered = F.array_sort(F.collect_list(F.struct("card_no", "card")))
    folded = with_cards(rows).groupBy("user_id", *USER_KEY).agg(
        F.array_join(F.transform(ordered, lambda c: c.card), "").alias("cards"),
        F.count("*").cast("int").alias("n_jobs"),
    )
    line = render.greeting(day, *[F.col(c) for c in USER_KEY], lines=greetings)
    leave = urls.unsubscribe_url(unsubscribe_base, *[F.col(c) for c in USER_KEY])
    body = render.digest_body(F.col("cards"), *[F.col(c) for c in USER_KEY], line, leave)
    return folded.select("user_id", *USER_KEY, F.lit(subject).alias("subject"), body.alias("body"), "n_jobs")


def ledger_rows(delivered: DataFrame) -> DataFrame:
    return delivered.withColumnRenamed("link", "job_url").select(*LEDGER_KEY)
