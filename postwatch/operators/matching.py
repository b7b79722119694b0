"""From subscriptions and postings to the candidates worth delivering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from postwatch.functions import text
from postwatch.operators import skew
from postwatch.schemas import LEDGER_KEY, SEARCH_KEY

# Fixed values.
PER_SEARCH = 10
THRESHOLD = 0.35

SENT, BELOW, PASSED, UNSCORED, ERROR = "already_sent", "below_threshold", "passed", "unscored", "error"


def search_keys(users: DataFrame) -> DataFrame:
    """Each distinct search once, however many subscriptions share it, with its query text."""
    keys = users.select(*SEARCH_KEY).distinct()
    return keys.withColumn("query", text.search_text(F.col("position"), F.col("location")))


def with_text_flag(postings: DataFrame) -> DataFrame:
    """Adds ``has_text``: whether there is a description to score. It lets the long text itself stay behind."""
    return postings.withColumn("has_text", text.or_empty(F.col("description")) != "")


def top_per_search(postings: DataFrame, k: int = PER_SEARCH, fanout: int = skew.FANOUT) -> DataFrame:
    """The first k postings of each search in response order."""
    return skew.first_k(postings, SEARCH_KEY, [F.col("pos"), F.col("link")], k, "search_rank", fanout)


def one_per_link(top: DataFrame) -> DataFrame:
    """Of postings with one link in one search keep the first; at most k rows per search meet here."""
    same = W.partitionBy(*SEARCH_KEY, "link").orderBy("pos")
    return top.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")


def candidates(users: DataFrame, top: DataFrame, hot_rows: int = skew.HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Every subscription with every posting of its search. A search many people share is salted."""
    wide = users.withColumnRenamed("id", "user_id")
    return skew.salted_join(wide, top, SEARCH_KEY, "inner", ["user_id"], hot_rows, counted=counted)


def _ledger_rows(ledger: DataFrame) -> DataFrame:
    return ledger.select(*[F.col("job_url").alias("link") if c == "job_url" else F.col(c) for c in LEDGER_KEY])


def unsent(cands: DataFrame, ledger: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """Candidates not in the ledger, or in none of its parts. The four-part key is unique on both sides, so it spreads evenly.

    The candidates are moved and sorted once; parts that lie bucketed by that key are merged with them in turn.
    """
    left = cands
    for part in [ledger] if isinstance(ledger, DataFrame) else ledger:
        left = left.join(_ledger_rows(part), ["email", "link", "position", "location"], "left_anti")
    return left.select(*cands.columns)


def newest_scores(scores: DataFrame) -> DataFrame:
    """One score per (user_id, link): that of the newest ``run``, within it of the last to arrive, of equals the highest.

    Takes the columns ``run``, ``arrived`` and ``reject_reason`` where they are there. A response that broke the rules counts as
    the newest all the same: it has no score, and ``score_error`` says why. Every map task sends one narrow row per pair.
    """
    error = F.col("reject_reason") if "reject_reason" in scores.columns else F.lit(None).cast("string")
    age = [F.col(c) for c in ("run", "arrived") if c in scores.columns]
    order = F.struct(*age, F.col("score").isNotNull(), F.col("score"), error)
    newest = F.max_by(F.struct("score", error.alias("score_error")), order).alias("_s")
    return scores.groupBy("user_id", "link").agg(newest).select("user_id", "link", "_s.*")


def with_scores(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by (user_id, link) and ``score_error``; a missing one is NULL. However often a pair was scored, its candidate is one row."""
    return cands.join(newest_scores(scores), ["user_id", "link"], "left")


def with_requirements(top: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirement lists by link, joined while there is still one row per posting."""
    return top.join(requirements, "link", "left")


def overlap(pairs: list[tuple[str, str]]) -> Column:
    """Matched requirements over requirements, for (requirement list, profile list) column pairs.

    NULL without requirements. Both counts are whole numbers and are divided once.
    """
    wanted, matched = F.lit(0), F.lit(0)
    for requirement, own in pairs:
        empty = F.array().cast("array<string>")
        needed = F.array_distinct(F.coalesce(F.col(requirement), empty))
        wanted = wanted + F.size(needed)
        matched = matched + F.size(F.array_intersect(needed, F.coalesce(F.col(own), empty)))
    return F.when(wanted > 0, matched.cast("double") / wanted.cast("double"))


def overlap_scores(cands: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds ``score`` from lists the rows already carry: no shuffle and no Python."""
    return cands.withColumn("score", F.when(F.col("has_profile"), overlap(pairs)))


def scores_by_function(
    cands: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.Series],
    inputs: list[str],
) -> DataFrame:
    """Adds ``score`` from a caller's function over Arrow batches, and ``score_error``, what it raised.

    ``mapInPandas`` stays where it is put: a plain pandas UDF would be moved below the anti join and paid for
    postings already sent. Only rows with ``has_profile`` and ``has_text`` are scored. Rows whose score is missing
    keep NULL. A posting is kept when it cannot be scored: a batch that the function raises for is halved until the rows
    it raises for are alone, and those keep NULL. Such a batch is first put in order by its numbers and texts, so that rows that
    are alike, and likely to fail alike, are neighbours.
    """
    schema = StructType([*cands.schema.fields, StructField("score", DoubleType()), StructField("score_error", StringType())])

    def scored(rows):
        values = scorer(rows).astype("float64")
        return values if values.index.sort_values().equals(rows.index.sort_values()) else values.set_axis(rows.index)

    def tried(rows):
        """Scores and errors of the rows."""
        try:
            return scorer(rows).astype("float64"), pd.Series(None, rows.index, "object")
        except Exception:  # told from its parts
            plain = [c for c in inputs if pd.api.types.is_numeric_dtype(rows[c]) or pd.api.types.infer_dtype(rows[c]) == "string"]
            ranked = rows.sort_values(plain, kind="stable") if plain else rows
        found, raised, waiting = [], {}, [(0, len(rows))]
        while waiting:
            a, b = waiting.pop()
            try:
                found.append(scored(ranked.iloc[a:b]))
            except Exception as error:  # whatever the caller's function raises
                if b - a > 1:
                    waiting += [((a + b) // 2, b), (a, (a + b) // 2)]
                else:
                    raised[ranked.index[a]] = f"{type(error).__name__}: {error}"
        scores = pd.concat(found) if found else pd.Series(dtype="float64")
        return scores.reindex(rows.index), pd.Series([raised.get(k) for k in rows.index], rows.index, "object")

    def run(batches):
        for batch in batches:
            asked = (batch["has_profile"] & batch["has_text"]).astype(bool)
            score, raised = pd.Series(None, batch.index, "float64"), pd.Series(None, batch.index, "object")
            if asked.any():
                score[asked], raised[asked] = tried(batch.loc[asked, inputs])
            yield batch.assign(score=score, score_error=raised)

    return cands.mapInPandas(run, schema)


def consults_score() -> Column:
    return F.col("has_profile") & F.col("has_text")


def matches(threshold: float = THRESHOLD) -> Column:
    """False only for a score below the threshold that counts; NULL and NaN keep the posting."""
    low = F.coalesce(F.col("score") < threshold, F.lit(False))
    return ~(consults_score() & low)


def score_filter(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(matches(threshold))


def judged(scored: DataFrame, threshold: float = THRESHOLD) -> Column:
    """What scoring made of a candidate: error, unscored, below the threshold or passed."""
    known = F.col("score").isNotNull() & consults_score()
    failed = (F.col("score_error").isNotNull() if "score_error" in scored.columns else F.lit(False)) & consults_score()
    return F.when(failed, ERROR).when(~known, UNSCORED).when(F.col("score") < threshold, BELOW).otherwise(PASSED)


def outcomes(scored: DataFrame, ledger: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with what became of it, and its score as text for the log. A scoring that failed is an error, not a low score."""
    rows = _ledger_rows(ledger).distinct().withColumn("_sent", F.lit(True))
    known = F.col("score").isNotNull() & consults_score()
    outcome = F.when(F.col("_sent"), SENT).otherwise(judged(scored, threshold))
    shown = F.when(known & F.col("_sent").isNull(), text.score_text(F.col("score")))
    return (
        scored.join(rows, ["email", "link", "position", "location"], "left")
        .withColumn("outcome", outcome)
        .withColumn("score_text", shown)
        .drop("_sent")
    )
