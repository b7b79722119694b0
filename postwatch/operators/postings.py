"""Search and score responses: JSON text to typed rows, refusing what the payload rules refuse."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from postwatch.functions import payload, text, urls
from postwatch.operators import once
from postwatch.schemas import SEARCH_KEY


TEXTS = {"title": "title", "company": "company", "job_location": "location", "description": "description"}
# lists of either side of a score response
_LISTS = ("skills", "experiences", "qualifications")


def _postings(documents: Column) -> Column:
    """Array of posting documents to array of typed postings with ``ok``.

    Done in steps, each a ``transform`` over the step before: a lambda is interpreted as written, so a value used
    twice has to be a field of the step before.
    """

    def values(doc: Column) -> Column:
        return F.struct(
            *[payload.member(doc, field).alias(name) for name, field in TEXTS.items()],
            payload.member(doc, "link").alias("link"),
            payload.either(doc, "datePosted", "date_posted").alias("date_posted"),
            payload.either(doc, "employmentType", "employment_type").alias("employment_type"),
        )

    def texts(p: Column) -> Column:
        optional = (payload.absent_or_null(p[name]) | payload.is_text(p[name]) for name in ("date_posted", "employment_type"))
        return F.struct(
            *[text.strip(payload.text_of(p[name])).alias(name) for name in TEXTS],
            urls.parts(text.strip(payload.text_of(p.link))).alias("link"),
            payload.text_of(p.date_posted).alias("date_posted"),
            payload.text_of(p.employment_type).alias("employment_type"),
            functools.reduce(operator.and_, optional).alias("ok"),
        )

    def postings(p: Column) -> Column:
        long = functools.reduce(operator.and_, (text.long_enough(p[name]) for name in TEXTS), p.ok)
        return F.struct(
            p.title.alias("title"), p.company.alias("company"), p.job_location.alias("job_location"),
            urls.from_parts(p.link).alias("link"), p.date_posted.alias("date_posted"),
            p.employment_type.alias("employment_type"), p.description.alias("description"), long.alias("ok"),
        )

    return F.transform(F.transform(F.transform(documents, values), texts), postings)


def _posting_ok(posting: Column) -> Column:
    return posting.ok & posting.link.isNotNull()


def parse_responses(landed: DataFrame, body: str = "body") -> DataFrame:
    """Adds query, jobs, n_jobs and ``reject_reason`` to each landed response, and drops its text.

    One bad posting voids its whole response. ``bad_json`` and ``missing_jobs`` are failures of the search itself,
    ``invalid_response`` is a document that breaks the payload rules. All three give no postings.
    """
    doc = F.col("_doc")
    query, page_url = payload.member(doc, "query"), payload.member(doc, "url")
    length = payload.either(doc, "originalHtmlLength", "original_html_length")
    envelope_ok = (
        (query.isNull() | payload.is_text(query))
        & (payload.absent_or_null(page_url) | payload.is_text(page_url))
        & payload.whole_number_ok(length)
    )
    read = (
        landed.withColumn("_doc", F.try_parse_json(F.col(body)))
        .withColumn("_jobs", payload.member(doc, "jobs"))
        .withColumn("_envelope_ok", envelope_ok)
        .withColumn("query", F.coalesce(payload.text_of(query), F.lit("")))
        .withColumn("_read", _postings(payload.items(F.col("_jobs"))))
    )
    reason = (
        F.when(doc.isNull(), "bad_json")
        .when(payload.absent_or_null(F.col("_jobs")), "missing_jobs")
        .when(~F.coalesce(F.forall("_read", _posting_ok) & F.col("_envelope_ok"), F.lit(False)), "invalid_response")
    )
    kept = [c for c in landed.columns if c != body]
    judged = read.withColumn("reject_reason", reason)
    jobs = F.when(F.col("reject_reason").isNull(), F.transform("_read", lambda p: p.dropFields("ok")))
    n_jobs = F.when(F.col("reject_reason").isNull(), F.size("_read")).otherwise(0)
    return once.computed(judged, kept, query=F.col("query"), reject_reason=F.col("reject_reason"), jobs=jobs, n_jobs=n_jobs)


def newest(landed: DataFrame) -> DataFrame:
    """The response of each search's newest ``run``; of several of one run the last to arrive, and of those the one whose body has
    the greatest hash, so the choice is the same in every run.

    Only keys, ages and hashes are aggregated. The bodies meet the short list of those chosen and stay where they are unless
    even that list is too long to send to them; a body that landed twice goes on once.
    """
    mark = F.col("version") if "version" in landed.columns else F.xxhash64("body")
    age = [c for c in ("run", "arrived") if c in landed.columns]
    marked = landed.withColumn("_version", mark)
    last = marked.groupBy(*SEARCH_KEY).agg(F.max(F.struct(*age, "_version")).alias("_last")).select(*SEARCH_KEY, "_last.*")
    chosen = marked.alias("l").join(last.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*SEARCH_KEY, *age, "_version")], "left_semi")
    return chosen.drop("_version").dropDuplicates(SEARCH_KEY)


def from_responses(landed: DataFrame) -> DataFrame:
    """Typed postings of the newest response of each search; a response that breaks the rules gives none."""
    return explode_postings(parse_responses(newest(landed))).drop("run", "arrived")


def responses_valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL")


def explode_postings(parsed: DataFrame) -> DataFrame:
    """One row per posting with ``pos``, its place in the response from 1. Invalid responses give none."""
    kept = [c for c in parsed.columns if c not in ("jobs", "n_jobs", "reject_reason", "query")]
    return parsed.select(*kept, F.posexplode("jobs").alias("_i", "_job")).select(
        *kept, (F.col("_i") + 1).cast("long").alias("pos"), "_job.*"
    )


def parse_scores(landed: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``score`` and ``reject_reason``; a response that breaks the rules has no score."""
    doc = F.col("_doc")
    value = payload.member(doc, "similarityScore.score")
    kind = payload.json_type(value)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(
        F.try_variant_get(value, "$", "double")
    )
    text_of_null = F.contains(F.col(body), F.lit("null"))  # a text without the word holds no JSON null
    lists_ok = F.lit(True)
    for part in ("_job", "_profile"):
        lists_ok = lists_ok & F.col(part).isNotNull()
        for name in _LISTS:
            lists_ok = lists_ok & payload.text_list_ok(F.col(part)[name], text_of_null)
    reason = F.when(doc.isNull(), "bad_json").when(~lists_ok | F.col("_number").isNull(), "invalid_score")
    kept = [c for c in landed.columns if c != body]
    judged = (
        landed.withColumn("_doc", F.try_parse_json(F.col(body)))
        .withColumn("_job", payload.members(doc, "jobRequirements", _LISTS))
        .withColumn("_profile", payload.members(doc, "userProfile", _LISTS))
        .withColumn("_number", number)
        .withColumn("reject_reason", reason)
    )
    score = F.when(F.col("reject_reason").isNull(), F.col("_number"))
    return once.computed(judged, kept, score=score, reject_reason=F.col("reject_reason"))


def scored_requirements(landed: DataFrame, body: str = "body") -> DataFrame:
    """The requirement lists a score response carries."""
    inner = payload.member(F.try_parse_json(F.col(body)), "jobRequirements")
    kept = [c for c in landed.columns if c != body]
    return landed.select(*kept, *[payload.text_list(payload.member(inner, n)).alias(f"required_{n}") for n in _LISTS])


def check_fields(rows: DataFrame) -> DataFrame:
    """The posting rules on typed rows: texts stripped, link made canonical, and ``valid``."""
    cleaned = rows.withColumns({name: text.strip(F.col(name)) for name in TEXTS} | {"link": urls.canonical(F.col("link"))})
    return cleaned.withColumn("valid", functools.reduce(operator.and_, (text.long_enough(F.col(n)) for n in TEXTS), F.col("link").isNotNull()))
