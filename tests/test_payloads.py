"""Landed JSON: what is accepted, what is refused and why."""

import json

import pytest
from pyspark.sql import functions as F

from postwatch.functions import payload
from postwatch.operators import postings
from postwatch.sources import feeds

GOOD = {"title": "Dev", "company": "Acme", "location": "Rome", "link": "https://x.org/a", "description": "text"}


def parse(spark, *documents):
    texts = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
    return postings.parse_responses(spark.createDataFrame(texts, "no int, body string"))


@pytest.mark.parametrize(
    ("document", "reason", "n_jobs"),
    [
        ({"jobs": [GOOD]}, None, 1),
        ({"jobs": []}, None, 0),
        ({"jobs": [GOOD, GOOD, GOOD | {"title": " x "}]}, "invalid_response", 0),
        ({"jobs": [GOOD | {"title": 55}]}, "invalid_response", 0),
        ({"jobs": [GOOD | {"title": None}]}, "invalid_response", 0),
        ({"jobs": [{k: v for k, v in GOOD.items() if k != "company"}]}, "invalid_response", 0),
        ({"jobs": [GOOD | {"link": "ftp://x.org/a"}]}, "invalid_response", 0),
        ({"jobs": [GOOD | {"datePosted": 20250101}]}, "invalid_response", 0),
        ({"jobs": [GOOD | {"datePosted": None, "employmentType": None}]}, None, 1),
        ({"jobs": [GOOD | {"extra": {"a": [1]}}], "more": 1}, None, 1),
        ({"jobs": [3]}, "invalid_response", 0),
        ({"jobs": {"a": 1}}, "invalid_response", 0),
        ({"jobs": None}, "missing_jobs", 0),
        ({"query": "q"}, "missing_jobs", 0),
        ("[]", "missing_jobs", 0),
        ({"jobs": [GOOD], "query": None}, "invalid_response", 0),
        ({"jobs": [GOOD], "query": 7}, "invalid_response", 0),
        ({"jobs": [GOOD], "url": None, "originalHtmlLength": None}, None, 1),
        ({"jobs": [GOOD], "url": 5}, "invalid_response", 0),
        ({"jobs": [GOOD], "originalHtmlLength": "12"}, None, 1),
        ({"jobs": [GOOD], "originalHtmlLength": 12.0}, None, 1),
        ({"jobs": [GOOD], "originalHtmlLength": 12.5}, "invalid_response", 0),
        ({"jobs": [GOOD], "original_html_length": "many"}, "invalid_response", 0),
        ('{"jobs": [', "bad_json", 0),
        ("", "bad_json", 0),
        (None, "bad_json", 0),
    ],
)
def test_response_rules(spark, document, reason, n_jobs):
    one = parse(spark, document).first()
    assert (one.reject_reason, one.n_jobs) == (reason, n_jobs)


def test_fields_by_alias_or_name_and_order(spark):
    jobs = [GOOD | {"title": "  One\t", "datePosted": "d1"}, GOOD | {"title": "Two", "date_posted": "d2", "employment_type": "e"}]
    jobs.append(GOOD | {"title": "Three", "datePosted": "alias", "date_posted": "name", "link": "HTTPS://X.org"})
    got = postings.explode_postings(parse(spark, {"jobs": jobs, "query": "q"})).orderBy("pos").collect()
    assert [(r.pos, r.title, r.date_posted, r.employment_type) for r in got] == [
        (1, "One", "d1", None), (2, "Two", "d2", "e"), (3, "Three", "alias", None)
    ]
    assert got[2].link == "https://x.org/" and got[0].job_location == "Rome"


def test_one_bad_response_does_not_touch_the_others(spark):
    parsed = parse(spark, {"jobs": [GOOD]}, {"jobs": [GOOD | {"title": ""}]}, {"jobs": [GOOD, GOOD]})
    assert sorted(r.no for r in postings.explode_postings(parsed).collect()) == [0, 2, 2]
    assert sorted(r.no for r in postings.responses_valid(parsed).collect()) == [0, 2]


LISTS = {"skills": ["a"], "experiences": [], "qualifications": ["b", "c"]}


@pytest.mark.parametrize(
    ("document", "score", "reason"),
    [
        ({"jobRequirements": LISTS, "userProfile": {}, "similarityScore": {"score": 0.35}}, 0.35, None),
        ({"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": 1}}, 1.0, None),
        ({"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": "0.5"}}, 0.5, None),
        ({"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": 0.1 + 0.2}}, 0.1 + 0.2, None),
        ({"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": "good"}}, None, "invalid_score"),
        ({"jobRequirements": {}, "userProfile": {}, "similarityScore": {}}, None, "invalid_score"),
        ({"jobRequirements": {}, "userProfile": {}}, None, "invalid_score"),
        ({"jobRequirements": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ({"jobRequirements": [], "userProfile": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ({"jobRequirements": {"skills": [1]}, "userProfile": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ({"jobRequirements": {"skills": ["a", None]}, "userProfile": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ({"jobRequirements": {"skills": [None]}, "userProfile": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ({"jobRequirements": {"skills": ["null"]}, "userProfile": {}, "similarityScore": {"score": 1}}, 1.0, None),
        ({"jobRequirements": {"skills": None}, "userProfile": {}, "similarityScore": {"score": 1}}, None, "invalid_score"),
        ('{"similarityScore": {"score": 1}', None, "bad_json"),
        (None, None, "bad_json"),
    ],
)
def test_score_rules(spark, document, score, reason):
    text = document if isinstance(document, str) or document is None else json.dumps(document)
    one = postings.parse_scores(spark.createDataFrame([(text,)], "body string")).first()
    assert (one.score, one.reject_reason) == (score, reason)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ('{"jobRequirements": {"skills": ["annulled", "null"]}, "userProfile": {"skills": []}, "similarityScore": {"score": 1}}', None),
        ('{"jobRequirements": {"skills": ["a"], "more": null}, "userProfile": {}, "similarityScore": {"score": 1}}', None),
        ('{"jobRequirements": {}, "userProfile": {"qualifications": ["a", null, "b"]}, "similarityScore": {"score": 1}}', "invalid_score"),
        ('{"jobRequirements": {}, "userProfile": {"skills": ["a", 1]}, "similarityScore": {"score": 1}}', "invalid_score"),
        ('{"jobRequirements": {}, "userProfile": null, "similarityScore": {"score": 1}}', "invalid_score"),
        ('{"jobRequirements": {"skills": [1], "skills": ["a"]}, "userProfile": {}, "similarityScore": {"score": 1}}', None),
        ('{"jobRequirements": {"skills": ["a"]}, "userProfile": {}, "userProfile": {"skills": [null]}, "similarityScore": {"score": 1}}', "invalid_score"),
    ],
)
def test_nulls_and_repeats_in_score_lists(spark, text, reason):
    assert postings.parse_scores(spark.createDataFrame([(text,)], "body string")).first().reject_reason == reason


def test_list_elements_are_read_only_for_nulls(spark):
    rows = spark.createDataFrame([('["a", null]', True), ('["a", null]', False), ('["a"]', True), ('["a"]', False)], "body string, may boolean")
    ok = payload.text_list_ok(F.try_parse_json("body"), F.col("may"))
    assert [r.ok for r in rows.select(ok.alias("ok")).collect()] == [False, True, True, True]


def test_sides_of_a_score_are_not_made_into_maps(spark):
    parsed = postings.parse_scores(spark.createDataFrame([("{}",)], "body string"))
    assert "map<" not in parsed._jdf.queryExecution().optimizedPlan().toString().lower().replace("maptype(", "map<")


def test_requirement_lists(spark):
    text = json.dumps({"jobRequirements": {"skills": ["a", "b"]}, "userProfile": {}, "similarityScore": {"score": 1}})
    one = postings.scored_requirements(spark.createDataFrame([(text,)], "body string")).first()
    assert (one.required_skills, one.required_experiences) == (["a", "b"], [])


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [GOOD]}, indent=2))
    (tmp_path / "b.json").write_text("{")
    parsed = postings.parse_responses(feeds.landed_documents(spark, str(tmp_path)))
    got = {r.name: r.reject_reason for r in parsed.select(F.element_at(F.split("source", "/"), -1).alias("name"), "reject_reason").collect()}
    assert got == {"a.json": None, "b.json": "bad_json"}
