"""Edge cases of matching and the digest, on small hand-made tables."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postwatch.functions import render, text, urls
from postwatch.operators import digest, matching, profiles, subscriptions
from postwatch.plans import daily

CAND = "user_id string, email string, position string, location string, link string, pos long, date_posted string, " \
    "title string, company string, job_location string, description string"  # fmt: skip


def cand(pos, link=None, date=None, user="u1", position="dev"):
    return (user, f"{user}@x.org", position, "here", link or f"https://x.org/{pos}", pos, date, "ti", "co", "lo", "text")


@pytest.mark.parametrize(
    ("score", "has_profile", "kept"),
    [(0.35, True, True), (0.3499, True, False), (None, True, True), (float("nan"), True, True), (0.0, False, True)],
)
def test_threshold(spark, score, has_profile, kept):
    one = spark.createDataFrame([(score, has_profile, True)], "score double, has_profile boolean, has_text boolean")
    assert (matching.score_filter(one).count() == 1) is kept


def test_no_description_is_not_scored(spark):
    rows = spark.createDataFrame([(0.0, True, ""), (0.0, True, None), (0.0, True, "x")], "score double, has_profile boolean, description string")
    assert matching.score_filter(matching.with_text_flag(rows)).count() == 2


@pytest.mark.parametrize(
    ("dates", "order"),
    [
        (["2025-03-16", None, "2025-03-13", "2025-03-16"], [1, 4, 3, 2]),
        (["2025-03-16", "3 days ago"], [2, 1]),
        ([None, "", None], [1, 2, 3]),
    ],
)
def test_order_is_by_date_text(spark, dates, order):
    frame = spark.createDataFrame([cand(i + 1, date=d) for i, d in enumerate(dates)], CAND)
    assert [r.pos for r in digest.ranked(frame).orderBy("card_no").collect()] == order


def test_same_link_in_one_search_is_kept_once(spark):
    top = spark.createDataFrame(
        [("dev", "here", 5, "https://x.org/a"), ("dev", "here", 2, "https://x.org/a"), ("ops", "here", 9, "https://x.org/a")],
        "position string, location string, pos long, link string",
    )
    assert sorted(r.pos for r in matching.one_per_link(top).collect()) == [2, 9]


def test_ledger_key_has_four_parts(spark):
    frame = spark.createDataFrame([cand(1), cand(1, position="ops"), cand(1, user="u2")], CAND)
    ledger = spark.createDataFrame(
        [("u1@x.org", "https://x.org/1", "dev", "here")], "email string, job_url string, position string, location string"
    )
    assert sorted((r.user_id, r.position) for r in matching.unsent(frame, ledger).collect()) == [("u1", "ops"), ("u2", "dev")]


def test_deleted_and_added_again_is_not_sent_again(spark):
    users = spark.createDataFrame([("old", "u1@x.org", "dev", "here")], "id string, email string, position string, location string")
    gone = subscriptions.delete(users, users)
    assert gone.count() == 0
    again = spark.createDataFrame([("new", *cand(1)[1:])], CAND)
    ledger = spark.createDataFrame(
        [("u1@x.org", "https://x.org/1", "dev", "here")], "email string, job_url string, position string, location string"
    )
    assert matching.unsent(again, ledger).count() == 0


def test_outcomes(spark):
    scores = [0.9, 0.1, None, 0.1]
    frame = spark.createDataFrame(
        [(*cand(i), s, True, True) for i, s in enumerate(scores)], CAND + ", score double, has_profile boolean, has_text boolean"
    )
    ledger = spark.createDataFrame(
        [("u1@x.org", "https://x.org/3", "dev", "here")], "email string, job_url string, position string, location string"
    )
    got = {r.pos: (r.outcome, r.score_text) for r in matching.outcomes(frame, ledger).collect()}
    assert got == {0: ("passed", "0.90"), 1: ("below_threshold", "0.10"), 2: ("unscored", None), 3: ("already_sent", None)}


def test_score_text_rounds_like_a_printed_float(spark):
    values = [0.125, 0.375, 0.145, 0.155, 0.165, 1.0, 0.0, 2 / 3, 12345.678]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(text.score_text(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def test_overlap(spark):
    frame = spark.createDataFrame(
        [(["a", "b", "b", "c"], ["b", "x"], True), ([], ["b"], True), (None, ["b"], True), (["a"], [], True), (["a"], ["a"], False)],
        "need array<string>, have array<string>, has_profile boolean",
    )
    got = [r.score for r in matching.overlap_scores(frame, [("need", "have")]).collect()]
    assert got == [1 / 3, None, None, 0.0, None]


def test_profiles_keep_id_order_and_do_not_fan_out(spark):
    skills = spark.createDataFrame([(3, "u", "c"), (1, "u", "z"), (2, "u", "z")], "id int, user_id string, skill string")
    experiences = spark.createDataFrame([(1, "u", "e1"), (2, "u", "e2")], "id int, user_id string, experience string")
    educations = spark.createDataFrame([], "id int, user_id string, education string")
    users = spark.createDataFrame([("u", "a"), ("v", "b")], "id string, email string")
    got = {r.id: r for r in profiles.attach(users, profiles.fold(skills, experiences, educations)).collect()}
    assert (got["u"].skills, got["u"].experiences, got["u"].qualifications) == (["z", "z", "c"], ["e1", "e2"], [])
    assert got["u"].has_profile and not got["v"].has_profile and got["v"].skills == []


def test_function_scores_only_rows_with_profile_and_description(spark):
    frame = spark.createDataFrame(
        [("a", True, "abc"), ("b", False, "abc"), ("c", True, ""), ("d", True, None), ("e", True, "x")],
        "user_id string, has_profile boolean, description string",
    )

    def scorer(batch: pd.DataFrame) -> pd.Series:
        assert set(batch.columns) == {"description"}
        return batch["description"].str.len().where(batch["description"] != "x") / 10

    frame = matching.with_text_flag(frame)
    got = {r.user_id: r.score for r in matching.scores_by_function(frame, scorer, ["description"]).collect()}
    assert got == {"a": 0.3, "b": None, "c": None, "d": None, "e": None}


def test_a_raising_function_leaves_only_its_rows_unscored(spark):
    frame = spark.createDataFrame([(str(k), True, "x" * (k % 7 + 1)) for k in range(50)], "user_id string, has_profile boolean, description string")

    def scorer(batch: pd.DataFrame) -> pd.Series:
        if (batch["description"].str.len() == 3).any():
            raise RuntimeError("cannot score this")
        return batch["description"].str.len() / 10

    got = matching.scores_by_function(matching.with_text_flag(frame.coalesce(1)), scorer, ["description"]).collect()
    assert len(got) == 50 and all(r.score == (None if len(r.description) == 3 else len(r.description) / 10) for r in got)


def test_function_and_expression_paths_agree(spark):
    from checks import inputs as given
    from postwatch import session

    t = given.Inputs(session.configure(spark), "/root/testdata/sf0.001")
    by_table = daily.Scoring(requirements=t.requirements(), pairs=given.PAIRS)
    plain = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), by_table)

    def constant(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([1.0] * len(batch), index=batch.index)

    by_function = daily.Scoring(function=constant, inputs=("description",))
    every = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), by_function)
    assert every.columns == plain.columns
    keys = {(r.user_id, r.link) for r in plain.collect()}
    all_keys = {(r.user_id, r.link) for r in every.collect()}
    assert keys < all_keys
    assert len(all_keys) == matching.unsent(t.candidates(), t.ledger()).count()


def test_card_escapes_values(spark):
    frame = spark.createDataFrame([("<b>", "a&b", 'q"', "https://x.org/?a=1&b='2'")], "t string, c string, l string, u string")
    shown = frame.select(render.card(F.col("t"), F.col("c"), F.col("l"), F.col("u"), F.lit("p"))).first()[0]
    assert "<b>" not in shown and "&lt;b&gt;" in shown and "a&amp;b" in shown and "&#39;2&#39;" in shown
    raw = frame.select(render.card(F.col("t"), F.col("c"), F.col("l"), F.col("u"), F.lit("p"), escape=False)).first()[0]
    assert "<b>" in raw


def test_heading_without_position_or_location(spark):
    frame = spark.createDataFrame([("", None), ("dev", ""), ("dev", "here")], "p string, l string")
    got = [r[0] for r in frame.select(render.heading(F.col("p"), F.col("l"))).collect()]
    assert got == ["your role", "dev", "dev · here"]


def test_posted_label(spark):
    frame = spark.createDataFrame([(datetime.date(2025, 3, 6), "2025-03-06"), (None, None)], "d date, s string")
    labels = frame.select(
        render.posted_label(F.col("d"), frame.schema["d"].dataType), render.posted_label(F.col("s"), frame.schema["s"].dataType)
    )
    assert [tuple(r) for r in labels.collect()] == [("Mar 06, 2025", "This Week"), ("This Week", "This Week")]


def test_greeting_is_one_of_the_lines_and_depends_on_the_day(spark):
    lines = ["a", "b", "c"]
    frame = spark.range(200).select(F.col("id").cast("string").alias("k"))
    first = [r[0] for r in frame.select(render.greeting("2025-01-01", F.col("k"), lines=lines)).collect()]
    again = [r[0] for r in frame.select(render.greeting("2025-01-01", F.col("k"), lines=lines)).collect()]
    other = [r[0] for r in frame.select(render.greeting("2025-01-02", F.col("k"), lines=lines)).collect()]
    assert first == again != other and set(first) == set(lines)


@pytest.mark.parametrize(
    ("link", "wanted"),
    [
        ("HTTPS://A.B:443", "https://a.b/"),
        ("http://A.b:80/X?Q=1#F", "http://a.b/X?Q=1#F"),
        ("http://a.b:0443/x", "http://a.b:443/x"),
        ("  https://a.b/c d\n", "https://a.b/c%20d"),
        ("https://u:P@A.b", "https://u:P@a.b/"),
        ("https://[::1]:8080/x", "https://[::1]:8080/x"),
        ("https://a.b?x", "https://a.b/?x"),
        ("ftp://x.org/a", None), ("x.org/a", None), ("https://", None), ("https:///x", None), ("https://a b/x", None),
        ("https://a.b:70000/", None), ("", None), (None, None), ("https://a.b/" + "x" * 2100, "https://a.b/" + "x" * 2100),
    ],
)
def test_canonical_link(spark, link, wanted):
    frame = spark.createDataFrame([(link,)], "l string")
    assert frame.select(urls.canonical(F.col("l"))).first()[0] == wanted


def test_strip_is_by_unicode_white_space(spark):
    values = ["  a  ", "\t\n x　", "\u0085", " ", "a b", "", "​x"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in frame.select(text.strip(F.col("v"))).collect()] == [v.strip() for v in values]


def test_unsubscribe_url(spark):
    frame = spark.createDataFrame([("a+b@x.org", "c/c++ dev", "Köln")], "e string, p string, l string")
    got = frame.select(
        urls.unsubscribe_url("https://x.org/u", F.col("e"), F.col("p"), F.col("l")),
        urls.unsubscribe_url("https://x.org/u", F.col("e"), F.col("p"), F.col("l"), encode=False),
    ).first()
    assert got[0] == "https://x.org/u?email=a%2Bb%40x.org&position=c%2Fc%2B%2B%20dev&location=K%C3%B6ln"
    assert got[1] == "https://x.org/u?email=a+b@x.org&position=c/c++ dev&location=Köln"


def test_a_batch_that_raises_is_halved(spark):
    """Rows that the function takes are scored together, whichever rows of the batch it raises for; those keep no score."""
    rows = [(k, k % 100, True, True) for k in range(800)]
    frame = spark.createDataFrame(rows, "k long, pos long, has_profile boolean, has_text boolean").coalesce(1)

    def scorer(batch):
        if (batch["pos"] % 10 == 3).any():
            raise ValueError("no score")
        return batch["pos"] * 0.0 + len(batch)

    got = matching.scores_by_function(frame, scorer, ["pos"]).collect()
    assert sorted(r.k for r in got) == list(range(800))
    assert all((r.score is None) == (r.pos % 10 == 3) == (r.score_error is not None) for r in got)
    assert sum(1 / r.score for r in got if r.score) < 200  # calls that gave scores; one row at a time they would be 720
