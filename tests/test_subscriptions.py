"""Edge cases of the subscription table and of change requests."""

import json
import random

from pyspark.sql import functions as F

from postwatch import schemas
from postwatch.operators import changes, evolution, integrity, subscriptions

KEY = ["email", "position", "location"]


def feed(spark, *requests):
    rows = [(i, kind, body if isinstance(body, str) or body is None else json.dumps(body)) for i, (kind, body) in enumerate(requests)]
    return spark.createDataFrame(rows, schemas.CHANGE_FEED)


def user(spark, *rows):
    return spark.createDataFrame(rows, schemas.USERS)


def add(email, job_type="full", **more):
    return ("add", {"email": email, "position": "p", "location": "l", "jobType": job_type, **more})


def test_required_fields_are_checked_for_null_only(spark):
    parsed = changes.parse(
        feed(
            spark,
            add("a", ""),
            add("b", None),
            ("delete", {"email": "a", "position": "", "location": "l"}),
            ("delete", {"email": "a", "position": "p"}),
            ("confirm", {"token": None}),
            ("add", '{"email": "a"'),
            ("add", None),
            ("other", {}),
            add("c", skills=["x", "y"], extra=1),
        )
    )
    reasons = {r.seq: r.reject_reason for r in parsed.collect()}
    assert reasons == {
        0: None, 1: "missing_jobType", 2: None, 3: "missing_location", 4: "missing_token", 5: "bad_json", 6: "bad_json",
        7: "unknown_kind", 8: None,
    }
    assert changes.valid(parsed).count() + changes.rejected(parsed).count() == 9


def test_add_with_known_key_changes_nothing(spark):
    users = user(spark, ("1", "a", "p", "l", "full", False, True, None))
    adds = changes.of_kind(changes.valid(changes.parse(feed(spark, add("a", "part", skills=["new"])))), "add")
    after = subscriptions.upsert(users, adds, F.lit("t"))
    assert [tuple(r) for r in after.collect()] == [("1", "a", "p", "l", "full", False, True, None)]
    assert subscriptions.accepted_adds(users, adds).count() == 0


def test_first_add_of_a_batch_wins_and_brings_its_children(spark):
    requests = changes.valid(changes.parse(feed(spark, add("a", "one", skills=["x", "x"]), add("a", "two", skills=["y"]))))
    none = schemas.empty(spark, schemas.USERS)
    accepted = subscriptions.accepted_adds(none, changes.of_kind(requests, "add"))
    new = subscriptions.users_of_adds(accepted, F.lit("t")).first()
    assert (new.job_type, new.is_new, new.is_confirmed, new.confirmation_token, len(new.id)) == ("one", True, False, "t", 36)
    children = subscriptions.children_of_adds(accepted, "skills", "skill").orderBy("item_no").collect()
    assert [(r.user_id, r.skill) for r in children] == [(new.id, "x"), (new.id, "x")]


def test_confirm_takes_the_first_holder_of_a_token(spark):
    schema = "id string, email string, position string, location string, job_type string, is_new boolean, is_confirmed boolean, confirmation_token string"
    users = spark.createDataFrame([(i, i, "p", "l", "f", True, False, "t" if i < "3" else None) for i in "1234"], schema)
    token = spark.createDataFrame([("t",), ("t",), (None,)], "token string")
    got = {r.id: (r.is_confirmed, r.confirmation_token) for r in subscriptions.confirm(users, token).collect()}
    assert got == {"1": (True, None), "2": (False, "t"), "3": (False, None), "4": (False, None)}


def test_many_deletes_of_one_key_are_one(spark):
    schema = "email string, position string, location string"
    deletes = spark.createDataFrame([("a", "p", "l")] * 50, schema)
    users = spark.createDataFrame([("a", "p", "l"), ("b", "p", "l")], schema)
    plan = subscriptions.delete(users, deletes)
    assert [r.email for r in plan.collect()] == ["b"]
    assert "Aggregate" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_confirm_twice(spark):
    users = user(spark, ("1", "a", "p", "l", "f", True, False, "t1"), ("2", "b", "p", "l", "f", True, False, None))
    token = spark.createDataFrame([("t1",), ("t1",), (None,)], "token string")
    once = subscriptions.confirm(users, token)
    assert {r.id: (r.is_confirmed, r.confirmation_token) for r in once.collect()} == {"1": (True, None), "2": (False, None)}
    twice = subscriptions.confirm(once, token)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert subscriptions.by_token(users, "t1").count() == 1 and subscriptions.by_token(once, "t1").count() == 0


def test_delete_cascades_to_children_and_ignores_unknown_keys(spark):
    users = user(spark, ("1", "a", "p", "l", "f", True, False, None), ("2", "b", "p", "l", "f", True, False, None))
    deletes = spark.createDataFrame([("a", "p", "l"), ("zz", "p", "l"), ("a", "p", "l")], "email string, position string, location string")
    assert [r.id for r in subscriptions.delete(users, deletes).collect()] == ["2"]
    skills = spark.createDataFrame([(1, "1", "x"), (2, "2", "y")], schemas.SKILLS)
    assert [r.skill for r in subscriptions.cascade(skills, users, deletes).collect()] == ["y"]
    assert [r.skill for r in integrity.orphans(skills, subscriptions.delete(users, deletes)).collect()] == ["x"]


def test_lookup_and_filters(spark):
    users = user(
        spark, ("1", "a", "p", "l", "f", True, False, "t"), ("2", "b", "p", "l", "f", True, True, None),
        ("3", "c", "p", "l", "f", False, True, ""), ("4", "d", "p", "l", "f", True, False, ""),
    )
    ids = lambda frame: sorted(r.id for r in frame.collect())
    assert ids(subscriptions.lookup(users, "b", "p", "l")) == ["2"] and ids(subscriptions.lookup(users, "b", "p", "x")) == []
    assert ids(subscriptions.new(users)) == ["1", "2", "4"] and ids(subscriptions.confirmed(users)) == ["2", "3"]
    assert ids(subscriptions.notify_now(users)) == ["2"]
    welcome = subscriptions.welcome_outbox(users, "https://x.org/").collect()
    assert [(r.user_id, r.confirm_url) for r in welcome] == [("1", "https://x.org/confirm/t")]
    seen = subscriptions.mark_seen(users, users.where("id = '1'"))
    assert ids(subscriptions.new(seen)) == ["2", "4"]


def test_replay_equals_serving_requests_one_by_one(spark):
    """Against a plain loop that does what one server would do."""
    rng = random.Random(7)
    keys = [(e, "p", loc) for e in "abcdef" for loc in ("l", "m")]
    base = [(str(i), *k, "f", False, i % 2 == 0, None if i % 2 == 0 else f"base-{i}") for i, k in enumerate(keys[:6])]
    requests = []
    for _ in range(300):
        e, p, loc = rng.choice(keys)
        kind = rng.choice(["add", "delete", "confirm"])
        body = {"token": f"base-{rng.randrange(8)}"} if kind == "confirm" else {"email": e, "position": p, "location": loc, "jobType": "f"}
        requests.append((kind, body))
    for cut in (0, 1, 7, 40, 300):
        live = {r[1:4]: list(r) for r in base}
        for seq, (kind, body) in enumerate(requests[:cut]):
            if kind == "confirm":
                for row in live.values():
                    if row[7] == body["token"]:
                        row[6], row[7] = True, None
                continue
            key = (body["email"], body["position"], body["location"])
            if kind == "delete":
                live.pop(key, None)
            elif key not in live:
                live[key] = [None, *key, "f", True, False, f"new-{seq}"]
        parsed = changes.valid(changes.parse(feed(spark, *requests[:cut])))
        after = changes.replay(user(spark, *base), parsed, F.concat(F.lit("new-"), F.col("seq").cast("string")))
        got = sorted(tuple(r)[1:] for r in after.collect())
        assert got == sorted(tuple(r)[1:] for r in live.values())


def test_key_checks(spark):
    users = user(spark, ("1", "a", "p", "l", "f", True, False, None), ("2", "a", "p", "l", "f", True, False, None))
    assert integrity.key_violations(users, KEY).first().n_rows == 2
    assert integrity.key_violations(users, ["id"]).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert integrity.null_keys(nulls, ["x", "y"]).count() == 1


def test_evolution_up_and_down(spark):
    base = spark.createDataFrame([("a", "p", "l", "f"), ("b", "p", "l", "f")], "email string, position string, location string, job_type string")
    full = evolution.upgrade(base, "base")
    assert full.columns == schemas.USERS.names
    got = full.collect()
    assert all(r.is_new and not r.is_confirmed and r.confirmation_token is None for r in got)
    assert len({r.id for r in got}) == 2 and all(len(r.id) == 36 for r in got)
    for revision, columns in {
        "details": ["id", "email", "position", "location", "job_type", "is_new"],
        "new_flag": ["email", "position", "location", "job_type", "is_new"],
        "base": ["email", "position", "location", "job_type"],
    }.items():
        assert evolution.downgrade(full, "confirmation", revision).columns == columns
        assert evolution.upgrade(base, "base", revision).columns == columns


def test_empty_tables_have_the_live_schema(spark):
    tables = schemas.create_tables(spark)
    assert set(tables) == {"users", "skills", "experiences", "educations", "sent_email"}
    assert tables["users"].schema == schemas.USERS and tables["users"].count() == 0
