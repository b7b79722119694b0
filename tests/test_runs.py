"""Whole runs: the daily digest, polls, and the poll as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from checks import inputs as given
from postwatch import schemas, session
from postwatch.operators import postings, profiles
from postwatch.plans import daily, poll, triage
from postwatch.sinks import ledger as ledger_sink, runs, users as user_store
from postwatch.sources import feeds
from postwatch.streaming import poll_stream

POSTINGS = [
    ("dev", "rome", i, f"Job {i}", "Acme", "rome", f"https://x.org/{i}", f"2025-01-{i:02d}", None, "text") for i in range(1, 13)
]


def contents(frame):
    return sorted(map(repr, frame.collect()))


def test_daily_run_twice(spark, tmp_path):
    t = given.Inputs(session.configure(spark), "/root/testdata/sf0.001")
    root = str(tmp_path)
    args = (t.users(), t.profiles(), t.postings(), t.scoring(), root)
    first = daily.run_daily(spark, *args, "day1", given.UNSUBSCRIBE_BASE, "2025-01-01")
    n_jobs = sum(r.n_jobs for r in first.collect())
    sent = ledger_sink.read(spark, root)
    assert n_jobs == sent.count() > 0
    assert sent.distinct().count() == n_jobs
    before = contents(sent)
    # the same run again: the same tables
    again = daily.run_daily(spark, *args, "day1", given.UNSUBSCRIBE_BASE, "2025-01-01")
    assert contents(ledger_sink.read(spark, root)) == before and again.count() > 0
    assert ledger_sink.compact(spark, root) and not ledger_sink.compact(spark, root)
    assert contents(ledger_sink.read(spark, root)) == before
    # the next run on the same input: nothing left to send
    assert daily.run_daily(spark, *args, "day2", given.UNSUBSCRIBE_BASE, "2025-01-02").count() == 0
    assert contents(ledger_sink.read(spark, root)) == before


def test_at_most_ten_per_search_and_newest_first(spark):
    users = spark.createDataFrame([("u", "a@x.org", "dev", "rome", "f", False, True, None)], schemas.USERS)
    postings = spark.createDataFrame(POSTINGS, schemas.POSTINGS)
    none = profiles.fold(*[schemas.empty(spark, s) for s in (schemas.SKILLS, schemas.EXPERIENCES, schemas.EDUCATIONS)])
    ranked = daily.daily_digest(users, none, postings, schemas.empty(spark, schemas.LEDGER), daily.Scoring())
    assert [r.pos for r in ranked.orderBy("card_no").collect()] == list(range(10, 0, -1))


class World:
    def __init__(self, spark, root):
        self.spark, self.root, self.seq = spark, str(root / "state"), 0
        self.inbox = root / "inbox"
        self.inbox.mkdir()
        self.settings = poll.PollSettings(
            self.root, "secret", "https://c.example.org", "https://u.example.org",
            postings=lambda searches: spark.createDataFrame(POSTINGS, schemas.POSTINGS),
        )

    def rows(self, *requests):
        out = []
        for kind, body in requests:
            out.append((self.seq, kind, json.dumps(body) if isinstance(body, dict) else body))
            self.seq += 1
        return out

    def serve(self, run, *requests):
        poll.poll(self.spark, self.spark.createDataFrame(self.rows(*requests), schemas.CHANGE_FEED), run, "2025-01-01", self.settings)

    def land(self, name, *requests):
        lines = [json.dumps(dict(zip(("seq", "kind", "body"), row))) for row in self.rows(*requests)]
        (self.inbox / f"{name}.json").write_text("\n".join(lines))

    def users(self):
        return {r.email: r for r in user_store.read(self.spark, self.root).collect()}

    def table(self, name, schema=schemas.OUTBOX):
        return runs.read_runs(self.spark, f"{self.root}/{name}", schema).collect()

    def welcomes(self):
        return [r.email for r in self.table("welcome_outbox")]

    def sent(self):
        return ledger_sink.read(self.spark, self.root).collect()


@pytest.fixture()
def world(spark, tmp_path):
    return World(session.configure(spark), tmp_path)


def add(email, **more):
    return ("add", {"email": email, "position": "dev", "location": "rome", "jobType": "full"} | more)


def drop(email):
    return ("delete", {"email": email, "position": "dev", "location": "rome"})


def test_new_unconfirmed_user_is_welcomed_once_and_not_notified(world):
    world.serve("1", add("a", skills=["x", "y"], education=["z"]))
    user = world.users()["a"]
    assert (user.is_new, user.is_confirmed) == (False, False) and len(user.confirmation_token) == 64
    assert world.welcomes() == ["a"] and world.sent() == []
    children = user_store.children(world.spark, world.root, "skills").collect()
    assert [(r.user_id, r.skill) for r in sorted(children)] == [(user.id, "x"), (user.id, "y")]
    # confirms after the first poll: the poll sends nothing, the daily run will
    world.serve("2", ("confirm", {"token": user.confirmation_token}))
    user = world.users()["a"]
    assert (user.is_confirmed, user.confirmation_token) == (True, None)
    assert world.welcomes() == ["a"] and world.sent() == []


def test_new_and_confirmed_user_gets_a_digest_and_no_welcome(world):
    imported = [("7", "a", "dev", "rome", "full", True, True, None), ("8", "b", "dev", "rome", "full", False, True, None)]
    user_store.write(world.spark.createDataFrame(imported, schemas.USERS), None, world.root, "0")
    world.serve("1", add("c"))
    assert world.welcomes() == ["c"] and {r.email for r in world.sent()} == {"a"} and len(world.sent()) == 10
    assert [r.n_jobs for r in world.table("outbox")] == [10]
    assert not any(u.is_new for u in world.users().values()) and len(world.users()) == 3


def test_delete_and_add_again_keeps_the_ledger(world):
    imported = [("7", "a", "dev", "rome", "full", True, True, None)]
    user_store.write(world.spark.createDataFrame(imported, schemas.USERS), None, world.root, "0")
    world.serve("1", add("b"))
    assert len(world.sent()) == 10
    world.serve("2", drop("a"), drop("nobody"))
    assert set(world.users()) == {"b"} and len(world.sent()) == 10
    world.serve("3", add("a"))
    world.serve("4", ("confirm", {"token": world.users()["a"].confirmation_token}))
    users = user_store.read(world.spark, world.root)
    none = profiles.fold(*[user_store.children(world.spark, world.root, n) for n in user_store.CHILDREN])
    out = daily.run_daily(world.spark, users, none, world.settings.postings(None), daily.Scoring(), world.root, "5", "https://u", "2025-01-02")
    assert out.count() == 0 and world.users()["a"].id != "7"


def test_a_poll_done_again_changes_nothing(world):
    def state():
        names = {"outbox": schemas.OUTBOX, "welcome_outbox": schemas.OUTBOX, "skills": schemas.SKILLS}
        return [sorted(map(repr, world.table(n, s))) for n, s in names.items()], sorted(map(repr, world.users().items())), sorted(world.sent())

    imported = [("7", "a", "dev", "rome", "full", True, True, None)]
    user_store.write(world.spark.createDataFrame(imported, schemas.USERS), None, world.root, "0")
    first = world.spark.createDataFrame(world.rows(add("b", skills=["x"]), drop("a")), schemas.CHANGE_FEED)
    second = world.spark.createDataFrame(world.rows(add("c"), drop("b"), add("b")), schemas.CHANGE_FEED)
    for run, feed in (("1", first), ("2", second)):
        poll.poll(world.spark, feed, run, "2025-01-01", world.settings)
    before = state()
    for run, feed in (("2", second), ("2", second)):
        poll.poll(world.spark, feed, run, "2025-01-01", world.settings)
    assert state() == before


def test_rejected_requests_are_kept_with_their_reason(world):
    world.serve("1", add("a", jobType=None), ("add", "{"), add("b"))
    got = sorted((r.seq, r.reject_reason) for r in poll.rejected_requests(world.spark, world.root).collect())
    assert got == [(0, "missing_jobType"), (1, "bad_json")] and set(world.users()) == {"b"}


def test_compaction_keeps_live_users_and_their_children(world, tmp_path):
    world.serve("1", add("a", skills=["x"]), add("b", skills=["y"]))
    world.serve("2", drop("a"))
    before = world.users()
    assert user_store.compact(world.spark, world.root)
    assert world.users() == before
    assert [r.skill for r in user_store.children(world.spark, world.root, "skills").collect()] == ["y"]
    assert user_store.stored(world.spark, world.root).count() == 1


def test_stream_over_a_growing_directory(world, tmp_path):
    def run_once(run="r1"):
        stream = feeds.change_stream(world.spark, str(world.inbox))
        query = poll_stream.start(
            stream, world.settings, run, once=True, checkpoint=str(tmp_path / f"checkpoint-{run}"), day=lambda: "2025-01-01"
        )
        query.awaitTermination()

    imported = [("7", "a", "dev", "rome", "full", True, True, None)]
    user_store.write(world.spark.createDataFrame(imported, schemas.USERS), None, world.root, "0")
    world.land("one", add("b"), add("b"), add("c"))
    run_once()
    assert sorted(world.welcomes()) == ["b", "c"] and len(world.sent()) == 10
    run_once()
    assert sorted(world.welcomes()) == ["b", "c"] and len(world.sent()) == 10
    world.land("two", add("b"), add("d"), drop("c"), ("confirm", {"token": world.users()["b"].confirmation_token}))
    run_once()
    assert sorted(world.welcomes()) == ["b", "c", "d"] and len(world.sent()) == 10
    assert {e: u.is_confirmed for e, u in world.users().items()} == {"a": True, "b": True, "d": False}
    # a fresh checkpoint under a later run name reads all files again; nobody is welcomed or notified twice but
    # those whose subscription the replayed requests end and start again
    run_once("r2")
    assert sorted(world.welcomes())[:2] == ["b", "c"] and len(world.sent()) == 10


def test_an_alert_deleted_and_added_again_has_only_its_new_lists(world):
    """Every feed numbers its requests from 0, and the old lists must not come back under the new subscription."""
    def serve(run, request):
        world.seq = 0
        world.serve(run, request)

    serve("1", add("a", skills=["old"]))
    first = world.users()["a"].id
    serve("2", drop("a"))
    serve("3", add("a", skills=["new"]))
    again = world.users()["a"].id
    assert again != first
    lists = lambda: user_store.children(world.spark, world.settings.root, "skills").where(F.col("user_id") == again)
    assert [r.skill for r in lists().collect()] == ["new"]
    serve("3", add("a", skills=["new"]))  # the same poll once more
    assert world.users()["a"].id == again and lists().count() == 1


def test_triage_runs_take_the_queue_down(spark, tmp_path):
    """Two runs over one queue: each takes the next rows, writes its outputs, and reads every page text once."""
    root = str(tmp_path)
    queue = spark.createDataFrame([(k, f"u{k // 2}", "n") for k in range(10)], "pos long, job_url string, note string")
    pages = spark.createDataFrame([(f"u{k}", f"<title>t</title>{'error' if k == 1 else 'text'} {k}") for k in range(5) if k != 3], "url string, html string")
    left = triage.run_triage(spark, queue, pages, root, "1", "dir", size=4)
    assert sorted(r.pos for r in left.collect()) == [4, 5, 6, 7, 8, 9]
    again = triage.run_triage(spark, queue, pages, root, "1", "dir", size=4)
    assert sorted(r.pos for r in again.collect()) == [4, 5, 6, 7, 8, 9]
    last = triage.run_triage(spark, again, pages, root, "2", "dir")
    assert sorted(r.job_url for r in last.collect()) == ["u3", "u3"]  # never fetched, so it waits
    results = spark.read.parquet(f"{root}/results").collect()
    assert sorted((r.job_url, r.html_file_path, str(r.run_id)) for r in results) == sorted(
        [("u0", "dir/u0.html", "1")] * 2 + [("u1", "", "1")] * 2 + [(f"u{k}", f"dir/u{k}.html", "2") for k in (2, 4) for _ in "ab"]
    )
    assert sorted(r.url for r in spark.read.parquet(f"{root}/pages").collect()) == ["u0", "u2", "u4"]
    assert spark.read.parquet(f"{root}/processed").count() == 4


def test_landed_lines_reach_the_postings(spark, tmp_path):
    jobs = [{"title": "Dev", "company": "Acme", "location": "rome", "link": "https://x.org/1", "description": "text"}]
    lines = [("dev", "rome", run, json.dumps({"jobs": jobs * n})) for run, n in (("1", 3), ("2", 2))] + [("ops", "rome", "1", "{")]
    path = tmp_path / "landed.json"
    path.write_text("\n".join(json.dumps(dict(zip(("position", "location", "run", "body"), line))) for line in lines))
    found = postings.from_responses(feeds.landed_responses(spark, str(path))).collect()
    assert sorted((r.position, r.location, r.pos, r.link) for r in found) == [("dev", "rome", k, "https://x.org/1") for k in (1, 2)]
    score = {"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": 0.5}}
    (tmp_path / "scores.json").write_text(json.dumps({"user_id": "u", "link": "https://x.org/1", "run": "1", "body": json.dumps(score)}))
    scored = postings.parse_scores(feeds.landed_scores(spark, str(tmp_path / "scores.json"))).collect()
    assert [(r.user_id, r.link, r.score) for r in scored] == [("u", "https://x.org/1", 0.5)]
