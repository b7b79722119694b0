"""Stores that polls read in part: pruning, ends of children, compaction, landed scores and responses, rejects and counts."""

import json
import os
import pathlib
import re
import uuid

import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from checks import inputs as given
from postwatch import schemas, session
from postwatch.operators import integrity, matching, postings, profiles, queue as queue_ops, subscriptions
from postwatch.plans import daily, poll, triage
from postwatch.sinks import crawl, files, generations, ledger, postings as postings_store, runs, users as user_store
from postwatch.sources import feeds, queue_csv
from postwatch.streaming import landing_stream, poll_stream

SEARCH = schemas.SEARCH_KEY


def user(k, new=False, confirmed=True, token=None):
    return (str(k), f"u{k}@x.org", "dev", f"town{k % 7}", "full", new, confirmed, token)


@pytest.fixture()
def root(spark, tmp_path):
    session.configure(spark)
    return str(tmp_path / "state")


@pytest.fixture()
def settings(spark, root):
    return poll.PollSettings(root, "secret", "https://c", "https://u", lambda searches: postings_store.read(spark, root, searches), buckets=4)


def serve(spark, settings, run, *requests):
    rows = [(k, kind, json.dumps(body)) for k, (kind, body) in enumerate(requests)]
    return poll.poll(spark, spark.createDataFrame(rows, schemas.CHANGE_FEED), run, "2025-01-01", settings)


def about(k, **more):
    return {"email": f"u{k}@x.org", "position": "dev", "location": f"town{k % 7}", "jobType": "full"} | more


def response(n, prefix="j"):
    jobs = [{"title": f"Job {k}", "company": "Acme", "location": "here", "link": f"https://x.org/{prefix}{k}", "description": "text"} for k in range(n)]
    return json.dumps({"jobs": jobs})


def landed(spark, *rows):
    return spark.createDataFrame([(p, l, run, None, body) for p, l, run, body in rows], schemas.RESPONSES)


def imported(spark, root, n=400, **more):
    user_store.write(spark.createDataFrame([user(k, **more) for k in range(n)], schemas.USERS), None, root, "0")


# --- pruning -----------------------------------------------------------------------------------------------------------


def pruned_scans(frame):
    """How many scans of files the plan has; each of them must have a dynamic filter on its part."""
    spark, name = frame.sparkSession, "spark.sql.maxMetadataStringLength"
    spark.conf.set(name, "5000")
    try:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset(name)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert all(re.search(r"PartitionFilters: \[[^]]*dynamicpruning", line) for line in scans), scans
    return len(scans)


def test_polls_read_pruned_parts_of_every_store(spark, root):
    imported(spark, root)
    rows = spark.createDataFrame([(k, str(j), f"s{k}") for j in range(400) for k in range(2)], schemas.SKILLS)
    for name in user_store.CHILDREN:
        value = user_store.CHILDREN[name].names[2]
        user_store.write_children(rows.withColumnRenamed("skill", value), root, name, "0")
    every = spark.createDataFrame([(f"u{k}@x.org", f"https://x.org/{j}", "dev", f"town{k % 7}") for k in range(400) for j in range(3)], schemas.LEDGER)
    ledger.append(every, root, "0", buckets=4)
    user_store.write(spark.createDataFrame([user(900 + k, confirmed=False, token=f"t{k}") for k in range(50)], schemas.USERS), spark.createDataFrame([user(399)], schemas.USERS), root, "1")
    postings_store.write(landed(spark, *[("dev", f"town{k}", "1", response(2)) for k in range(60)]), root, "0")

    keys = spark.createDataFrame([user(5), user(9)], schemas.USERS)
    ids = keys.select(F.col("id").alias("user_id"))
    tokens = spark.createDataFrame([("t7",), ("nobody",)], "token string")
    concerned = poll.concerned(spark, root, keys.select(*schemas.USER_KEY), "2")
    children = user_store.children(spark, root, "skills", ids)
    sent = ledger.of_subscriptions(spark, root, keys)
    searched = postings_store.read(spark, root, keys.select(*SEARCH))
    # users; skills and ended; the ledger; responses, once for their ages and once for the newest
    assert [pruned_scans(frame) for frame in (concerned, children, sent, searched)] in ([1, 2, 1, 2], [1, 1, 1, 2])  # no ended ones there, no scan
    found = user_store.found(spark, root, "2", tokens)
    found.collect()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    # the rows are those that a full read gives
    assert sorted(r.id for r in concerned.collect()) == ["5", "9"]
    assert sorted(children.collect()) == sorted(user_store.children(spark, root, "skills").join(ids, "user_id", "left_semi").select(*schemas.SKILLS.names).collect())
    assert sorted(sent.collect()) == sorted(ledger.read(spark, root).join(keys, schemas.USER_KEY, "left_semi").select(*schemas.LEDGER_KEY).collect())
    assert len(sent.collect()) == 6
    wanted = postings_store.read(spark, root).join(keys, SEARCH, "left_semi")
    assert sorted(r.link for r in searched.collect()) == sorted(r.link for r in wanted.collect()) and searched.count() == 4
    assert [r.email for r in found.collect()] == ["u907@x.org"]


def files_read(frame):
    """Files the scans of a frame read."""
    def walk(node, out):
        if "numFiles" in (names := [k for k in iterate(node.metrics().keys())]):
            out.append(node.metrics().apply("numFiles").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan(), out)
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan(), out)
        for child in iterate(node.children()):
            walk(child, out)
        return out

    def iterate(collection):
        it = collection.iterator()
        while it.hasNext():
            yield it.next()

    frame.collect()
    return sum(walk(frame._jdf.queryExecution().executedPlan(), []))


def test_only_the_files_of_these_parts_are_opened(spark, root):
    imported(spark, root)
    every = user_store.stored(spark, root)
    keys = spark.createDataFrame([user(5)], schemas.USERS).select(*schemas.USER_KEY)
    assert files_read(every) > 60
    assert files_read(user_store.stored(spark, root, keys=keys)) <= 2


# --- polls -------------------------------------------------------------------------------------------------------------


def test_children_end_with_their_subscription(spark, root, settings):
    serve(spark, settings, "1", ("add", about(1, skills=["x"])), ("add", about(2, skills=["y"], education=["z"])))
    serve(spark, settings, "2", ("delete", about(1)), ("delete", about(2)), ("add", about(2, skills=["new"])))
    left = lambda: sorted(r.skill for r in user_store.children(spark, root, "skills").collect())
    assert left() == ["new"] and user_store.children(spark, root, "educations").count() == 0
    serve(spark, settings, "2", ("delete", about(1)), ("delete", about(2)), ("add", about(2, skills=["new"])))
    assert left() == ["new"] and {r.email for r in user_store.read(spark, root).collect()} == {"u2@x.org"}


def test_a_poll_writes_what_has_changed_and_leaves_out_the_rest(spark, root, settings):
    imported(spark, root, 20)
    counts = serve(spark, settings, "1", ("add", about(3)), ("delete", about(4)), ("confirm", {"token": "none"}))
    assert counts == {"n_add": 1, "n_delete": 1, "n_confirm": 1, "n_rejected": 0, "n_notify": 0, "n_welcome": 0}
    changed = runs.read_runs(spark, f"{root}/users", user_store.STORED).where("run_id = '1'").collect()
    assert [(r.email, r.deleted) for r in changed] == [("u4@x.org", True)]  # the add changed nothing
    assert not any(files.names(spark, f"{root}/{name}") for name in ("welcome_outbox", "outbox", "delivered", "sent_email"))
    counts = serve(spark, settings, "2")
    assert sum(counts.values()) == 0 and user_store.read(spark, root).count() == 19


def test_users_and_their_lookup_come_from_rows_worked_out_once(spark, root):
    drawn = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    user_store.write(spark.createDataFrame([user(k, new=k < 3) for k in range(9)], schemas.USERS).withColumn("confirmation_token", drawn()), None, root, "0")
    looked = runs.read_runs(spark, f"{root}/lookup", user_store._LOOKUP).where("kind = 'token'").collect()
    assert {(r.email, r.value) for r in looked} == {(r.email, r.confirmation_token) for r in user_store.read(spark, root).collect()} and len(looked) == 9


def test_differences_are_what_a_poll_has_to_write(spark):
    was = [user(1), user(2), user(3, token="t"), user(4, new=True)]
    now = [user(1), ("x", *user(2)[1:]), user(3), user(5, new=True, token="n")]
    before, after = (spark.createDataFrame(users, schemas.USERS) for users in (was, now))
    got = sorted((tuple(r) for r in poll.differences(before, after).collect()), key=str)
    want = [(*r, False) for r in after.exceptAll(before).collect()] + [(*r, True) for r in before.join(after, schemas.USER_KEY, "left_anti").select(*schemas.USERS.names).collect()]
    assert got == sorted(want, key=str) and len(got) == 4
    assert poll.differences(before, before).count() == 0


def test_requests_are_made_in_more_than_one_task(spark):
    """However few customers there are: they and the events are both dealt by their key."""
    t = given.Inputs(session.configure(spark), "/root/testdata/sf0.1")
    feed = t.feed()
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cast(user_id" in plan and feed.rdd.getNumPartitions() > 1


def test_new_users_are_notified_from_the_postings_store(spark, root, settings):
    user_store.write(spark.createDataFrame([user(k, new=k < 2) for k in range(9)], schemas.USERS), None, root, "0")
    postings_store.write(landed(spark, ("dev", "town0", "1", response(12)), ("dev", "town1", "1", "{"), ("dev", "town3", "1", response(1))), root, "p1")
    counts = serve(spark, settings, "1")
    assert (counts["n_notify"], counts["n_digests"], counts["n_delivered"]) == (2, 1, 10)
    assert {r.email for r in ledger.read(spark, root).collect()} == {"u0@x.org"}
    assert serve(spark, settings, "2")["n_notify"] == 0
    assert [tuple(r)[1:] for r in postings_store.rejected(spark, root).collect()] == [("dev", "town1", "1", "bad_json")]


# --- compaction --------------------------------------------------------------------------------------------------------


def state(spark, root):
    tables = [user_store.read(spark, root), ledger.read(spark, root), *[user_store.children(spark, root, name) for name in user_store.CHILDREN]]
    return [sorted(map(repr, t.collect())) for t in tables]


def n_files(root):
    stores = [*user_store.TABLES, "sent_email", "sent_by_key", "_generations"]
    return sum(1 for name in stores for path in pathlib.Path(root, name).rglob("*") if path.is_file() and path.suffix in (".parquet", ".json"))


def test_a_stream_of_polls_keeps_its_stores_small(spark, root, settings, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    imported(spark, root, 3, new=True)
    postings_store.write(landed(spark, *[("dev", f"town{k}", "1", response(2, f"t{k}-")) for k in range(7)]), root, "p1")
    seen = []
    for k in range(5):
        lines = [json.dumps({"seq": 0, "kind": "add", "body": json.dumps(about(20 + k, skills=["a"]))}), json.dumps({"seq": 1, "kind": "delete", "body": json.dumps(about(19 + k))})]
        (inbox / f"{k}.json").write_text("\n".join(lines))
        feed = feeds.change_stream(spark, str(inbox), files_per_batch=1)
        poll_stream.start(feed, settings, "r", checkpoint=str(tmp_path / "checkpoint"), once=True, compact_every=1).awaitTermination()
        seen.append(n_files(root))
        assert {r.email for r in user_store.read(spark, root).collect()} == {"u0@x.org", "u1@x.org", "u2@x.org", f"u{20 + k}@x.org"}
        assert user_store.children(spark, root, "skills").count() == 1
    assert max(seen[3:]) <= max(seen[1:3]) + 2 and ledger.read(spark, root).count() == 6
    assert len(files.names(spark, f"{root}/_generations")) <= 2


def test_a_lost_compaction_leaves_the_old_state(spark, root, settings, monkeypatch):
    imported(spark, root, 5)
    ledger.append(spark.createDataFrame([("a", "b", "c", "d")], schemas.LEDGER), root, "0", buckets=2)
    serve(spark, settings, "1", ("add", about(7, skills=["x"])), ("delete", about(2)))
    before = state(spark, root)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(generations.files, "create", lost)
    for store in (user_store, ledger):
        with pytest.raises(OSError):
            store.compact(spark, root)
        assert state(spark, root) == before
    monkeypatch.undo()
    for _ in range(2):
        serve(spark, settings, "2", ("add", about(8)))
        assert state(spark, root)[1] == before[1] and len(state(spark, root)[0]) == 6
        # the run under way is not folded; it may be done again
        poll.compact(spark, root, before="2")
    with pytest.raises(ValueError):
        serve(spark, settings, "1")
    with pytest.raises(ValueError):
        ledger.read(spark, root, without="0")


def test_stray_folders_of_a_lost_compaction_are_taken_away(spark, root):
    imported(spark, root, 5)
    user_store.write(spark.createDataFrame([user(8)], schemas.USERS), None, root, "0~0000000077")
    assert user_store.read(spark, root).count() == 5
    assert user_store.compact(spark, root) and user_store.read(spark, root).count() == 5
    assert files.names(spark, f"{root}/users") == ["run_id=0", "run_id=0~0000000001"]
    user_store.write(spark.createDataFrame([user(9)], schemas.USERS), None, root, "1")
    assert user_store.compact(spark, root) and user_store.read(spark, root).count() == 6
    assert files.names(spark, f"{root}/users") == ["run_id=0~0000000001", "run_id=1", "run_id=1~0000000002"]


# --- landed scores and responses ---------------------------------------------------------------------------------------

SCORED = "user_id string, link string, run string, score double, reject_reason string"


def test_a_pair_scored_often_is_one_candidate(spark):
    rows = [("u", "a", "1", 0.9, None), ("u", "a", "3", 0.8, None), ("u", "a", "2", 0.2, None), ("u", "b", "1", 0.9, None), ("u", "b", "2", None, "bad_json")]
    rows += [("v", "a", "1", 0.5, None), ("v", "a", "1", 0.6, None), ("v", "a", "1", None, "invalid_score"), ("w", "a", None, 0.1, None)]
    for order in (rows, rows[::-1]):
        found = matching.newest_scores(spark.createDataFrame(order, SCORED).repartition(3)).collect()
        assert sorted(map(tuple, found)) == [("u", "a", 0.8, None), ("u", "b", None, "bad_json"), ("v", "a", 0.6, None), ("w", "a", 0.1, None)]
    cands = spark.createDataFrame([("u", "a"), ("u", "b"), ("x", "a")], "user_id string, link string")
    got = matching.with_scores(cands, spark.createDataFrame(rows, SCORED)).collect()
    assert sorted((r.user_id, r.link, r.score) for r in got) == [("u", "a", 0.8), ("u", "b", None), ("x", "a", None)]


def test_responses_of_one_run_have_one_winner(spark, tmp_path):
    bodies = [response(n) for n in (1, 2, 3)]
    rows = [("dev", "rome", "2", body) for body in bodies] + [("dev", "rome", "1", response(9)), (None, "rome", "1", bodies[0])] + [("dev", "rome", "2", bodies[0])]
    winners = {tuple(sorted(r.body for r in postings.newest(landed(spark, *order).repartition(n)).collect())) for order in (rows, rows[::-1]) for n in (1, 5)}
    assert len(winners) == 1 and len(winners.pop()) == 2
    # of files the one that arrived last, whatever its hash
    for k, body in enumerate(bodies):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({"position": "dev", "location": "rome", "run": "1", "body": body}))
        os.utime(path, (1_700_000_000 + (k == 1), 1_700_000_000 + (k == 1)))
    found = postings.from_responses(feeds.landed_responses(spark, str(tmp_path)))
    assert found.count() == 2 and found.columns == schemas.POSTINGS.names[:2] + ["pos", "title", "company", "job_location", "link", "date_posted", "employment_type", "description"]


def test_landed_responses_as_a_stream(spark, root, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def land(name, *lines):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("position", "location", "run", "body"), line))) for line in lines))
        feed = feeds.landed_responses(spark, str(inbox), stream=True)
        landing_stream.start(feed, root, "r", str(tmp_path / "checkpoint"), once=True, compact_every=2).awaitTermination()

    land("one", ("dev", "rome", "1", response(3)), ("ops", "rome", "1", response(1)))
    assert postings_store.read(spark, root).count() == 4
    land("two", ("dev", "rome", "2", response(2)), ("ops", "rome", "2", "{"))
    assert postings_store.read(spark, root).count() == 2  # a broken response voids its search
    land("three", ("ops", "rome", "1", response(5)))  # late, and of an older run
    land("four", ("ops", "oslo", "1", response(4)))
    searches = spark.createDataFrame([("ops", "oslo"), ("no", "where")], "position string, location string")
    assert postings_store.read(spark, root).count() == 6 and postings_store.read(spark, root, searches).count() == 4


# --- rejects and counts ------------------------------------------------------------------------------------------------


def test_daily_run_tells_errors_from_low_scores(spark, root):
    users = spark.createDataFrame([user(k, confirmed=True) for k in (0, 7)], schemas.USERS)
    folded = profiles.fold(spark.createDataFrame([(1, "0", "x")], schemas.SKILLS), schemas.empty(spark, schemas.EXPERIENCES), schemas.empty(spark, schemas.EDUCATIONS))
    responses = landed(spark, ("dev", "town0", "1", response(9)), ("dev", "town0", "2", response(4)), ("dev", "town9", "1", "{"))
    score = lambda s: json.dumps({"jobRequirements": {}, "userProfile": {}, "similarityScore": {"score": s}})
    lines = [("0", "https://x.org/j0", "1", score(0.9)), ("0", "https://x.org/j0", "2", score(0.1)), ("0", "https://x.org/j1", "1", "{"), ("0", "https://x.org/j2", "1", score(0.7))]
    scores = spark.createDataFrame(lines, "user_id string, link string, run string, body string")
    for run in ("1", "1", "2"):
        out = daily.run_daily(spark, users, folded, None, daily.Scoring(landed=scores), root, run, "https://u", "2025-01-01", responses=responses, buckets=2)
    assert sorted(tuple(r) for r in daily.rejects(spark, root).where("run_id = '1'").select("source", "row_key", "reject_reason").collect()) == [
        ("response", "dev/town9", "bad_json"), ("score", "0/https://x.org/j1", "bad_json")
    ]
    first, second = (daily.counts(spark, root).where(F.col("run_id") == run).drop("run_id").first().asDict() for run in "12")
    # u0: one below, one failed, one passed, one never scored; u7 has no profile
    assert first == {"n_scored": 8, "n_passed": 1, "n_below_threshold": 1, "n_unscored": 5, "n_error": 1, "n_delivered": 7, "n_digests": 2}
    assert second == first | {"n_delivered": 0, "n_digests": 0} and out.count() == 0


def test_a_raising_scorer_is_seen_in_outcomes_rejects_and_counts(spark, root):
    def scorer(batch):
        if batch["link"].str.endswith("2").any():
            raise ValueError("no answer")
        return pd.Series(0.9, batch.index)

    users = spark.createDataFrame([user(0)], schemas.USERS)
    folded = profiles.fold(spark.createDataFrame([(1, "0", "x")], schemas.SKILLS), schemas.empty(spark, schemas.EXPERIENCES), schemas.empty(spark, schemas.EDUCATIONS))
    offered = postings.from_responses(landed(spark, ("dev", "town0", "1", response(4))))
    daily.run_daily(spark, users, folded, offered, daily.Scoring(function=scorer, inputs=("link",)), root, "1", "https://u", "2025-01-01", buckets=2)
    assert [tuple(r)[:3] for r in daily.rejects(spark, root).collect()] == [("scorer", "0/https://x.org/j2", "ValueError: no answer")]
    counts = daily.counts(spark, root).first()
    assert (counts.n_error, counts.n_passed, counts.n_delivered) == (1, 3, 4)


def test_triage_counts_are_taken_on_the_way(spark, tmp_path):
    root = str(tmp_path)
    queue = spark.createDataFrame([(k, f"u{k // 2}", "n") for k in range(20)], "pos long, job_url string, note string")
    pages = spark.createDataFrame([(f"u{k}", f"<title>t</title> {k}") for k in range(10) if k != 3], "url string, html string")
    expected = []
    for run, size in (("1", 5), ("2", 6), ("2", 6), ("3", None)):
        done = runs.read_runs(spark, f"{root}/processed", triage._PROCESSED, without=run).select("job_url")
        expected.append(queue_ops.counts(queue, done, triage.triage_pass(queue, done, pages, "d", size=size).newly).first())
        triage.run_triage(spark, queue, pages, root, run, "d", size=size)
    found = {r.run_id: tuple(r)[:5] for r in triage.counts(spark, root).collect()}
    assert found == {run: tuple(expected[k]) for run, k in (("1", 0), ("2", 2), ("3", 3))}


def test_counting_adds_no_scan(spark, root):
    t = given.Inputs(session.configure(spark), "/root/testdata/sf0.001")
    scans = lambda frame: frame._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    args = (t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring())
    counted = daily.daily_digest(*args, seen=Observation())
    assert scans(counted) == scans(daily.daily_digest(*args)) and "CollectMetrics" in counted._jdf.queryExecution().sparkPlan().toString()


# --- queue files and keys ----------------------------------------------------------------------------------------------


def test_a_queue_keeps_its_order_over_many_files(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("http://x/"), F.col("id")).alias("job_url"), F.lit('a "b", c').alias("note"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        crawl.write_csv(rows.repartition(7), str(tmp_path / "queue"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "queue").glob("*.csv"))) > 1
    back = queue_csv.scan(spark, str(tmp_path / "queue"), whole=True)
    assert sorted(back.select("pos", "job_url", "note").collect()) == sorted(rows.collect())
    left = queue_ops.remaining(back, rows.where("pos % 3 = 0").select("job_url"))
    crawl.write_remaining(left, str(tmp_path / "queue"), str(tmp_path / "left"))
    again = queue_csv.scan(spark, str(tmp_path / "left"), whole=True).orderBy("pos").collect()
    assert [r.job_url for r in again] == [f"http://x/{k}" for k in range(3000) if k % 3] and [r.pos for r in again] == list(range(2000))


def test_violations_name_the_key(spark):
    rows = [("1", "a", "p", "l"), ("1", "b", "p", "l"), ("2", "c", "p", "l"), ("3", "c", "p", "l"), (None, "d", "p", "l"), (None, "e", None, "l"), ("4", "f", None, "l"), ("5", "f", None, "l")]
    table = spark.createDataFrame(rows, "id string, email string, position string, location string")
    found = integrity.violations(table, {"primary": ["id"], "unique": schemas.USER_KEY})
    assert sorted(map(tuple, found.collect())) == [
        ("primary", '{"id":"1"}', 2), ("unique", '{"email":"c","position":"p","location":"l"}', 2)
    ]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") <= 1
    assert integrity.null_keys(table, schemas.USER_KEY).count() == 3
    assert subscriptions.lookup(table, "a", "p", "l").count() == 1
