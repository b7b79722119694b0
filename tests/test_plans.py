"""What the plans must look like."""

import re

import pandas as pd
import pytest

from checks import inputs as given, registry
from postwatch import session
from postwatch.operators import digest, matching, profiles, subscriptions
from postwatch.plans import daily
from postwatch.sinks import ledger as ledger_sink

SF_DIR = "/root/testdata/sf0.001"
PYTHON = re.compile(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInArrow")


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(build(spark, SF_DIR)) for name, build in registry.all_queries().items()}


def test_python_runs_in_one_query_only_and_once(plans):
    for name, plan in plans.items():
        assert len(PYTHON.findall(plan)) == (1 if name.startswith("scores_by_function") else 0), name


def test_no_cross_or_nested_loop_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_page_texts_are_not_moved(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = registry.all_queries()["crawl_results"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin" in plan
    moved = [line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line]
    assert moved and not any("html#" in line for line in moved)
    # what an exchange moves is the output of its child
    for above, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange" in above and "Project" in below:
            assert "html#" not in below


def test_function_stays_above_the_anti_join(spark):
    t = given.Inputs(session.configure(spark), SF_DIR)

    def scorer(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([1.0] * len(batch), index=batch.index)

    scoring = daily.Scoring(function=scorer, inputs=("description",))
    plan = plan_of(daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), scoring))
    assert len(PYTHON.findall(plan)) == 1
    assert plan.index("MapInPandas") < plan.index("LeftAnti")


def test_expression_score_is_paid_before_the_anti_join_and_lists_stay_out_of_it(spark):
    t = given.Inputs(session.configure(spark), SF_DIR)
    ranked = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring())
    above = plan_of(ranked).split("LeftAnti")[0]
    assert "array_intersect" not in above and "description" not in above


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    t = given.Inputs(session.configure(spark), SF_DIR)
    t.users().write.parquet(str(tmp_path / "users"))
    users = spark.read.parquet(str(tmp_path / "users"))
    plan = plan_of(subscriptions.confirmed(users).select("id"))
    assert re.search(r"PushedFilters: \[[^\]]*is_confirmed", plan)
    assert re.search(r"ReadSchema: struct<id:string,is_confirmed:boolean>", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(email,a\)", plan_of(subscriptions.lookup(users, "a", "b", "c")))


def test_fold_needs_one_shuffle(spark):
    tables = [
        spark.createDataFrame([(1, "u", "x")], f"id int, user_id string, {name} string") for name in ("skill", "experience", "education")
    ]
    assert plan_of(profiles.fold(*tables)).count("Exchange hashpartitioning") == 1


def test_digest_is_folded_where_it_was_ranked(spark):
    t = given.Inputs(session.configure(spark), SF_DIR)
    folded = digest.outbox(digest.ranked(t.candidates()), "https://x.org", "2025-01-01")
    assert "Exchange" not in plan_of(folded).split("Window [")[0]


@pytest.fixture()
def planned(spark):
    """Plans as of large tables, not changed while they run."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def above(plan: str, scan: str) -> list[str]:
    """The operators between a scan and the join it feeds."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if scan in line)
    depth = lambda line: max(line.find("+- "), line.find(":- "))
    out, low = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) == low - 3:
            low -= 3
            if "Join" in line:
                return out
            out.append(line)
    return out


def test_ledger_is_neither_shuffled_nor_sorted(spark, tmp_path, planned):
    t = given.Inputs(session.configure(spark), SF_DIR)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows, root = t.ledger(), str(tmp_path)
    for run in ("a", "b", "b"):
        ledger_sink.append(rows, root, run, buckets=4)
    assert ledger_sink.read(spark, root).count() == 2 * rows.count()
    assert ledger_sink.read(spark, root, without="a").count() == rows.count()
    assert ledger_sink.compact(spark, root)
    assert ledger_sink.read(spark, root).count() == rows.count()
    base, since = ledger_sink.parts(spark, root)
    assert since.count() == 0
    ranked = daily.daily_digest(t.users(), t.profiles(), t.postings(), [base, since], daily.Scoring())
    plan = plan_of(ranked)
    assert plan.count("LeftAnti") == 2 and plan.count("Bucketed: true") == 2
    scan = re.search(r"FileScan parquet [^\n]*PartitionFilters: \[[^\]]*run_id#\d+ = b~", plan)
    feeding = above(plan, scan[0])
    assert feeding and not any("Exchange" in line or "Sort" in line for line in feeding)
    # the candidates are moved once for both parts
    assert "Exchange" not in plan.split("LeftAnti")[1]
    expected = daily.daily_digest(t.users(), t.profiles(), t.postings(), rows, daily.Scoring())
    assert sorted(map(repr, ranked.collect())) == sorted(map(repr, expected.collect()))


@pytest.mark.parametrize("name", ["digest_ranked", "daily_digest"])
def test_top_k_is_cut_ahead_of_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name]


def test_first_rows_of_a_queue_need_no_global_sort(plans):
    assert "TakeOrderedAndProject" in plans["queue_next_batch"]
