"""Hot keys: the same answers as without salting, and bounded work per task."""

import random

import pytest
from pyspark.sql import functions as F

from postwatch.operators import matching, skew


@pytest.fixture(scope="module")
def crowded(spark):
    """Two thirds of the rows in two keys, over several partitions."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else "warm" if i % 3 == 1 else f"k{rng.randrange(50)}", "l", i, f"v{i}") for i in range(6000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "position string, location string, pos long, link string").repartition(7)


@pytest.mark.parametrize("fanout", [1, 5, 64])
def test_first_k(spark, crowded, fanout):
    want: dict[str, list[int]] = {}
    for row in sorted(crowded.collect(), key=lambda r: r.pos):
        want.setdefault(row.position, []).append(row.pos)
    got: dict[str, dict[int, int]] = {}
    for row in matching.top_per_search(crowded, 10, fanout).collect():
        got.setdefault(row.position, {})[row.search_rank] = row.pos
    assert got == {key: dict(enumerate(values[:10], 1)) for key, values in want.items()}


def test_first_k_cuts_before_the_shuffle(spark, crowded):
    plan = skew.first_k(crowded, ["position"], [F.col("pos")], 10)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_first_row(spark, crowded):
    want: dict[str, int] = {}
    for row in crowded.collect():
        want[row.position] = min(want.get(row.position, row.pos), row.pos)
    first = skew.first_row(crowded, ["position", "location"], [F.col("pos")])
    assert first.columns == crowded.columns
    assert {r.position: r.pos for r in first.collect()} == want


def test_hot_keys(spark, crowded):
    assert sorted(r.position for r in skew.hot_keys(crowded, ["position"], 1000).collect()) == ["hot", "warm"]
    assert skew.hot_keys(crowded, ["position"], 10**9).count() == 0


def test_any_number_of_hot_keys_is_spread(spark):
    """1,500 hot keys: each one's rows are dealt to many salts, none is left out."""
    rows = spark.range(1500 * 20).select((F.col("id") % 1500).alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.col("id").alias("k"))
    joined = skew.salted_join(rows, right.withColumn("n", F.lit(1)), ["k"], "inner", ["v"], least=20, fanout=8)
    assert joined.count() == 30_000 and skew.hot_keys(rows, ["k"], 20).count() == 1500
    salts = rows.groupBy("k").agg(F.count_distinct(F.pmod(F.xxhash64("v"), F.lit(8))).alias("n"))
    assert salts.agg(F.min("n")).first()[0] >= 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("least", [1, 500])
def test_salted_join_equals_the_plain_one(spark, crowded, how, least):
    right = spark.createDataFrame([("hot", "l", 1), ("hot", "l", 2), ("k1", "l", 3), ("nobody", "l", 4)], "position string, location string, n int")
    keys = ["position", "location"]
    plain = crowded.join(right, keys, how)
    salted = skew.salted_join(crowded, right, keys, how, ["pos"], least=least, fanout=8).select(*plain.columns)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


def test_a_hot_search_is_spread_over_tasks(spark):
    """One search holds all users: its rows end up in many partitions."""
    users = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.lit("p").alias("position"), F.lit("l").alias("location"), F.col("id").cast("string").alias("email")
    )
    top = spark.createDataFrame([("p", "l", i, f"https://x.org/{i}") for i in range(3)], "position string, location string, pos long, link string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sizes = [r["count"] for r in matching.candidates(users, top, hot_rows=100).groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in matching.candidates(users, top).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == sum(plain) == 12000
    assert len(plain) == 1 and max(sizes) < 12000 / 4
