"""Prefix scans against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import ordered


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(60)}")
        rows.append((key, rng.randrange(40), i, rng.randrange(-9, 10), None if i % 11 == 0 else f"s{i % 5}"))
    df = spark.createDataFrame(rows, "key string, day int, id int, v int, state string")
    return df, rows


def _groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


def test_running_sum(events):
    df, rows = events
    got = ordered.running_sum(df, ["key"], ["day", "id"], "v", "s")
    expected = {}
    for group in _groups(rows).values():
        acc = 0
        for r in group:
            acc += r[3]
            expected[r[2]] = acc
    assert {r["id"]: r["s"] for r in got.collect()} == expected
    assert got.columns == [*df.columns, "s"]


@pytest.mark.parametrize("most", [1, 20, 250, 10_000])
def test_running_sums_of_small_and_large_keys(spark, events, most):
    """Keys of more rows than a task takes are cut into parts, the others are not; both meet the rows beside them."""
    df, rows = events
    levels = [("hot", 5), (None, 6), ("k1", 7), ("k1", 8)]
    beside = spark.createDataFrame(levels, "key string, level int")
    got = ordered.running_sums(df.withColumn("one", F.lit(1)), ["key"], ["day", "id"], {"s": "v", "n": "one"}, beside, most=most)
    expected = []
    for key, group in _groups(rows).items():
        acc = 0
        for n, r in enumerate(group, 1):
            acc += r[3]
            expected += [(r[2], acc, n, level) for level in [x for k, x in levels if k == key and k is not None] or [None]]
    assert sorted(map(repr, ((r["id"], r["s"], r["n"], r["level"]) for r in got.collect()))) == sorted(map(repr, expected))
    inner = ordered.running_sums(df, ["key"], ["day", "id"], {"s": "v"}, beside, "inner", most)
    assert inner.count() == sum(1 for r in expected if r[3] is not None)


def test_small_keys_are_exchanged_once_with_what_they_meet(spark, events):
    df, _ = events
    beside = spark.createDataFrame([("hot", 5)], "key string, level int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = df.filter("key <> 'hot'")  # 600 rows, 6 tasks
        plan = ordered.running_sums(small, ["key"], ["day", "id"], {"s": "v"}, beside, most=100)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and plan.count("Sort [") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_previous_value_carries_nulls_across_parts(events):
    df, rows = events
    got = ordered.previous_value(df, ["key"], ["day", "id"], "state", "p")
    expected = {}
    for group in _groups(rows).values():
        before = None
        for r in group:
            expected[r[2]] = before
            before = r[4]
    assert {r["id"]: r["p"] for r in got.collect()} == expected


def test_row_numbers_by_key_and_over_the_whole_table(events):
    df, rows = events
    got = ordered.row_numbers(df, ["key"], ["day", "id"], "n")
    expected = {r[2]: i + 1 for g in _groups(rows).values() for i, r in enumerate(g)}
    assert {r["id"]: r["n"] for r in got.collect()} == expected
    whole = ordered.row_numbers(df, [], ["id"], "n")
    assert all(r["n"] == r["id"] + 1 for r in whole.collect())


def test_one_key_on_one_day_takes_many_tasks(spark):
    """All rows under one key and one day: each part of the key stays small."""
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.lit(1).alias("day"), (F.col("id") * 7919 % 20_000).alias("id"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.running_sum(df, ["key"], ["day", "id"], "v", "s")
        assert got.filter(F.col("s") != F.col("id") + 1).count() == 0
        parts = [r["n"] for r in ordered._dealt(df, ["key"], ["day", "id"]).groupBy(ordered.PART).agg(F.count("*").alias("n")).collect()]
        assert len(parts) == 4 and max(parts) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_empty_table(events):
    df, _ = events
    assert ordered.running_sum(df.limit(0), ["key"], ["day", "id"], "v", "s").collect() == []
    assert ordered.row_numbers(df.limit(0), [], ["id"], "n").collect() == []


def test_top_n_limits_before_the_shuffle(events):
    df, rows = events
    best = ordered.top_n(df, ["key"], [F.desc("v"), F.asc("id")], 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[3], r[2]))[:3]
    assert [r["id"] for r in best.filter("key = 'hot'").orderBy("rank").collect()] == [r[2] for r in hot]
