"""Bucketed tables, exact selection, the bending trend and the portable draw."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse.functions import selection
from tallyhouse.ml import forecast, trend
from tallyhouse.operators import merge, sweeps, validate
from tallyhouse.session import scratch_dir
from tallyhouse.sources import documents
from tallyhouse.sources.buckets import BucketTable


def stored(spark, df, *key, buckets=8):
    return BucketTable(scratch_dir(spark, "bucketed"), df.schema, key, buckets).create(df)


def files(df):
    return sorted(r[0] for r in df.select(F.input_file_name()).distinct().collect())


def test_upsert_rewrites_only_touched_buckets(spark):
    first = spark.range(2000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("w"))
    table = stored(spark, first, "id", buckets=16)
    batch = spark.createDataFrame([(5, "new"), (9_999, None)], "id bigint, v string")
    touched = table.touched(batch)
    assert 1 <= len(touched) <= 2
    other = [b for b in range(16) if b not in touched]
    before, gone = files(table.of(spark, other)), files(table.of(spark, touched))
    scanned = table.of(spark, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "PartitionFilters: []" not in scanned
    expected = rows(merge.upsert(first, batch, ["id"], ["v"]))
    table.upsert(batch, ["v"])
    assert rows(table.read(spark)) == expected
    assert files(table.of(spark, other)) == before
    assert not set(files(table.of(spark, touched))) & set(gone)
    table.upsert(batch, ["v"])  # once more: nothing changes
    assert rows(table.read(spark)) == expected


def test_insert_appends_and_leaves_files(spark):
    table = stored(spark, spark.createDataFrame([(1, "t", 0)], "k int, v string, n int"), "k")
    before = files(table.read(spark))
    source = spark.createDataFrame([(1, "s", 1), (2, "b", 2), (2, "a", 1), (3, None, 1)], "k int, v string, n int")
    table.insert_new(source, ["n"])
    assert rows(table.read(spark)) == [(1, "t", 0), (2, "a", 1), (3, None, 1)]
    assert set(before) <= set(files(table.read(spark)))
    table.insert_new(source, ["n"])
    assert table.read(spark).count() == 3


def test_empty_table_empty_batch_and_other_key_type(spark):
    empty = spark.createDataFrame([], "k bigint, v string")
    table = stored(spark, empty, "k")
    assert table.read(spark).count() == 0
    table.upsert(empty, ["v"])
    assert table.read(spark).count() == 0
    table.upsert(spark.createDataFrame([(7, "x")], "k int, v string"), ["v"])
    table.upsert(spark.createDataFrame([(7, "y")], "k bigint, v string"), ["v"])
    assert rows(table.read(spark)) == [(7, "y")]


def test_import_into_a_stored_collection(spark):
    old = spark.createDataFrame([(str(i), "old", "{}") for i in range(50)], "id string, partition_key string, data string")
    table = stored(spark, old, "id")
    path = scratch_dir(spark, "lines")
    spark.createDataFrame([('{"id":"3","sku":"s"}',), ("",), ("{broken",), ('{"id":"90"}',)], "value string").write.text(path)
    expected = rows(documents.import_ndjson(spark, path, old))
    assert rows(documents.import_into(table, spark, path).read(spark)) == expected and len(expected) == 51


VALUES = [
    [1.0], [2.0, 1.0], [3.0, -1.5, 0.0, -0.0], [None, 5.0, 5.0, 7.0], [1e-300, -1e300, math.inf, 2.0],
    [random.Random(1).gauss(0, 1e5) for _ in range(999)], [4.0] * 500 + [9.0] * 500,
]


@pytest.mark.parametrize("values", VALUES, ids=lambda v: str(len(v)))
def test_median_equals_the_sorted_one(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert selection.median(df, F.col("v")).first()[0] == statistics.median([v for v in values if v is not None])


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert selection.median(df, F.col("v")).first()[0] is None and selection.median(df.limit(0), F.col("v")).first()[0] is None


def test_bits_order_like_numbers(spark):
    values = [-math.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.ordered_bits(F.col("v")).alias("b"))
    back = df.withColumn("back", selection.from_ordered_bits(F.col("b"))).orderBy("b").collect()
    assert [str(r.v) for r in back] == [str(v) for v in values] == [str(r.back) for r in back]


def hours(spark, values, key="a"):
    return spark.createDataFrame([(key, t, float(y)) for t, y in enumerate(values)], "channel string, t int, y double")


def test_trend_follows_a_break(spark):
    """The slope turns from 1 to -2 in the middle; a straight line would go on rising."""
    values = [t if t < 300 else 300 - 2 * (t - 300) for t in range(600)]
    season = [20 * math.sin(2 * math.pi * t / 24) for t in range(624)]
    found = trend.forecast(hours(spark, [v + s for v, s in zip(values, season)]), ["channel"]).orderBy("t").collect()
    assert [r.t for r in found] == list(range(600, 624))
    for r in found:
        assert abs(r.trend - (300 - 2 * (r.t - 300))) < 25
        assert abs(r.daily - season[r.t]) < 5 and r.yhat_lower <= r.yhat <= r.yhat_upper


def test_trend_equals_dense_least_squares(spark):
    shape, rng = trend.Shape(), np.random.default_rng(3)
    t = np.arange(400)
    y = 50 + 0.3 * t + 9 * np.cos(2 * np.pi * t / 168) + rng.normal(0, 2, 400)
    at = t / 399
    x = [np.ones(400), at] + [np.maximum(at - 0.8 * j / 9, 0) for j in range(1, 9)]
    for order, period in ((4, 24), (3, 168)):
        for k in range(1, order + 1):
            x += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    x, scale = np.stack(x, 1), np.abs(y).max()
    whole = np.vstack([x, np.diag(np.sqrt(shape.penalties))])
    beta = np.linalg.lstsq(whole, np.concatenate([y / scale, np.zeros(24)]), rcond=None)[0] * scale
    series = hours(spark, y)
    fitted = trend.fit(series, ["channel"])
    guess = trend.components(series.select("channel", "t"), fitted, ["channel"]).orderBy("t").collect()
    assert np.allclose([r.yhat for r in guess], x @ beta, rtol=1e-6, atol=1e-6)
    assert fitted.first().sigma == pytest.approx(np.sqrt(np.mean((y - x @ beta) ** 2)), rel=1e-6)
    assert trend.optimality(series, ["channel"]).first().slope < 1e-8


def test_trend_of_short_constant_and_missing(spark):
    short, flat = hours(spark, range(23), "short"), hours(spark, [5] * 30, "flat")
    gaps = spark.createDataFrame([("flat", None, 1.0), ("flat", 3, None)], "channel string, t int, y double")
    found = trend.forecast(short.unionByName(flat).unionByName(gaps), ["channel"], 2).orderBy("t").collect()
    assert [(r.channel, r.t) for r in found] == [("flat", 30), ("flat", 31)]
    assert all(abs(r.yhat - 5) < 1e-6 for r in found)
    assert trend.forecast(flat.limit(0), ["channel"]).count() == 0


def test_forecast_without_channel(spark):
    demand = spark.createDataFrame(
        [(d, h, c, 3 * h + (d + 1) * (2 if c == "a" else 1)) for d in range(7) for h in range(24) for c in "ab"],
        "day_of_week int, hour_of_day int, channel string, y int")
    both = demand.groupBy("day_of_week", "hour_of_day").agg(F.sum("y").alias("y")).withColumn("channel", F.lit("x"))
    alone = forecast.forecast(both).drop("channel")
    assert rows(forecast.forecast(demand, keys=())) == rows(alone)
    assert rows(forecast.cross_validation(demand, keys=())) == rows(forecast.cross_validation(both).drop("channel"))


def test_draws_are_even_and_independent(spark):
    drawn = spark.range(9000).select(*[(sweeps.draw(42, k, F.col("id")) % 3).alias(f"d{k}") for k in range(2)])
    cells = {(r.d0, r.d1): r["count"] for r in drawn.groupBy("d0", "d1").count().collect()}
    assert len(cells) == 9 and sum((n - 1000) ** 2 / 1000 for n in cells.values()) < 27  # chi-square 0.999 of 8 degrees


def test_column_listing_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "k int, `odd name` string")
    assert rows(validate.column_listing({"t": df})) == [("t", "k", "int", True, 1), ("t", "odd name", "string", True, 2)]
