"""Merging, documents, storage and validation."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse.operators import merge, validate
from tallyhouse.session import scratch_dir
from tallyhouse.sources import documents, storage


def test_merge_keeps_the_target_and_the_first_loaded(spark):
    target = spark.createDataFrame([(1, "t", 0)], "k int, v string, n int")
    source = spark.createDataFrame([(1, "s", 1), (2, "b", 2), (2, "a", 1), (3, None, 1)], "k int, v string, n int")
    assert rows(merge.merge_insert_new(target, source, ["k"], ["n"])) == [(1, "t", 0), (2, "a", 1), (3, None, 1)]
    assert rows(merge.merge_insert_new(None, source, ["k"], ["n"])) == [(1, "s", 1), (2, "a", 1), (3, None, 1)]
    assert rows(merge.merge_counts(target, source, ["k"], ["n"])) == [(1, 4, 2)]


def test_upsert_takes_nulls_and_leaves_other_columns(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, w int")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(merge.upsert(target, source, ["k"], ["v"])) == [(1, "a", 10), (2, None, 20), (3, "c", None)]


def test_next_ids_start_above_everything(spark):
    existing = spark.createDataFrame([(12_000,)], "id bigint")
    new = spark.createDataFrame([(i,) for i in (250_000, 5, 130_000)], "k bigint")
    assert rows(merge.next_ids(existing, "id", new, "k")) == [(130_000, 12_002), (250_000, 12_003), (5, 12_001)]
    assert merge.next_ids(existing.limit(0), "id", new, "k").agg(F.min("new_id")).first()[0] == 10_001


def test_partition_key_takes_the_first_present_field(spark):
    docs = spark.createDataFrame([('{"id":"9","sku":"s"}',), ('{"cartId":"c","customerId":5}',), ("{}",)], "data string")
    assert [r[0] for r in docs.select(documents.partition_key()).collect()] == ["s", "5", ""]


def test_document_query_on_absent_fields(spark):
    docs = spark.createDataFrame([("1", '{"a":"x","n":{"b":2}}'), ("2", '{"a":"y"}')], "id string, data string")
    assert rows(documents.document_query(docs, {"a": "x"}, ["n.b", "zz"])) == [("2", None)]
    assert rows(documents.document_query(docs, {"zz": ""}, ["a"])) == [("x",), ("y",)]


def test_ndjson_export_and_import(spark):
    docs = spark.createDataFrame([("1", "p1", '{"v":1}'), ("2", "p2", "{}"), ("3", "p3", '{"id":"3","v":[1,{"w":2}]}')], "id string, partition_key string, data string")
    lines = [json.loads(r[0]) for r in documents.json_lines(docs).collect()]
    assert lines[1] == {"id": "2", "partition_key": "p2"} and lines[2]["v"] == [1, {"w": 2}]
    path = scratch_dir(spark, "t")
    extra = spark.createDataFrame([("",), ("   ",), ("{broken",)], "value string")
    documents.json_lines(docs).unionByName(extra).write.text(path)
    target = spark.createDataFrame([("1", "old", "old"), ("8", "keep", "{}")], "id string, partition_key string, data string")
    got = {r["id"]: r for r in documents.import_ndjson(spark, path, target).collect()}
    assert set(got) == {"1", "2", "3", "8"} and json.loads(got["1"]["data"])["v"] == 1 and got["8"]["partition_key"] == "keep"


def test_parity(spark):
    a = spark.createDataFrame([(1, 100.0), (2, None), (3, 0.0), (4, 1.0), (5, 100.0)], "k int, v double")
    b = spark.createDataFrame([(1, 100.9), (2, None), (3, 0.0), (5, 102.0)], "k int, v double")
    got = {r["k"]: r["matches"] for r in validate.result_parity(a, b, ["k"], "v").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_decimals_become_doubles_everywhere(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(9,2)) a, array(CAST(1 AS DECIMAL(5,1))) b, named_struct('c', map('k', CAST(2 AS DECIMAL(4,0)))) d, 'x' e")
    assert "decimal" not in validate.decimal_to_double(df).schema.simpleString()


def test_key_check_and_counts(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(validate.validate_table(df, "t", ["k"])) == [("t", 3, 2, 1, 1)]
    assert rows(validate.validate_table(df.limit(0), "t", ["k"])) == [("t", 0, 0, 0, 0)]
    assert rows(validate.compare_counts({"a": df, "b": df}, {"a": df, "c": df})) == [("a", 3, 3, False), ("b", 3, 0, True), ("c", 0, 3, True)]
    assert ("t", "k", "int", True) in rows(validate.schema_rows(spark, {"t": df}))


def test_storage_round_trip(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = scratch_dir(spark, "t")
    storage.export_table(df, path)
    assert rows(storage.read_table(spark, path, "k int, v string")) == [(1, "a")]
    assert rows(storage.replace_table(df.withColumn("k", F.lit(5)), path)) == [(5, "a")]


def test_complete_orders(spark):
    batch = spark.createDataFrame([(1, 7, '[{"sku":1,"qty":2,"price":1.5},{"sku":2,"price":3.0}]', "paypal")], "order_id int, customer_id int, items string, payment_method string")
    made = merge.complete_orders(batch)
    assert rows(made["orders"]) == [(1, 7, 6.0, "pending")]
    assert rows(made["order_items"]) == [(1, 1, 1, 2, 1.5, 3.0), (1, 2, 2, 1, 3.0, 3.0)]
    assert rows(made["payments"]) == [(1, 6.0, "paypal", "authorized")]


def test_scenario_numbers_of_five_digits_stay_whole(spark):
    from tallyhouse.sources import derive

    found = spark.range(12345, 12346).select(derive.scenario("conversion", F.col("id")).alias("s")).first().s
    assert found == "conversion_12345"


def test_trend_honours_more_than_a_thousand_hours(spark):
    from tallyhouse.plans import drilldowns

    names = "hour_of_simulation hour_of_day day_of_week channel arrival_count order_count abandonment_count revenue avg_basket_size id".split()
    hours = spark.range(1500).select(*[(F.lit("online") if n == "channel" else F.col("id")).alias(n) for n in names])
    assert drilldowns.hourly_trend(hours, 5000, "online").count() == 1500


def test_ranked_reviews_shuffle_no_text(small):
    from tallyhouse.plans import drilldowns

    small.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = drilldowns.review_listing(small["customer_reviews"])._jdf.queryExecution().executedPlan().toString()
    finally:
        small.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" in plan


def test_campaign_counts_need_no_join(small):
    plan = small["campaign_interactions"].groupBy("campaign_type").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
