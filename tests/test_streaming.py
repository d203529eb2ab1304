import datetime as dt
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse.session import scratch_dir
from tallyhouse.streaming import reviews, windows


def _line(i, text, at="2024-01-01 00:00:00"):
    return json.dumps({"id": i, "review_text": text, "status": "To be processed", "created_at": at})


def test_replayed_lines_are_recorded_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    lines = [_line(1, "I love it"), _line(2, "terrible, want a refund"), _line(3, "  "), '{"id":', _line(1, "I love it")]
    Path(source / "a.json").write_text("\n".join(lines))

    def run():
        stream = reviews.once(reviews.process(reviews.raw_review_stream(spark, str(source))))
        reviews.record(stream, log, checkpoint).awaitTermination()
        return rows(reviews.current(spark, log, ["id"]).select("id", "sentiment_category", "status"))

    expected = [(1, "very_positive", reviews.PROCESSED), (2, "very_negative", reviews.HUMAN)]
    assert run() == expected
    assert run() == expected  # nothing new: the checkpoint knows the file
    Path(source / "b.json").write_text(_line(1, "I love it"))  # the producer sends it again
    assert run() == expected
    assert spark.read.parquet(log).count() == 2


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = spark.createDataFrame([(1, "a")], "id int, v string")
    for _ in range(2):
        batch.write.mode("overwrite").parquet(f"{log}/batch_id=0")
    spark.createDataFrame([(1, "b")], "id int, v string").write.parquet(f"{log}/batch_id=1")
    assert rows(reviews.current(spark, log, ["id"])) == [(1, "b")]


def test_classifier_replies(spark):
    body = '{"sentiment_category":"negative","sentiment_score":-0.4,"key_phrases":["x"],"confidence":0.9}'
    texts = [body, f"```json\n{body}\n```", f"note\n```\n{body}\n```", "no json", "```json\nbroken", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r[0]["sentiment_category"], r[0]["sentiment_score"]) for r in df.select(reviews.parse_classifier_json("t")).collect()]
    assert got == [("negative", -0.4)] * 3 + [("neutral", 0.0)] * 3


def test_word_list_reads_the_whole_text(spark):
    long = "word " * 20_000 + "Horrible! horrible, BROKEN"
    df = spark.createDataFrame([(1, long), (2, "good good bad"), (3, "")], "id int, review_text string")
    got = {r["id"]: r for r in reviews.classify(df).collect()}
    assert (got[1]["sentiment_category"], got[1]["key_phrases"]) == ("very_negative", ["horrible", "broken"])
    assert got[2]["sentiment_category"] == "positive" and abs(got[2]["sentiment_score"] - 1 / 3) < 1e-12
    assert (got[3]["sentiment_category"], got[3]["confidence"]) == ("neutral", 0.0)


def test_a_model_plugs_in_as_pandas_udf(spark):
    def scorer(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: '{"sentiment_category":"positive","sentiment_score":0.5}' if "yes" in t else "?")

    df = spark.createDataFrame([(1, "yes"), (2, "no")], "id int, review_text string")
    assert rows(reviews.classify(df, scorer).select("id", "sentiment_category")) == [(1, "positive"), (2, "neutral")]


def test_routing_rules(spark):
    cases = [
        (1, "meh", "very_negative"), (2, "it arrived broken", "negative"), (3, "not my taste", "negative"), (4, "fine", "neutral"),
        (5, "great but I want a refund", "positive"), (6, "an allergic reaction", "very_positive"), (7, "found glass in it", "neutral"),
        (8, "please clarify", "positive"), (9, "lovely", "very_positive")]
    got = {r["id"]: r for r in reviews.route_response(spark.createDataFrame(cases, "id int, review_text string, sentiment_category string")).collect()}
    assert [i for i, r in got.items() if r["needs_human_review"]] == [1, 2, 5, 6, 7, 8]
    assert all((r["chatbot_statement"] is None) == r["needs_human_review"] for r in got.values())
    assert [got[i]["override_reason"] for i in (5, 6, 7, 8)] == ["refund", "health", "contamination", "clarification"]


def test_errors_and_retries(spark):
    stored = spark.createDataFrame(
        [(1, "a", reviews.WAITING, None, 0, None), (2, "b", reviews.INCOMPLETE, "old", 2, None), (3, "c", reviews.PROCESSED, None, 0, None)],
        "id int, review_text string, status string, error_message string, retry_count int, last_retry_at timestamp_ntz")
    errors = spark.createDataFrame([(1, "e1", dt.datetime(2024, 1, 1)), (2, "e2", dt.datetime(2024, 1, 2))], "id int, error_message string, failed_at timestamp_ntz")
    marked = reviews.mark_error(stored, errors)
    assert rows(marked.select("id", "status", "error_message", "retry_count")) == [
        (1, reviews.INCOMPLETE, "e1", 1), (2, reviews.INCOMPLETE, "e2", 3), (3, reviews.PROCESSED, None, 0)]
    assert [r["id"] for r in reviews.retryable(marked).collect()] == [1]


def test_dead_letters_keep_the_raw_line(spark):
    lines = spark.createDataFrame([('{"id":',), (_line(1, "x"),), ('{"id": 5, "review_text": "x"}',)], "value string")
    assert rows(reviews.dead_letters(lines).select("id", "error_message", "status")) == [
        (5, "missing created_at", reviews.INCOMPLETE), (None, "malformed event", reviews.INCOMPLETE)]


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    schema = "arrival_time double, channel string, completed boolean, abandoned boolean, total_amount double, basket_size int"
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")

    def feed(name, minutes):
        spark.createDataFrame([(float(m), "online", True, False, 1.0, 1) for m in minutes], schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        reviews.record(windows.hourly_demand(stream), log, checkpoint).awaitTermination()
        found = reviews.current(spark, log, ["window_start", "channel"])
        return rows(found.select(F.hour("window_start"), "arrival_count"))

    feed("one", [5, 10, 600])
    assert run() == [(0, 2), (10, 1)]
    feed("two", [20, 610])  # 00:20 is far behind the watermark
    assert run() == [(0, 2), (10, 2)]


def test_the_window_store_counts_late_rows(spark, tmp_path):
    """One file per micro-batch, out of time order and days late: the answer is that of one batch over all rows."""
    import random

    rng = random.Random(4)
    visits = [(rng.random() * 6000, rng.choice(["online", "store"]), rng.random() < 0.6, rng.random() < 0.2, round(rng.random() * 90, 2), rng.randrange(5)) for _ in range(300)]
    schema = "arrival_time double, channel string, completed boolean, abandoned boolean, total_amount double, basket_size int"
    moves = [(rng.random() * 200, k, "s" + str(k % 3), k % 2, rng.choice(["SALE", "RECEIPT", "COUNT"]), rng.randrange(-9, 9), rng.randrange(-2, 9)) for k in range(300)]
    moves += [(48.0, 900 + k, "s0", 0, "SALE", -1, k) for k in range(5)]  # ties of time, apart by number
    fields = "event_time double, n int, sku string, location int, event_type string, quantity_change int, quantity_after int"
    for data, form, store, plain in (
        (visits, schema, windows.hourly_store(), windows.hourly_demand),
        (moves, fields, windows.daily_store(("n",)), lambda df: windows.daily_snapshot(df, ("n",))),
    ):
        folder, log, checkpoint = (str(tmp_path / f"{len(form)}-{x}") for x in ("in", "log", "cp"))
        for k in range(6):
            spark.createDataFrame(data[5 - k :: 6], form).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(folder)
        windows.record_windows(stream, store, log, checkpoint).awaitTermination()
        assert len(list(Path(log).glob("batch_id=*"))) == 6
        want = plain(spark.createDataFrame(data, form))
        got = windows.current_windows(spark, store, log).select(*want.columns)
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert rows(got) == rows(want)
        parts = spark.read.option("basePath", log).parquet(log).drop("batch_id")
        assert rows(store.finish(store.merge(store.merge(parts))).select(*want.columns)) == rows(want)  # merged parts are parts


def test_alerts(spark):
    events = spark.createDataFrame([("e1", "a", 0, 1.0, 0), ("e2", "a", 0, 2.0, 5), ("e3", "a", 0, 3.0, 50), ("e4", "z", 0, 1.0, 0)], "event_id string, sku string, location int, event_time double, quantity_after int")
    policy = spark.createDataFrame([("a", 0, 10, 100, "s")], "sku string, location_id int, reorder_point int, order_quantity int, supplier_id string")
    assert rows(windows.low_stock_alerts(events, policy).select("event_id", "alert")) == [("e1", "stockout_occurred"), ("e2", "low_stock_alert")]
