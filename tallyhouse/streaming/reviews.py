"""The review stream: parse, classify, route, publish and record customer reviews.

All steps are column expressions, so the same functions run on a stream and on a stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.operators import merge
from tallyhouse.sources.buckets import BucketTable

RAW_SCHEMA = "id bigint, review_text string, status string, created_at timestamp"
MAX_RETRIES = 3

PROCESSED, HUMAN, INCOMPLETE, WAITING = (
    "processed for response", "Needing human review", "incomplete processing", "To be processed")

# Words of the default classifier.
GOOD_WORDS = (
    "amazing delicious excellent fantastic favorite fresh good great happy love loved perfect recommend rich smooth tasty wonderful"
).split()
BAD_WORDS = (
    "awful bad bitter broken disappointed disgusting hate horrible melted moldy poor sick stale terrible waste worst wrong"
).split()

# Words that send a review to a person: a complaint about a defect, or one of the sensitive subjects.
DEFECT_WORDS = "broken crushed damaged defective expired leaking melted missing moldy stale torn wrong".split()
SENSITIVE_WORDS = {
    "refund": "refund refunded reimbursement".split(),
    "health": "allergic allergy hospital ill rash reaction sick vomiting".split(),
    "contamination": "bug contaminated contamination foreign glass hair insect metal plastic".split(),
    "clarification": "clarification clarify confused explain unclear".split(),
}

# Reply to a review by category; a very negative one gets none.
REPLIES = {
    "negative": "We are sorry that this fell short of what you expected and will do better.",
    "neutral": "Thank you for telling us what you think.",
    "positive": "Thank you, we are glad that you enjoyed it!",
    "very_positive": "Thank you so much, you made our day!",
}


def raw_review_stream(spark: SparkSession, path: str, files_per_batch: int = 20) -> DataFrame:
    """JSON lines from a folder, a few files per micro-batch. A Kafka source yields the same ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def kafka_review_stream(spark: SparkSession, servers: str, topic: str, per_batch: int = 10_000) -> DataFrame:
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("maxOffsetsPerTrigger", per_batch).load().select(F.col("value").cast("string").alias("value"))


def parse_raw(lines: DataFrame) -> DataFrame:
    """Fields of each line; ``error_message`` is set where a line is no review."""
    parsed = F.from_json("value", RAW_SCHEMA)
    rows = lines.select("value", parsed.alias("r")).select("value", "r.*")
    problem = F.when(F.col("id").isNull(), "malformed event").when(F.col("created_at").isNull(), "missing created_at")
    return rows.withColumn("error_message", problem)


def drop_empty(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.length(F.trim("review_text")) > 0)


def words(text: str = "review_text") -> Column:
    return F.split(F.lower(text), "[^a-z]+")


def category_of(score: Column) -> Column:
    return (
        F.when(score <= -0.6, "very_negative")
        .when(score < -0.1, "negative")
        .when(score <= 0.1, "neutral")
        .when(score < 0.6, "positive")
        .otherwise("very_positive")
    )


def classify(reviews: DataFrame, scorer: Callable | None = None) -> DataFrame:
    """Category, score, up to five key phrases and confidence of each review.

    ``scorer`` plugs in a model: it maps a pandas Series of texts to a Series of classifier replies (the
    JSON text that ``parse_classifier_json`` reads) and runs as an Arrow-batched pandas UDF. Without one,
    a word list scores the whole text: (good - bad) / (good + bad).
    """
    if scorer is not None:
        reply = F.pandas_udf(scorer, "string")(F.col("review_text"))
        return reviews.withColumn("__c", parse_classifier_json(reply)).select(*reviews.columns, "__c.*")
    rows = reviews.withColumn("__w", words())
    rows = rows.withColumn("__good", F.filter("__w", lambda w: w.isin(GOOD_WORDS)))
    rows = rows.withColumn("__bad", F.filter("__w", lambda w: w.isin(BAD_WORDS)))
    good, bad = F.size("__good"), F.size("__bad")
    score = F.coalesce(F.try_divide((good - bad).cast("double"), good + bad), F.lit(0.0))
    return rows.select(
        *reviews.columns,
        category_of(score).alias("sentiment_category"),
        score.alias("sentiment_score"),
        F.slice(F.array_distinct(F.concat("__good", "__bad")), 1, 5).alias("key_phrases"),
        F.try_divide((good + bad).cast("double"), good + bad + 1).alias("confidence"),
    )


CLASSIFIER_SCHEMA = "sentiment_category string, sentiment_score double, key_phrases array<string>, confidence double"


def parse_classifier_json(reply) -> Column:
    """Classifier reply with or without code fences as a struct; neutral 0.0 if it cannot be read."""
    text = F.col(reply) if isinstance(reply, str) else reply
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    body = F.trim(F.when(text.contains("```"), fenced).otherwise(text))
    parsed = F.from_json(body, CLASSIFIER_SCHEMA)
    return F.struct(
        F.coalesce(parsed["sentiment_category"], F.lit("neutral")).alias("sentiment_category"),
        F.coalesce(parsed["sentiment_score"], F.lit(0.0)).alias("sentiment_score"),
        F.coalesce(parsed["key_phrases"], F.array().cast("array<string>")).alias("key_phrases"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
    )


def _mentions(terms: list[str]) -> Column:
    return F.arrays_overlap("__w", F.array(*[F.lit(x) for x in terms]))


def route_response(reviews: DataFrame) -> DataFrame:
    """Status and reply. Sensitive subjects always go to a person, defects when the review is negative."""
    category = F.col("sentiment_category")
    rows = reviews.withColumn("__w", words())
    sensitive = F.coalesce(
        *[F.when(_mentions(terms), subject) for subject, terms in SENSITIVE_WORDS.items()], F.lit(None).cast("string"))
    person = (
        F.col("override_reason").isNotNull()
        | (category == "very_negative")
        | ((category == "negative") & _mentions(DEFECT_WORDS))
    )
    reply = reduce(lambda chosen, item: chosen.when(category == item[0], item[1]), list(REPLIES.items())[1:],
                   F.when(category == "negative", REPLIES["negative"]))
    rows = rows.withColumn("override_reason", sensitive).withColumn("needs_human_review", person)
    return rows.withColumn("status", F.when(F.col("needs_human_review"), HUMAN).otherwise(PROCESSED)).withColumn(
        "chatbot_statement", F.when(~F.col("needs_human_review"), reply)).drop("__w")


EVENT_COLUMNS = (
    "id review_text sentiment_category sentiment_score status chatbot_statement created_at processed_at error_message "
    "retry_count last_retry_at"
).split()


def process(lines: DataFrame, processed_at: Column | None = None, scorer: Callable | None = None) -> DataFrame:
    """Raw lines to processed reviews in the eleven published columns."""
    good = drop_empty(parse_raw(lines).filter("error_message IS NULL").drop("value", "status"))
    routed = route_response(classify(good, scorer))
    done = F.current_timestamp() if processed_at is None else processed_at
    return routed.select(
        "id", "review_text", "sentiment_category", "sentiment_score", "status", "chatbot_statement", "created_at",
        done.alias("processed_at"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("last_retry_at"))


def dead_letters(lines: DataFrame, at: Column | None = None) -> DataFrame:
    """Lines that are no review, marked for another try."""
    when = F.current_timestamp() if at is None else at
    failed = parse_raw(lines).filter("error_message IS NOT NULL")
    return failed.select(
        "id", F.col("value").alias("raw"), F.lit(INCOMPLETE).alias("status"), "error_message",
        F.lit(1).alias("retry_count"), when.alias("last_retry_at"))


def mark_error(reviews: DataFrame, errors: DataFrame) -> DataFrame:
    """Stored reviews with the errors of this run: (id, error_message, failed_at)."""
    last = merge.last_per_key(errors.select("id", F.col("error_message").alias("__e"), F.col("failed_at").alias("__at")), ["id"], ["__at", "__e"])
    failed = F.col("__e").isNotNull()
    joined = reviews.join(last, "id", "left")
    changed = {
        "status": F.when(failed, INCOMPLETE).otherwise(F.col("status")),
        "error_message": F.coalesce("__e", "error_message"),
        "retry_count": (F.col("retry_count") + failed.cast("int")).cast("int"),
        "last_retry_at": F.coalesce("__at", "last_retry_at"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in reviews.columns])


def retryable(reviews: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    waiting = F.col("status").isin(INCOMPLETE, WAITING) & (F.col("retry_count") < max_retries)
    return reviews.filter(waiting).select("id", "review_text", "retry_count").orderBy("id")


def once(processed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop replays of an id while the watermark keeps its state."""
    return processed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def published(processed: DataFrame) -> DataFrame:
    """One JSON event per processed review."""
    return processed.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(*EVENT_COLUMNS)).alias("value"))


def publish(processed: DataFrame, path: str, checkpoint: str):
    """Write the events as text files; a Kafka sink takes the same (key, value)."""
    events = published(processed).select("value")
    return events.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def record(processed: DataFrame, log: str, checkpoint: str):
    """Append each micro-batch to a log of results.

    A batch is written under its own number and a repeated batch overwrites itself, so the at-least-once
    calls of ``foreachBatch`` leave one copy. No batch rewrites the reviews recorded before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return processed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def current(spark: SparkSession, log: str, key: list[str]) -> DataFrame:
    """Latest recorded row per key."""
    rows = spark.read.option("basePath", log).parquet(log)
    return merge.last_per_key(rows, key, ["batch_id"]).drop("batch_id")


RESULT_COLUMNS = ["sentiment_category", "sentiment_score", "status", "chatbot_statement", "processed_at"]


def update_review_result(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Results over the stored reviews by id; unseen ids are added."""
    known = reviews.select("id", *RESULT_COLUMNS)
    return merge.upsert(known, results.select("id", *RESULT_COLUMNS), ["id"], RESULT_COLUMNS)


def update_stored(table: BucketTable, results: DataFrame) -> BucketTable:
    """The same in a stored table of reviews: only the hash buckets of the results' ids are read and written."""
    return table.upsert(results.select("id", *RESULT_COLUMNS), RESULT_COLUMNS)
