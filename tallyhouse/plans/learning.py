"""Registered runs of the feature sets, the models and the review stream."""

from __future__ import annotations

from collections import defaultdict
from threading import Lock

from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.functions.exprs import count_rows
from tallyhouse.ml import features, forecast, models, trend
from tallyhouse.session import scratch_dir
from tallyhouse.sources.buckets import BucketTable
from tallyhouse.sources.derive import POSITION
from tallyhouse.sources.tables import RetailTables
from tallyhouse.streaming import reviews, windows

DATASETS = {
    "P-01_conversion_dataset": features.conversion,
    "P-02_order_value_dataset": features.order_value,
    "P-03_demand_dataset": features.demand,
    "P-03_demand_dataset_online": lambda t: features.demand(t, channel="online"),
    "P-04_fulfillment_dataset": features.fulfillment,
    "P-05_stockout_dataset": features.stockout,
    "P-06_lead_time_dataset": features.lead_time,
    "P-07_inventory_demand_dataset": features.inventory_demand,
    "P-08_churn_dataset": features.churn,
    "P-09_campaign_dataset": features.campaign,
    "P-10_clv_dataset": features.clv,
    "P-11_dataset_stats": features.dataset_stats,
}


def label_encode(t) -> DataFrame:
    rows = features.campaign(t).select("campaign_type")
    encoded = models.label_encode(rows, models.label_encoder(rows, "campaign_type"))
    return encoded.groupBy("campaign_type", "campaign_type_index").agg(count_rows().alias("n"))


class Trained:
    """Models fitted once per set of tables and shared by the queries that apply them; so are their reports."""

    def __init__(self) -> None:
        self._fitted: dict = {}
        self._reports: dict = {}
        self._locks: dict = defaultdict(Lock)

    def __call__(self, t, name: str) -> models.Trained:
        key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
        with self._locks[key]:
            if key not in self._fitted:
                spec = models.MODELS[name]
                self._fitted[key] = models.train(spec, spec.dataset(t))
            return self._fitted[key]

    def report(self, t, name: str) -> list[tuple[str, float | None]]:
        key, found = (t.spark.sparkContext.applicationId, t.sf_dir, name), self(t, name)
        with self._locks[(*key, "report")]:
            if key not in self._reports:
                self._reports[key] = models.report(found)
            return self._reports[key]


trained = Trained()


def _checked(spark, rows: list[tuple]) -> DataFrame:
    """Figures of a fit, as far as they hold for any fit: counts, and whether each measure is one that can be."""
    out = [(model, status, metric, int(value) if metric in models.COUNTS else None, models.in_range(metric, value)) for model, status, metric, value in rows]
    return spark.createDataFrame(out, "model string, status string, metric string, samples bigint, in_range boolean")


def evaluation(name: str):
    def run(t) -> DataFrame:
        return _checked(t.spark, [(name, "trained", metric, value) for metric, value in trained.report(t, name)]).drop("status")

    return run


def predictions(name: str, threshold: float = 0.5):
    """Per row its label, whether it has a prediction, and whether that is one: a class by the threshold, a value of 0 or more."""

    def run(t) -> DataFrame:
        found = trained(t, name)
        rows = models.predict(found.spec, found.model, models.prepare(found.spec, found.spec.dataset(t)), threshold)
        if found.spec.kind == "classifier":
            right = F.col("probability").between(0, 1) & (F.col("prediction") == (F.col("probability") >= threshold).cast("int"))
        else:
            right = F.col("prediction") >= 0
        none = F.col("prediction").isNull()
        return rows.select("label", (~none).alias("scored"), F.when(none, ~F.col("complete")).otherwise(right).alias("consistent"))

    return run


def importance(name: str):
    def run(t) -> DataFrame:
        found = trained(t, name)
        ranked = models.feature_importance(found.spec, found.model, t.spark)
        before = F.lag("importance", 1, 1.0).over(Window.orderBy("rank"))  # five rows
        return ranked.select("rank", F.col("importance").between(0, before).alias("in_range"))

    return run


def clv_segments(t) -> DataFrame:
    found = trained(t, "clv")
    rows = models.clv_segments(found.spec, found.model, models.prepare(found.spec, found.spec.dataset(t)))
    limits = {"low": (None, 100), "medium": (100, 500), "high": (500, 2000), "premium": (2000, None)}
    right = F.lit(False)
    for segment, (least, below) in limits.items():
        inside = F.col("segment") == segment
        inside = inside & (F.col("prediction") >= least) if least is not None else inside
        right = right | (inside & (F.col("prediction") < below) if below is not None else inside)
    return rows.groupBy("value_tier").agg(count_rows().alias("customers"), F.count_if(right).alias("placed"))


def sla_compliance(t, sla_minutes: float = 2880) -> DataFrame:
    found = trained(t, "fulfillment")
    rows = models.sla_compliance(found.spec, found.model, models.prepare(found.spec, found.spec.dataset(t)), sla_minutes)
    right = F.col("within_sla") == (F.col("prediction") <= sla_minutes)
    return rows.groupBy("channel").agg(count_rows().alias("orders"), F.count_if(right).alias("judged"))


def train_everything(t) -> DataFrame:
    """All nine artefacts, with the full ensembles and cross-validation; models that other queries have fitted are not fitted again."""
    found = models.train_all(t, scratch_dir(t.spark, "models"), trained=trained).collect()  # some ten figures per model
    return _checked(t.spark, found)


def demand_trend(t) -> DataFrame:
    """The next day of each channel by the bending trend, with what holds for any fit: parts add up, the interval holds the
    forecast, and no change of a coefficient lowers the error."""
    series = forecast.hourly_series(features.demand(t))
    ahead = trend.forecast(series, ["channel"])
    slopes = trend.optimality(series, ["channel"])
    whole = F.abs(F.col("trend") + F.col("daily") + F.col("weekly") - F.col("yhat")) <= 1e-9 * F.greatest(F.abs("yhat"), F.lit(1.0))
    return ahead.join(slopes, "channel").select(
        "channel", "t", whole.alias("adds_up"),
        (F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))).alias("bounded"), (F.col("slope") < 1e-8).alias("optimal"))


MODELS = {
    "P-12_label_encode": label_encode,
    "P-13_conversion_predictions": predictions("conversion"),
    "P-13_stockout_predictions": predictions("stockout"),
    "P-13_churn_predictions": predictions("churn"),
    "P-13_campaign_predictions": predictions("campaign"),
    "P-14_clv_predictions": predictions("clv"),
    "P-14_order_value_predictions": predictions("order_value"),
    "P-14_fulfillment_predictions": predictions("fulfillment"),
    "P-14_lead_time_predictions": predictions("lead_time"),
    "P-15_classifier_evaluation": evaluation("conversion"),
    "P-15_regressor_evaluation": evaluation("clv"),
    **{f"P-15_{name}_evaluation": evaluation(name) for name in ("stockout", "churn", "campaign", "order_value", "fulfillment", "lead_time")},
    "P-16_feature_importance": importance("conversion"),
    "P-17_predict_binary": predictions("conversion", 0.3),
    "P-18_clv_segments": clv_segments,
    "P-19_sla_compliance": sla_compliance,
    "P-20_demand_forecast": lambda t: forecast.forecast(features.demand(t)),
    "P-20_demand_forecast_total": lambda t: forecast.forecast(features.demand(t), keys=()),
    "P-20_demand_trend": demand_trend,
    "P-20_demand_forecast_cv": lambda t: forecast.cross_validation(features.demand(t)),
    "P-21_train_all": train_everything,
}


# --- streams ------------------------------------------------------------------------------------


def stream_table(t, name: str) -> DataFrame:
    """A stored table as a stream of its files. The pattern matches this one name: a stream takes a plain
    path only if it is a folder, a pattern may also be a single file."""
    path = t.path(name)
    return t.spark.readStream.schema(t[name].schema).parquet(f"{path[:-1]}[{path[-1]}]")


def review_lines(documents: DataFrame) -> DataFrame:
    """Review events of all documents as JSON lines, with the faults of a real feed added: some are sent
    twice, some come once more cut off in the middle, some once more without a text."""
    key = F.col("doc_id")
    at = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(windows.SIMULATION_START))) + key * 3600)

    def line(text, number=key):
        fields = F.struct(
            number.alias("id"), text.alias("review_text"), F.lit("To be processed").alias("status"),
            F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("created_at"))
        return F.to_json(fields)

    whole = line(F.col("text"))
    lines = F.array(
        whole,
        F.when(key % 40 == 0, F.substring(whole, 1, 6)),
        F.when(key % 50 == 0, whole),
        F.when(key % 30 == 0, line(F.lit("  "), key + 10_000_000_000)),
    )
    return documents.select(F.explode(lines).alias("value")).filter("value IS NOT NULL")


def _stream(t, build, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return the recorded rows."""
    log, checkpoint = scratch_dir(t.spark, "stream-log"), scratch_dir(t.spark, "stream-checkpoint")
    query = reviews.record(build, log, checkpoint)
    query.awaitTermination()
    rows = reviews.current(t.spark, log, key)
    return rows.select(*columns) if columns else rows


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def raw_stream(t) -> DataFrame:
    """The feed as files of JSON lines, read in four micro-batches; faulty lines and replays fall into any of them."""
    folder, files = scratch_dir(t.spark, "review-files"), max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    review_lines(t["documents"]).repartition(files).write.text(folder)
    parsed = reviews.parse_raw(reviews.raw_review_stream(t.spark, folder, -(-files // 4)))
    keyed = parsed.filter("error_message IS NULL").select("id", "review_text", "status", "created_at")
    return _plain_time(_stream(t, keyed, ["id"]), "created_at")


def drop_empty(t) -> DataFrame:
    parsed = reviews.parse_raw(review_lines(t["documents"])).filter("error_message IS NULL")
    return reviews.drop_empty(parsed).select("id", F.length("review_text").alias("n_chars"))


def _review_texts(t) -> DataFrame:
    return t["documents"].select(F.col("doc_id").alias("id"), F.col("text").alias("review_text"))


def classify(t) -> DataFrame:
    return reviews.classify(_review_texts(t)).select(
        "id", "sentiment_category", "sentiment_score", F.concat_ws("|", "key_phrases").alias("key_phrases"), "confidence")


def parse_replies(t) -> DataFrame:
    """Classifier replies in the shapes that occur: fenced, plain, fenced without a name, and no JSON."""
    body = F.to_json(F.struct(
        F.col("sentiment_category"), F.col("sentiment_score"), F.array(F.col("status")).alias("key_phrases"),
        F.lit(0.5).alias("confidence")))
    form = F.col("id") % 4
    reply = (
        F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 1, body)
        .when(form == 2, F.concat(F.lit("Here it is:\n```\n"), body, F.lit("\n``` done")))
        .otherwise(F.lit("I cannot tell."))
    )
    return t["customer_reviews"].select("id", reviews.parse_classifier_json(reply).alias("c")).select(
        "id", "c.sentiment_category", "c.sentiment_score", F.concat_ws("|", "c.key_phrases").alias("key_phrases"), "c.confidence")


def route(t) -> DataFrame:
    """Routing of the labelled reviews by their category and whole text."""
    rows = t["customer_reviews"].filter("sentiment_category IS NOT NULL").select("id", "review_text", "sentiment_category")
    return reviews.route_response(rows).select("id", "status", "chatbot_statement", "needs_human_review", "override_reason")


def _process(t) -> DataFrame:
    lines = review_lines(stream_table(t, "documents"))
    return reviews.process(lines, processed_at=F.col("created_at"))


def publish(t) -> DataFrame:
    path, checkpoint = scratch_dir(t.spark, "events"), scratch_dir(t.spark, "stream-checkpoint")
    reviews.publish(_process(t), path, checkpoint).awaitTermination()
    fields = ("id bigint, review_text string, sentiment_category string, sentiment_score double, status string, chatbot_statement string, "
              "created_at timestamp, processed_at timestamp, error_message string, retry_count int, last_retry_at timestamp")
    events = t.spark.read.text(path).select(F.from_json("value", fields).alias("e")).select("e.*")
    return _plain_time(events.dropDuplicates(["id"]), "created_at", "processed_at", "last_retry_at")


def update_results(t) -> DataFrame:
    log, checkpoint = scratch_dir(t.spark, "stream-log"), scratch_dir(t.spark, "stream-checkpoint")
    reviews.record(_process(t), log, checkpoint).awaitTermination()
    results = _plain_time(reviews.current(t.spark, log, ["id"]), "processed_at")
    stored = t["customer_reviews"].withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    known = stored.select("id", *reviews.RESULT_COLUMNS)
    table = BucketTable(scratch_dir(t.spark, "reviews"), known.schema, ("id",)).create(known)
    return reviews.update_stored(table, results).read(t.spark)


def dead_letters(t) -> DataFrame:
    return reviews.dead_letters(review_lines(t["documents"])).groupBy("raw", "status", "error_message", "retry_count").agg(
        count_rows().alias("lines"))


def mark_error(t) -> DataFrame:
    """Errors of this run: the reviews that were waiting could not be classified."""
    stored = t["customer_reviews"].select(
        "id", "status", "error_message", "retry_count", F.lit(None).cast("timestamp_ntz").alias("last_retry_at"))
    errors = t["customer_reviews"].filter(F.col("status") == reviews.WAITING).select(
        "id", F.lit("classifier timed out").alias("error_message"), F.col("created_at").alias("failed_at"))
    return reviews.mark_error(stored, errors)


def exactly_once(t) -> DataFrame:
    return _stream(t, _process(t), ["id"], ["id", "status", "sentiment_category", "sentiment_score", "retry_count"])


def hourly(t) -> DataFrame:
    live = RetailTables(t.spark, t.sf_dir, {"events": stream_table(t, "events")})
    return _plain_time(_windows(t, live["customer_journeys"], windows.hourly_store()), "window_start")


def _windows(t, stream: DataFrame, store: windows.WindowStore) -> DataFrame:
    """All windows of a stream, from the parts that its micro-batches left."""
    log, checkpoint = scratch_dir(t.spark, "stream-log"), scratch_dir(t.spark, "stream-checkpoint")
    windows.record_windows(stream, store, log, checkpoint).awaitTermination()
    return windows.current_windows(t.spark, store, log)


def _stored_events(t, batches: int | None = None) -> DataFrame:
    """Stock events as a stream: of the stored table where there is one. With ``batches``, in so many at most, of four files at least."""
    events = t["inventory_events_keyed"]
    if (path := t.stored.get("inventory_events_keyed")) is None:
        path = scratch_dir(t.spark, "inventory-events")
        events.write.parquet(path)
    reader = t.spark.readStream.schema(events.schema)
    if batches:
        reader = reader.option("maxFilesPerTrigger", max(4, -(-len(t.spark.read.parquet(path).inputFiles()) // batches)))
    return reader.parquet(path)


def daily(t) -> DataFrame:
    return _plain_time(_windows(t, _stored_events(t, 12), windows.daily_store((POSITION,))), "window_start")


def alerts(t) -> DataFrame:
    path, checkpoint = scratch_dir(t.spark, "alerts"), scratch_dir(t.spark, "stream-checkpoint")
    found = windows.low_stock_alerts(_stored_events(t), t["replenishment_policy"])
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(path)


STREAMS = {
    "R-01_raw_review_stream": raw_stream,
    "R-02_drop_empty": drop_empty,
    "R-03_classify": classify,
    "R-04_parse_classifier_json": parse_replies,
    "R-05_route_response": route,
    "R-06_publish_processed": publish,
    "R-07_update_review_result": update_results,
    "R-08_mark_error": mark_error,
    "R-08_dead_letters": dead_letters,
    "R-09_retryable": lambda t: reviews.retryable(t["customer_reviews"]),
    "R-10_exactly_once": exactly_once,
    "R-11_streaming_hourly_demand": hourly,
    "R-12_streaming_daily_snapshot": daily,
    "R-13_low_stock_alerts": alerts,
}

# The models take longest, so they come last.
LEARNING = {**DATASETS, **STREAMS, **MODELS}
