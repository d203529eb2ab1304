"""DuckDB twins of the feature sets, the forecast and the review stream."""

from __future__ import annotations

from tallyhouse.streaming.reviews import BAD_WORDS, DEFECT_WORDS, GOOD_WORDS, REPLIES, SENSITIVE_WORDS
from tallyhouse.twins.views import mean, total

DATASETS = {
    "P-01_conversion_dataset": "SELECT channel, arrival_hour, day_of_week, browsing_duration, basket_size, queue_wait_time, completed FROM customer_journeys WHERE basket_size > 0",
    "P-02_order_value_dataset": """SELECT channel, basket_size, arrival_hour, day_of_week, browsing_duration, queue_wait_time, total_amount FROM customer_journeys
        WHERE completed AND total_amount > 0""",
    "P-03_demand_dataset": "SELECT * FROM demand_set",
    "P-03_demand_dataset_online": "SELECT * FROM demand_set WHERE channel = 'online'",
    "P-04_fulfillment_dataset": "SELECT channel, order_hour, day_of_week, fulfillment_duration FROM order_metrics WHERE fulfillment_duration IS NOT NULL AND fulfillment_duration > 0",
    "P-05_stockout_dataset": """SELECT quantity_before, reorder_point, safety_stock, on_order_qty, event_hour, day_of_week, stockout_occurred FROM inventory_events
        WHERE event_type IN ('SALE', 'demand_consumed')""",
    "P-06_lead_time_dataset": """SELECT supplier_id, order_quantity, CAST(order_time / 24 AS INTEGER) % 7 AS day_of_week, expected_lead_time_days, actual_lead_time_days, on_time, short_shipped
        FROM supplier_deliveries WHERE actual_lead_time_days IS NOT NULL AND actual_lead_time_days > 0""",
    "P-07_inventory_demand_dataset": "SELECT sku, location, snapshot_day, daily_demand, daily_receipts, quantity_on_hand, stockout_hours, reorder_triggered FROM inventory_snapshots",
    "P-08_churn_dataset": """SELECT days_since_last_purchase, days_since_join, total_spend, purchase_count, avg_order_value, loyalty_points, unresponsive_count, value_tier, rfm_segment,
        churn_risk_score, churned FROM customer_snapshots""",
    "P-09_campaign_dataset": "SELECT campaign_type, value_tier, rfm_segment, unresponsive_count, days_since_last_engagement, opened, clicked, converted FROM campaign_interactions",
    "P-10_clv_dataset": "SELECT days_since_join, purchase_count, avg_order_value, loyalty_points, value_tier, rfm_segment, total_spend FROM customer_snapshots WHERE total_spend > 0",
    "P-11_dataset_stats": """SELECT 'scenarios' AS section, 'total' AS name, COUNT(*) AS value FROM simulation_scenarios
        UNION ALL SELECT 'scenarios', 'completed', COUNT(*) FILTER (WHERE status = 'completed') FROM simulation_scenarios
        UNION ALL SELECT 'journeys', 'total', COUNT(*) FROM customer_journeys UNION ALL SELECT 'journeys', 'completed', COUNT(*) FILTER (WHERE completed) FROM customer_journeys
        UNION ALL SELECT 'journeys', 'scenarios', COUNT(DISTINCT scenario_id) FROM customer_journeys
        UNION ALL SELECT 'orders', 'total', COUNT(*) FROM order_metrics UNION ALL SELECT 'hourly_demand', 'total', COUNT(*) FROM hourly_demand""",
}


def _fit_views(prefix: str, source: str, keys: str) -> dict[str, str]:
    """Trend, daily and weekly parts of the series of each key."""
    return {
        f"{prefix}_line": f"SELECT {keys}, COALESCE(regr_slope(y, t), 0) AS slope, COALESCE(regr_intercept(y, t), AVG(y)) AS intercept, MAX(t) AS last_t FROM {source} GROUP BY {keys}",
        f"{prefix}_rest": f"SELECT s.*, y - intercept - slope * t AS rest FROM {source} s JOIN {prefix}_line USING ({keys})",
        f"{prefix}_daily": f"SELECT {keys}, hour, AVG(rest) AS daily FROM {prefix}_rest GROUP BY {keys}, hour",
        f"{prefix}_rest2": f"SELECT r.*, rest - daily AS rest2 FROM {prefix}_rest r JOIN {prefix}_daily USING ({keys}, hour)",
        f"{prefix}_weekly": f"SELECT {keys}, day, AVG(rest2) AS weekly FROM {prefix}_rest2 GROUP BY {keys}, day",
        f"{prefix}_sigma": f"SELECT {keys}, SQRT(AVG((rest2 - weekly) * (rest2 - weekly))) AS sigma FROM {prefix}_rest2 JOIN {prefix}_weekly USING ({keys}, day) GROUP BY {keys}",
    }


WORDS = "regexp_split_to_array(lower(review_text), '[^a-z]+')"


def _listing(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


VIEWS = {
    "demand_set": f"""SELECT hour_of_day, day_of_week, channel, CAST(SUM(order_count) AS BIGINT) AS y, CAST(SUM(arrival_count) AS BIGINT) AS arrivals, {total('revenue')} AS revenue,
        TIMESTAMP '2024-01-01' + to_hours(day_of_week * 24 + hour_of_day) AS ds FROM hourly_demand GROUP BY ALL""",
    "series": """SELECT channel, CAST(day_of_week * 24 + hour_of_day AS INTEGER) AS t, hour_of_day AS hour, day_of_week AS day, CAST(SUM(y) AS DOUBLE) AS y FROM demand_set
        WHERE channel IN (SELECT channel FROM demand_set GROUP BY 1 HAVING COUNT(*) >= 24) GROUP BY ALL""",
    **_fit_views("fc", "series", "channel"),
    "series_all": "SELECT 0 AS one, CAST(day_of_week * 24 + hour_of_day AS INTEGER) AS t, hour_of_day AS hour, day_of_week AS day, CAST(SUM(y) AS DOUBLE) AS y FROM demand_set GROUP BY ALL",
    **_fit_views("fa", "series_all", "one"),
    "cuts": "SELECT channel, UNNEST(generate_series(24, MAX(t) + 1 - 12, 12)) AS cutoff FROM series GROUP BY channel",
    "cv_series": "SELECT s.*, cutoff FROM series s JOIN cuts USING (channel) WHERE t < cutoff",
    **_fit_views("cv", "cv_series", "channel, cutoff"),
    "review_words": f"SELECT *, {WORDS} AS w FROM customer_reviews",
    "review_hits": f"SELECT *, list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in GOOD_WORDS)})) AS good, list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in BAD_WORDS)})) AS bad FROM review_words",
    "classified": """SELECT *, CASE WHEN s <= -0.6 THEN 'very_negative' WHEN s < -0.1 THEN 'negative' WHEN s <= 0.1 THEN 'neutral' WHEN s < 0.6 THEN 'positive' ELSE 'very_positive' END AS cat
        FROM (SELECT *, COALESCE(CAST(len(good) - len(bad) AS DOUBLE) / NULLIF(len(good) + len(bad), 0), 0) AS s FROM review_hits)""",
    "subjects": "SELECT *, CASE " + " ".join(f"WHEN list_has_any(w, {_listing(t)}) THEN '{s}'" for s, t in SENSITIVE_WORDS.items()) + " END AS subject FROM classified",
    "auto_routed": f"""SELECT *, subject IS NOT NULL OR cat = 'very_negative' OR (cat = 'negative' AND list_has_any(w, {_listing(DEFECT_WORDS)})) AS person FROM subjects""",
    "labelled_routed": f"""SELECT *, subject IS NOT NULL OR sentiment_category = 'very_negative' OR (sentiment_category = 'negative' AND list_has_any(w, {_listing(DEFECT_WORDS)})) AS person
        FROM subjects WHERE sentiment_category IS NOT NULL""",
    "review_results": """SELECT id, cat, s, created_at, CASE WHEN person THEN 'Needing human review' ELSE 'processed for response' END AS new_status, person
        FROM auto_routed""",
}


# What holds for any fit: rows, classes and parts of the split, and which rows can be scored.
_JOURNEY = ("arrival_hour", "day_of_week", "browsing_duration", "basket_size", "queue_wait_time", "channel")
MODEL_ROWS = {
    "conversion": ("P-01_conversion_dataset", "completed", _JOURNEY, True),
    "order_value": ("P-02_order_value_dataset", "total_amount", _JOURNEY, False),
    "fulfillment": ("P-04_fulfillment_dataset", "fulfillment_duration", ("order_hour", "day_of_week", "channel"), False),
    "stockout": ("P-05_stockout_dataset", "stockout_occurred", ("quantity_before", "reorder_point", "safety_stock", "on_order_qty", "event_hour", "day_of_week"), True),
    "lead_time": ("P-06_lead_time_dataset", "actual_lead_time_days", ("order_quantity", "day_of_week", "expected_lead_time_days", "supplier_id"), False),
    "churn": ("P-08_churn_dataset", "churned", ("days_since_last_purchase", "days_since_join", "total_spend", "purchase_count", "avg_order_value", "loyalty_points",
        "unresponsive_count", "churn_risk_score", "value_tier"), True),
    "campaign": ("P-09_campaign_dataset", "clicked", ("unresponsive_count", "days_since_last_engagement", "campaign_type", "value_tier", "rfm_segment"), True),
    "clv": ("P-10_clv_dataset", "total_spend", ("days_since_join", "purchase_count", "avg_order_value", "loyalty_points", "value_tier"), False),
}
_QUALITY = {True: "accuracy precision recall f1 roc_auc", False: "mae rmse r2 mean_actual mean_predicted mape"}
_VALIDATED = {"order_value": "r2", "fulfillment": "r2", "lead_time": "mae", "clv": "mae"}


def _model_rows(name: str) -> str:
    source, label, features, _ = MODEL_ROWS[name]
    return f"SELECT *, CAST({label} AS DOUBLE) AS label, {' AND '.join(f'{c} IS NOT NULL' for c in features)} AS known FROM ({DATASETS[source]})"


def _scored(name: str) -> str:
    return f"SELECT label, known AS scored, TRUE AS consistent FROM ({_model_rows(name)})"


def _evaluated(name: str) -> str:
    """Figures of one model: its measures, the sizes of the parts (of each class a fifth, rounded, is for testing), the rows left out."""
    classes = MODEL_ROWS[name][3]
    score = _VALIDATED.get(name, "roc_auc")
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"""SELECT '{name}' AS model, metric, samples, TRUE AS in_range FROM (
        WITH rows AS ({_model_rows(name)}), strata AS (SELECT COUNT(*) AS n, {'label' if classes else '0'} AS stratum FROM rows WHERE known AND label IS NOT NULL GROUP BY 2)
        SELECT UNNEST([{listed(_QUALITY[classes].split())}]) AS metric, CAST(NULL AS BIGINT) AS samples
        UNION ALL SELECT 'train_samples', CAST(SUM(n - (n * 20 + 50) // 100) AS BIGINT) FROM strata
        UNION ALL SELECT 'test_samples', CAST(SUM((n * 20 + 50) // 100) AS BIGINT) FROM strata
        UNION ALL SELECT 'left_out', COUNT(*) FILTER (WHERE NOT known OR label IS NULL) FROM rows
        UNION ALL SELECT UNNEST([{listed((f'cv_{score}_mean', f'cv_{score}_std'))}]), NULL
            WHERE {'(SELECT SUM(n) FROM strata WHERE stratum = 1) > 10' if classes else 'TRUE'})"""


def _replies(category: str) -> str:
    return f"CASE {category} " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in REPLIES.items()) + " END"


FORECAST = "intercept + slope * t + COALESCE(daily, 0) + COALESCE(weekly, 0)"
FORM = "CASE WHEN id % 4 = 3 OR {0} IS NULL THEN {1} ELSE {0} END"

TWINS = {
    **DATASETS,
    "P-12_label_encode": """SELECT campaign_type, CAST(i AS INTEGER) AS campaign_type_index, COUNT(*) AS n FROM campaign_interactions
        JOIN (SELECT campaign_type, ROW_NUMBER() OVER (ORDER BY campaign_type) - 1 AS i FROM (SELECT DISTINCT campaign_type FROM campaign_interactions)) USING (campaign_type) GROUP BY ALL""",
    **{f"P-13_{name}_predictions": _scored(name) for name in ("conversion", "stockout", "churn", "campaign")},
    **{f"P-14_{name}_predictions": _scored(name) for name in ("clv", "order_value", "fulfillment", "lead_time")},
    "P-15_classifier_evaluation": _evaluated("conversion"),
    "P-15_regressor_evaluation": _evaluated("clv"),
    **{f"P-15_{name}_evaluation": _evaluated(name) for name in ("stockout", "churn", "campaign", "order_value", "fulfillment", "lead_time")},
    "P-16_feature_importance": "SELECT CAST(UNNEST(range(1, 6)) AS INTEGER) AS rank, TRUE AS in_range",
    "P-17_predict_binary": _scored("conversion"),
    "P-18_clv_segments": f"SELECT value_tier, COUNT(*) AS customers, COUNT(*) FILTER (WHERE known) AS placed FROM ({_model_rows('clv')}) GROUP BY 1",
    "P-19_sla_compliance": f"SELECT channel, COUNT(*) AS orders, COUNT(*) FILTER (WHERE known) AS judged FROM ({_model_rows('fulfillment')}) GROUP BY 1",
    "P-21_train_all": " UNION ALL ".join(f"SELECT model, 'trained' AS status, metric, samples, in_range FROM ({_evaluated(name)})" for name in MODEL_ROWS)
        + " UNION ALL SELECT 'demand_forecast', 'trained', 'mae_' || channel, NULL, TRUE FROM (SELECT DISTINCT channel FROM cuts)",
    "P-20_demand_forecast": f"""SELECT channel, TIMESTAMP '2024-01-01' + to_hours(t) AS ds, ROUND(intercept + slope * t, 6) AS trend, ROUND(COALESCE(daily, 0), 6) AS daily,
            ROUND(COALESCE(weekly, 0), 6) AS weekly, ROUND({FORECAST}, 6) AS yhat, ROUND({FORECAST} - sigma * 1.2816::DOUBLE, 6) AS yhat_lower, ROUND({FORECAST} + sigma * 1.2816::DOUBLE, 6) AS yhat_upper
        FROM (SELECT channel, slope, intercept, UNNEST(generate_series(last_t + 1, last_t + 24)) AS t FROM fc_line) p JOIN fc_sigma USING (channel)
        LEFT JOIN fc_daily d ON d.channel = p.channel AND d.hour = t % 24 LEFT JOIN fc_weekly k ON k.channel = p.channel AND k.day = (t // 24) % 7""",
    "P-20_demand_forecast_total": f"""SELECT TIMESTAMP '2024-01-01' + to_hours(t) AS ds, ROUND(intercept + slope * t, 6) AS trend, ROUND(COALESCE(daily, 0), 6) AS daily,
            ROUND(COALESCE(weekly, 0), 6) AS weekly, ROUND({FORECAST}, 6) AS yhat, ROUND({FORECAST} - sigma * 1.2816::DOUBLE, 6) AS yhat_lower, ROUND({FORECAST} + sigma * 1.2816::DOUBLE, 6) AS yhat_upper
        FROM (SELECT one, slope, intercept, UNNEST(generate_series(last_t + 1, last_t + 24)) AS t FROM fa_line) p JOIN fa_sigma USING (one)
        LEFT JOIN fa_daily d ON d.hour = t % 24 LEFT JOIN fa_weekly k ON k.day = (t // 24) % 7""",
    "P-20_demand_trend": """SELECT channel, CAST(UNNEST(generate_series(MAX(t) + 1, MAX(t) + 24)) AS BIGINT) AS t, TRUE AS adds_up, TRUE AS bounded, TRUE AS optimal
        FROM series GROUP BY channel""",
    "P-20_demand_forecast_cv": f"""SELECT channel, ROUND(AVG(ABS(e)), 6) AS mae, ROUND(SQRT(AVG(e * e)), 6) AS rmse, ROUND(AVG(ABS(e / NULLIF(y, 0))) * 100, 6) AS mape, COUNT(*) AS points
        FROM (SELECT s.channel, y, {FORECAST} - y AS e FROM series s JOIN cuts c ON c.channel = s.channel AND t >= c.cutoff AND t < c.cutoff + 12
            JOIN cv_line l ON l.channel = s.channel AND l.cutoff = c.cutoff
            LEFT JOIN cv_daily d ON d.channel = s.channel AND d.cutoff = c.cutoff AND d.hour = s.hour
            LEFT JOIN cv_weekly k ON k.channel = s.channel AND k.cutoff = c.cutoff AND k.day = s.day) GROUP BY channel""",
    "R-01_raw_review_stream": """SELECT id, review_text, 'To be processed' AS status, created_at FROM customer_reviews
        UNION ALL SELECT id + 10000000000, '  ', 'To be processed', created_at FROM customer_reviews WHERE id % 30 = 0""",
    "R-02_drop_empty": """SELECT id, CAST(LENGTH(review_text) AS INTEGER) AS n_chars FROM customer_reviews
        UNION ALL SELECT id, CAST(LENGTH(review_text) AS INTEGER) FROM customer_reviews WHERE id % 50 = 0""",
    "R-03_classify": """SELECT id, cat AS sentiment_category, s AS sentiment_score, ARRAY_TO_STRING(list_distinct(list_concat(good, bad))[1:5], '|') AS key_phrases,
        CAST(len(good) + len(bad) AS DOUBLE) / (len(good) + len(bad) + 1) AS confidence FROM classified""",
    "R-04_parse_classifier_json": f"""SELECT id, {FORM.format('sentiment_category', "'neutral'")} AS sentiment_category, {FORM.format('sentiment_score', '0')} AS sentiment_score,
        CASE WHEN id % 4 = 3 THEN '' ELSE status END AS key_phrases, CAST(CASE WHEN id % 4 = 3 THEN 0 ELSE 0.5 END AS DOUBLE) AS confidence FROM customer_reviews""",
    "R-05_route_response": f"""SELECT id, CASE WHEN person THEN 'Needing human review' ELSE 'processed for response' END AS status,
        CASE WHEN NOT person THEN {_replies('sentiment_category')} END AS chatbot_statement, person AS needs_human_review, subject AS override_reason FROM labelled_routed""",
    "R-06_publish_processed": f"""SELECT p.id, review_text, cat AS sentiment_category, s AS sentiment_score, new_status AS status, CASE WHEN NOT person THEN {_replies('cat')} END AS chatbot_statement,
            p.created_at, p.created_at AS processed_at, CAST(NULL AS VARCHAR) AS error_message, 0 AS retry_count, CAST(NULL AS TIMESTAMP) AS last_retry_at
        FROM review_results p JOIN customer_reviews r ON r.id = p.id""",
    "R-07_update_review_result": f"""SELECT r.id, CASE WHEN p.id IS NULL THEN sentiment_category ELSE cat END AS sentiment_category, CASE WHEN p.id IS NULL THEN sentiment_score ELSE s END AS sentiment_score,
            COALESCE(new_status, status) AS status, CASE WHEN p.id IS NULL THEN chatbot_statement WHEN NOT person THEN {_replies('cat')} END AS chatbot_statement, p.created_at AS processed_at
        FROM customer_reviews r LEFT JOIN review_results p ON p.id = r.id""",
    "R-08_mark_error": """SELECT id, CASE WHEN status = 'To be processed' THEN 'incomplete processing' ELSE status END AS status,
        CASE WHEN status = 'To be processed' THEN 'classifier timed out' END AS error_message, retry_count + CASE WHEN status = 'To be processed' THEN 1 ELSE 0 END AS retry_count,
        CASE WHEN status = 'To be processed' THEN created_at END AS last_retry_at FROM customer_reviews""",
    "R-08_dead_letters": """SELECT '{"id":' AS raw, 'incomplete processing' AS status, 'malformed event' AS error_message, 1 AS retry_count, COUNT(*) AS lines
        FROM customer_reviews WHERE id % 40 = 0 GROUP BY 1""",
    "R-09_retryable": "SELECT id, review_text, retry_count FROM customer_reviews WHERE status IN ('incomplete processing', 'To be processed') AND retry_count < 3",
    "R-10_exactly_once": "SELECT id, new_status AS status, cat AS sentiment_category, s AS sentiment_score, 0 AS retry_count FROM review_results",
    "R-11_streaming_hourly_demand": f"""SELECT TIMESTAMP '2024-01-01' + to_hours(h) AS window_start, channel, COUNT(*) AS arrival_count, COUNT(*) FILTER (WHERE completed) AS order_count,
            COALESCE({total('CASE WHEN completed THEN total_amount END')}, 0) AS revenue, COUNT(*) FILTER (WHERE abandoned) AS abandonment_count,
            COALESCE({mean('CASE WHEN completed AND basket_size > 0 THEN basket_size END')}, 0) AS avg_basket_size
        FROM (SELECT *, CAST(FLOOR(arrival_time / 60) AS INTEGER) AS h FROM customer_journeys) GROUP BY h, channel""",
    "R-12_streaming_daily_snapshot": """SELECT TIMESTAMP '1995-01-01' + to_days(snapshot_day) AS window_start, sku, location, CAST(daily_demand AS BIGINT) AS daily_demand,
        CAST(daily_receipts AS BIGINT) AS daily_receipts, CAST(stockout_hours AS BIGINT) AS stockout_hours, quantity_on_hand FROM inventory_snapshots""",
    "R-13_low_stock_alerts": """SELECT event_id, e.sku, location, event_time, quantity_after, p.reorder_point AS policy_point, order_quantity, supplier_id,
            CASE WHEN quantity_after <= 0 THEN 'stockout_occurred' ELSE 'low_stock_alert' END AS alert
        FROM inventory_log e JOIN replenishment_policy p ON p.sku = e.sku AND p.location_id = e.location WHERE quantity_after <= 0 OR quantity_after <= p.reorder_point""",
}
