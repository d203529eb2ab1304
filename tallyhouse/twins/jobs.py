"""DuckDB twins of the fact builders, customer, sweep and table-maintenance queries."""

from __future__ import annotations

from tallyhouse.plans.grids import GRIDS, PARAMETER_SECTIONS, workflow_of
from tallyhouse.twins.views import MOVES, mean, pct, tier, total

N = "COUNT(*)"


def _done_mean(c: str, positive: bool = False) -> str:
    cond = f"completed AND {c} > 0" if positive else "completed"
    return f"COALESCE({mean(f'CASE WHEN {cond} THEN {c} END')}, 0)"


def _sample(sweep: str, n: int, seed: int) -> str:
    """Drawn scenarios by the same integer arithmetic: per parameter a start value, then four squarings modulo a prime."""
    grid = list(GRIDS[sweep].items())
    p = 2147483647
    source = "SELECT i, " + ", ".join(f"(i * 48271 + {seed * 69621 + k * 16807 + 40692}) % {p} AS x{k}" for k in range(len(grid))) + f" FROM range({n}) r(i)"
    for _ in range(4):
        source = "SELECT i, " + ", ".join(f"(x{k} * x{k} + i + {k + 1}) % {p} AS x{k}" for k in range(len(grid))) + f" FROM ({source})"
    chosen = ", ".join(f"'{name}', list_extract([{', '.join(f'{v}::DOUBLE' for v in values)}], x{k} % {len(values)} + 1)" for k, (name, values) in enumerate(grid))
    return f"""SELECT s.*, COALESCE(n, 0) AS visits FROM (SELECT '{sweep}_' || LPAD(CAST(i AS VARCHAR), 4, '0') AS scenario_id, '{workflow_of(sweep)}' AS workflow_type,
            CAST(i AS INTEGER) AS scenario_index, CAST(i + 42 AS INTEGER) AS random_seed, CAST(json_object('parameters', json_object({chosen})) AS VARCHAR) AS config_json FROM ({source})) s
        LEFT JOIN (SELECT scenario_id, COUNT(*) AS n FROM customer_journeys GROUP BY 1) j ON j.scenario_id = s.scenario_id"""


LOST = "SELECT COUNT(*) AS total_stockouts, COALESCE(CAST(SUM(requested - available) AS BIGINT), 0) AS lost_sales FROM unmet_demand"
DONE_F = "fulfillment_complete_time IS NOT NULL"
CHANNELS = ("online", "in_store", "bopis")

FACTS = {
    "F-01_time_features": """SELECT journey_id, arrival_time, CAST(FLOOR(arrival_time / 60) AS INTEGER) % 24 AS hour,
        CAST(FLOOR(arrival_time / 1440) AS INTEGER) % 7 AS day_of_week FROM customer_journeys""",
    "F-01_time_features_hours": """SELECT event_id, event_time, CAST(FLOOR(event_time) AS INTEGER) % 24 AS hour,
        CAST(FLOOR(event_time / 24) AS INTEGER) % 7 AS day_of_week FROM engagement_log""",
    "F-02_journeys": "SELECT * EXCLUDE (v) FROM customer_journeys",
    "F-03_order_metrics": "SELECT * FROM order_metrics",
    "F-04_inventory_events": "SELECT * FROM inventory_events",
    "F-05_hourly_demand": "SELECT * FROM hourly_demand",
    "F-06_inventory_snapshots": "SELECT * FROM inventory_snapshots",
    "F-07_supplier_deliveries": "SELECT * FROM supplier_deliveries",
    "F-08_reorder_triggers": """SELECT sku, location_id, quantity_on_hand AS current_stock, p.supplier_id, p.reorder_point, p.order_quantity, p.safety_stock,
        'low_stock_alert' AS alert FROM inventory i JOIN replenishment_policy p USING (sku, location_id) WHERE quantity_on_hand <= p.reorder_point""",
    "F-09_fifo_backorders": f"""SELECT event_id, sku, location_id, queued_at, quantity, needed, quantity_on_hand AS available, needed <= quantity_on_hand AS served
        FROM (SELECT *, CAST(SUM(quantity) OVER (PARTITION BY sku, location_id ORDER BY queued_at, {MOVES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS needed FROM unmet_demand)
        JOIN inventory USING (sku, location_id)""",
    "F-10_workflow_rollup": f"""SELECT * FROM (SELECT {N} AS total_customers, COUNT(*) FILTER (WHERE completed) AS completed_purchases,
            COUNT(*) FILTER (WHERE abandoned) AS abandoned_carts, COUNT(*) FILTER (WHERE payment_failed) AS payment_failures,
            {_done_mean('browsing_duration')} AS avg_browsing_time, {_done_mean('queue_wait_time', True)} AS avg_queue_wait_time,
            {_done_mean('checkout_time')} AS avg_checkout_time, COALESCE(MAX(queue_wait_time) FILTER (WHERE queue_wait_time > 0), 0) AS max_queue_wait_time,
            {_done_mean('basket_size', True)} AS avg_basket_size, COALESCE({total('CASE WHEN completed THEN total_amount END')}, 0) AS total_revenue,
            {_done_mean('total_amount')} AS avg_order_value, COALESCE({pct('completed')}, 0) AS conversion_rate,
            {', '.join(f"COUNT(*) FILTER (WHERE channel = '{c}') AS customers_{c}" for c in CHANNELS)} FROM customer_journeys),
        (SELECT {N} AS total_orders, COALESCE({mean(f'CASE WHEN {DONE_F} THEN fulfillment_duration END')}, 0) AS avg_fulfillment_time,
            COUNT(*) FILTER (WHERE {DONE_F} AND on_time) AS on_time_orders, COUNT(*) FILTER (WHERE {DONE_F} AND NOT on_time) AS late_orders,
            COALESCE(COUNT(*) FILTER (WHERE {DONE_F} AND on_time) * 1e2 / NULLIF(COUNT(*) FILTER (WHERE {DONE_F}), 0), 0) AS on_time_percentage,
            COUNT(*) FILTER (WHERE returned) AS total_returns, COALESCE({pct('returned')}, 0) AS return_rate,
            {', '.join(f"COUNT(*) FILTER (WHERE channel = '{c}') AS orders_{c}" for c in CHANNELS)} FROM order_metrics), ({LOST})""",
    "F-11_lost_sales": LOST,
    "F-12_supplier_performance": f"""SELECT s.supplier_id, name, COALESCE(n, 0) AS total_orders, COALESCE(r, 0) AS on_time_rate, COALESCE(l, mean_lead_time_days) AS avg_lead_time
        FROM suppliers s LEFT JOIN (SELECT supplier_id, {N} AS n, CAST(COUNT(*) FILTER (WHERE on_time) AS DOUBLE) / COUNT(*) AS r, {mean('actual_lead_time_days')} AS l
            FROM supplier_deliveries WHERE po_status = 'RECEIVED' GROUP BY 1) d ON d.supplier_id = s.supplier_id""",
    "F-13_apply_stock_deltas": """SELECT i.sku, i.location_id, CAST(quantity_on_hand + COALESCE(h, 0) AS INTEGER) AS quantity_on_hand,
            CAST(quantity_reserved + COALESCE(r, 0) AS INTEGER) AS quantity_reserved, CAST(on_order_qty + COALESCE(o, 0) AS INTEGER) AS on_order_qty, reorder_point
        FROM inventory i LEFT JOIN (SELECT sku, location, SUM(quantity_change) AS h, SUM(quantity_change) FILTER (WHERE event_type = 'SALE') AS r,
            -SUM(quantity_change) FILTER (WHERE event_type = 'RECEIPT') AS o FROM inventory_events GROUP BY 1, 2) d ON d.sku = i.sku AND d.location = i.location_id""",
    "F-14_counters": f"SELECT event_type AS metric, {total('value')} AS value FROM events GROUP BY 1",
    "F-15_active_cart_items": """SELECT cart_id, customer_id, sku, quantity, COALESCE(own, price) AS unit_price FROM (
            SELECT cart_id, customer_id, status, sku1 AS sku, qty1 AS quantity, price1 AS own FROM carts
            UNION ALL SELECT cart_id, customer_id, status, sku2, 1, NULL FROM carts) JOIN products USING (sku) WHERE status = 'active'""",
    "F-16_products_with_policy": """SELECT sku, name, location_id, supplier_id, COALESCE(NULLIF(reorder_point, 0), 50) AS reorder_point,
            COALESCE(NULLIF(order_quantity, 0), 100) AS order_quantity, COALESCE(NULLIF(safety_stock, 0), 20) AS safety_stock,
            COALESCE(NULLIF(lead_time_days, 0), 7) AS lead_time_days FROM products LEFT JOIN replenishment_policy USING (sku)""",
    "F-17_engagement_events": "SELECT * FROM engagement_events",
    "F-18_state_update": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, COALESCE(s, o_orderstatus) AS status, COALESCE(p, 'pending') AS payment_status, f AS fulfillment_status
        FROM orders LEFT JOIN (SELECT l_orderkey, MAX('processing') FILTER (WHERE l_linestatus = 'F') AS s, MAX('paid') FILTER (WHERE l_linestatus = 'F') AS p,
            ARG_MAX(CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'shipped' END, (l_shipdate, CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'shipped' END)) AS f
            FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
}

RECENCY = "COALESCE(recency_days, 999)"
CUSTOMERS = {
    "X-01_purchase_history_rfm": "SELECT * FROM rfm_stats",
    "X-02_top_customers": "SELECT customer_id, total_spend, purchase_count, loyalty_points FROM customer_snapshots ORDER BY total_spend DESC, customer_id LIMIT 5",
    "X-03_value_tier": f"SELECT customer_id, channel, {tier('total_spend', 600, 300, 100)} AS static_tier, {tier('total_spend', 5000, 2000, 500)} AS dynamic_tier FROM channel_customers",
    "X-04_activity_state": f"""SELECT customer_id, channel, CASE WHEN {RECENCY} < 30 THEN 'active' WHEN {RECENCY} < 180 THEN 'lapsed' ELSE 'churned' END AS activity_state
        FROM channel_customers""",
    "X-05_recommendations": """
        SELECT customer_id, MAX(sku) FILTER (WHERE r = 1) AS sku_rank_1, MAX(sku) FILTER (WHERE r = 2) AS sku_rank_2, MAX(sku) FILTER (WHERE r = 3) AS sku_rank_3
        FROM rec_ranked WHERE r <= 3 GROUP BY 1""",
    "X-06_rfm_segment": f"""SELECT customer_id, channel, CASE WHEN {RECENCY} <= 90 AND purchase_count >= 2 AND total_spend >= 200 THEN 'Champions'
        WHEN {RECENCY} <= 120 AND purchase_count >= 1 AND total_spend >= 100 THEN 'Loyal' WHEN {RECENCY} <= 180 OR total_spend >= 50 THEN 'Potential'
        WHEN {RECENCY} > 180 THEN 'At Risk' ELSE 'Needs Attention' END AS rfm_segment FROM channel_customers""",
    "X-07_loyalty_ledger": """SELECT *, CAST(SUM(points_change) OVER (PARTITION BY customer_id ORDER BY transaction_date, transaction_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
        FROM points_transactions""",
    "X-07_purchase_points": f"""SELECT customer_id, order_id, {total('line_total')} AS amount, MAX(purchase_date) AS transaction_date,
        CAST(FLOOR({total('line_total')}) AS INTEGER) AS points_change FROM customer_purchase_history GROUP BY 1, 2""",
    "X-08_churn_risk": f"""SELECT customer_id, channel, value_tier, GREATEST(0, LEAST(10, CASE WHEN COALESCE(recency_days, 365) > 180 THEN 4 WHEN COALESCE(recency_days, 365) > 90 THEN 2 ELSE 0 END
        + CASE WHEN unresponsive_count > 3 THEN 3 ELSE 0 END - CASE value_tier WHEN 'VIP' THEN 2 WHEN 'High' THEN 1 ELSE 0 END)) / 10::DOUBLE AS churn_risk_score
        FROM (SELECT *, {tier('total_spend', 600, 300, 100)} AS value_tier FROM channel_customers)""",
    "X-09_customer_snapshots": "SELECT * FROM customer_snapshots",
    "X-10_loyalty_account": f"""SELECT *, {tier('lifetime_points', 5000, 2000, 500)} AS tier FROM (SELECT customer_id, CAST(SUM(GREATEST(0, points_change)) AS BIGINT) AS current_points,
        CAST(SUM(GREATEST(0, points_change)) AS BIGINT) AS lifetime_points FROM points_transactions GROUP BY 1)""",
    "X-10_loyalty_account_net": f"""SELECT *, {tier('lifetime_points', 5000, 2000, 500)} AS tier FROM (SELECT customer_id, CAST(SUM(points_change) AS BIGINT) AS current_points,
        CAST(SUM(GREATEST(0, points_change)) AS BIGINT) AS lifetime_points FROM points_transactions GROUP BY 1)""",
    "X-11_engagement_summary": f"""
        SELECT 'state' AS section, activity_state AS name, CAST({N} AS DOUBLE) AS value FROM customer_snapshots GROUP BY 2
        UNION ALL SELECT 'segment', rfm_segment, {N} FROM customer_snapshots GROUP BY 2
        UNION ALL SELECT 'segment_pct', rfm_segment, {N} * 1e2 / (SELECT {N} FROM customer_snapshots) FROM customer_snapshots GROUP BY 2
        UNION ALL SELECT 'tier', value_tier, {N} FROM customer_snapshots GROUP BY 2
        UNION ALL SELECT 'campaign', 'sent', {N} FROM campaign_interactions UNION ALL SELECT 'campaign', 'opened', COUNT(*) FILTER (WHERE opened) FROM campaign_interactions
        UNION ALL SELECT 'campaign', 'clicked', COUNT(*) FILTER (WHERE clicked) FROM campaign_interactions
        UNION ALL SELECT 'campaign', 'open_rate', COALESCE({pct('opened')}, 0) FROM campaign_interactions
        UNION ALL SELECT 'campaign', 'click_rate', COALESCE({pct('clicked')}, 0) FROM campaign_interactions
        UNION ALL SELECT 'retention', 'churned', COUNT(*) FILTER (WHERE churned) FROM customer_snapshots
        UNION ALL SELECT 'retention', 'retention_rate', COALESCE({pct('NOT churned')}, 0) FROM customer_snapshots
        UNION ALL SELECT 'service', 'created', {N} FROM support_tickets UNION ALL SELECT 'service', 'resolved', COUNT(*) FILTER (WHERE status = 'resolved') FROM support_tickets
        UNION ALL SELECT 'service', 'satisfied', COUNT(*) FILTER (WHERE satisfaction_rating >= 4) FROM support_tickets
        UNION ALL SELECT 'service', 'satisfaction_rate', COALESCE(COUNT(*) FILTER (WHERE satisfaction_rating >= 4) * 1e2 / NULLIF(COUNT(*) FILTER (WHERE status = 'resolved'), 0), 0) FROM support_tickets""",
    "X-12_campaign_audience": """SELECT customer_id, rfm_segment, value_tier, unresponsive_count FROM customer_snapshots
        WHERE rfm_segment = 'Champions' AND customer_id IN (SELECT customer_id FROM customer_preferences WHERE marketing_opt_in)""",
    "X-13_campaign_interactions": """SELECT e.customer_id, campaign_id, campaign_type, send_time, events, opened, clicked, converted, days_since_last_engagement,
            value_tier, rfm_segment, unresponsive_count
        FROM (SELECT customer_id, campaign_id, campaign_type, MIN(event_time) AS send_time, COUNT(*) AS events, BOOL_OR(event_type IN ('view', 'click', 'purchase')) AS opened,
            BOOL_OR(event_type IN ('click', 'purchase')) AS clicked, BOOL_OR(event_type = 'purchase') AS converted,
            (MAX(event_time) - MAX(event_time) FILTER (WHERE event_type IN ('click', 'purchase'))) / 24 AS days_since_last_engagement
            FROM campaign_events GROUP BY 1, 2, 3) e JOIN customer_snapshots s ON s.customer_id = e.customer_id""",
    "X-14_customer_stats": "SELECT customer_id, total_spend, last_purchase_date, purchase_count, avg_order_value FROM customer_snapshots",
    "X-14_customer_scores": "SELECT customer_id, rfm_segment AS segment, value_tier, churn_risk_score, activity_state FROM customer_snapshots",
}

DETAILS = {
    "omnichannel": ("conversion", ("customer_journeys", "hourly_demand", "order_metrics")),
    "inventory": ("inventory_policy", ("inventory_events", "supplier_deliveries", "inventory_snapshots")),
    "engagement": ("engagement_loyalty", ("engagement_events", "customer_snapshots", "campaign_interactions")),
}
SWEEP_OF = "regexp_replace(scenario_id, '_[0-9]+$', '')"


def _counts(workflow: str) -> str:
    return " UNION ALL ".join(
        f"SELECT scenario_id, '{tbl}' AS tbl, COUNT(*) AS row_count FROM {tbl} WHERE scenario_id IS NOT NULL GROUP BY scenario_id" for tbl in DETAILS[workflow][1])


VARIETY = {
    "omnichannel": """SELECT scenario_id, COALESCE(channels, 0) AS channels, COALESCE(abandonment_reasons, 0) AS abandonment_reasons, COALESCE(hours_active, 0) AS hours_active,
            COALESCE(outcome_types, 0) AS outcome_types
        FROM (SELECT scenario_id, COUNT(DISTINCT channel) AS channels, COUNT(DISTINCT abandonment_reason) AS abandonment_reasons,
            COUNT(DISTINCT CASE WHEN completed THEN 'completed' WHEN abandoned AND payment_failed THEN 'payment_failed' WHEN abandoned THEN 'abandoned' ELSE 'in_progress' END) AS outcome_types
            FROM customer_journeys GROUP BY 1) FULL JOIN (SELECT scenario_id, COUNT(DISTINCT hour_of_day) AS hours_active FROM hourly_demand GROUP BY 1) USING (scenario_id)""",
    "inventory": """SELECT scenario_id, COALESCE(event_types, 0) AS event_types, COALESCE(sku_count, 0) AS sku_count, COALESCE(locations, 0) AS locations, COALESCE(suppliers, 0) AS suppliers
        FROM (SELECT scenario_id, COUNT(DISTINCT event_type) AS event_types, COUNT(DISTINCT sku) AS sku_count, COUNT(DISTINCT location) AS locations FROM inventory_events GROUP BY 1)
        FULL JOIN (SELECT scenario_id, COUNT(DISTINCT supplier_id) AS suppliers FROM supplier_deliveries GROUP BY 1) USING (scenario_id)""",
    "engagement": """SELECT scenario_id, COALESCE(event_types, 0) AS event_types, COALESCE(segments, 0) AS segments, COALESCE(value_tiers, 0) AS value_tiers, COALESCE(campaign_types, 0) AS campaign_types
        FROM (SELECT scenario_id, COUNT(DISTINCT event_type) AS event_types, COUNT(DISTINCT value_tier) AS value_tiers FROM engagement_events GROUP BY 1)
        FULL JOIN (SELECT scenario_id, COUNT(DISTINCT rfm_segment) AS segments FROM customer_snapshots GROUP BY 1) USING (scenario_id)
        FULL JOIN (SELECT scenario_id, COUNT(DISTINCT campaign_type) AS campaign_types FROM campaign_interactions GROUP BY 1) USING (scenario_id)""",
}
DIMENSIONS = {
    "omnichannel": ("channels", "abandonment_reasons", "hours_active", "outcome_types"),
    "inventory": ("event_types", "sku_count", "locations", "suppliers"),
    "engagement": ("event_types", "segments", "value_tiers", "campaign_types"),
}
SUMMARY = {
    "omnichannel": ("total_customers, total_orders, total_revenue, conversion_rate", "total_revenue"),
    "inventory": ("stockout_count, fill_rate, avg_lead_time", "fill_rate"),
    "engagement": ("total_customers, churn_rate, campaign_response_rate, avg_clv", "avg_clv"),
}


def _volume(workflow: str) -> str:
    sweep = DETAILS[workflow][0]
    return f"""SELECT scenario_id, CAST(SUM(row_count) AS BIGINT) AS total_rows, COUNT(*) AS tables_populated, config_json FROM ({_counts(workflow)}) JOIN simulation_scenarios USING (scenario_id)
        WHERE {SWEEP_OF} = '{sweep}' GROUP BY scenario_id, config_json ORDER BY total_rows DESC, scenario_id LIMIT 10"""


def _variety(workflow: str) -> str:
    names = DIMENSIONS[workflow]
    cols = ", ".join(f"COALESCE({n}, 0) AS {n}" for n in names)
    plus = " + ".join(f"COALESCE({n}, 0)" for n in names)
    return f"""SELECT s.scenario_id, {cols}, {plus} AS variety FROM simulation_scenarios s LEFT JOIN ({VARIETY[workflow]}) v ON v.scenario_id = s.scenario_id
        WHERE status = 'completed' AND sweep = '{DETAILS[workflow][0]}' ORDER BY variety DESC, s.scenario_id LIMIT 10"""


def _summary(workflow: str) -> str:
    columns, kpi = SUMMARY[workflow]
    return f"""SELECT scenario_id, {columns}, config_json FROM simulation_scenarios WHERE status = 'completed' AND sweep = '{DETAILS[workflow][0]}'
        ORDER BY {kpi} DESC NULLS LAST, scenario_id LIMIT 10"""


VIEWS = {
    "rec_numbered": """SELECT sku, category, ROW_NUMBER() OVER (PARTITION BY category ORDER BY sku) AS position, COUNT(*) OVER (PARTITION BY category) AS size,
        ROW_NUMBER() OVER (ORDER BY sku) AS overall, COUNT(*) OVER () AS everything FROM products""",
    "rec_starts": "SELECT customer_id, preferred_categories, customer_id * 7919 + 42 AS start FROM customer_preferences",
    "rec_picks": """SELECT l.customer_id, n.sku, 0 AS source, slot FROM (SELECT customer_id, start, UNNEST(preferred_categories) AS cat FROM rec_starts) l, range(3) AS r(slot), rec_numbered n
            WHERE n.category = l.cat AND slot < n.size AND n.position = (l.start + slot) % n.size + 1
        UNION ALL SELECT s.customer_id, n.sku, 1, slot FROM rec_starts s, range(6) AS r(slot), rec_numbered n
            WHERE slot < n.everything AND n.overall = (s.start + slot) % n.everything + 1""",
    "rec_ranked": """SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY at_slot, sku) AS r
        FROM (SELECT customer_id, sku, MIN(source * 100 + slot) AS at_slot FROM rec_picks GROUP BY 1, 2)""",
    "score_volume": "SELECT scenario_id, CAST(SUM(row_count) AS DOUBLE) AS volume FROM (" + " UNION ALL ".join(_counts(w) for w in DETAILS) + ") GROUP BY 1",
    "score_variety": " UNION ALL ".join(f"SELECT scenario_id, CAST({' + '.join(DIMENSIONS[w])} AS DOUBLE) AS variety FROM ({VARIETY[w]})" for w in DETAILS),
    "scored": """SELECT s.scenario_id, sweep, workflow_type, COALESCE(volume, 0) AS volume, COALESCE(variety, 0) AS variety,
            COALESCE(CASE workflow_type WHEN 'omnichannel' THEN total_revenue WHEN 'inventory' THEN fill_rate WHEN 'engagement' THEN avg_clv END, 0) AS kpi, config_json
        FROM simulation_scenarios s LEFT JOIN score_volume v ON v.scenario_id = s.scenario_id LEFT JOIN score_variety y ON y.scenario_id = s.scenario_id WHERE status = 'completed'""",
    "normalised": "SELECT *, " + ", ".join(
        f"CASE WHEN MAX({m}) OVER w = MIN({m}) OVER w THEN 1 ELSE ({m} - MIN({m}) OVER w) / (MAX({m}) OVER w - MIN({m}) OVER w) END AS {m}_norm" for m in ("volume", "variety", "kpi")
    ) + " FROM scored WINDOW w AS (PARTITION BY sweep)",
    "ranked": """SELECT *, ROW_NUMBER() OVER (PARTITION BY sweep ORDER BY composite DESC, scenario_id) AS rank
        FROM (SELECT *, ROUND(0.3::DOUBLE * volume_norm + 0.3::DOUBLE * variety_norm + 0.4::DOUBLE * kpi_norm, 8) AS composite FROM normalised)""",
    "top_params": """SELECT sweep, workflow_type, rank, parameter, CAST(json_extract_string(config_json, '$.parameters.' || parameter) AS DOUBLE) AS value
        FROM (SELECT *, UNNEST(json_keys(config_json, '$.parameters')) AS parameter FROM ranked WHERE rank <= 5) WHERE parameter NOT LIKE '\\_%' ESCAPE '\\'""",
    "recommended": """SELECT sweep, workflow_type, parameter, MIN(value) AS min, MAX(value) AS max, LIST_SORT(LIST(DISTINCT value)) AS values_seen,
        CASE WHEN MIN(value) = MAX(value) THEN 'fixed' ELSE 'range' END AS type FROM top_params GROUP BY 1, 2, 3""",
    "sections": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}')" for p, s in PARAMETER_SECTIONS.items()) + ") AS s(parameter, section)",
}

AVG = ", ".join(f"{mean(c)} AS {n}" for c, n in (
    ("total_customers", "avg_customers"), ("total_orders", "avg_orders"), ("total_revenue", "avg_revenue"), ("conversion_rate", "avg_conversion"),
    ("fill_rate", "avg_fill_rate"), ("churn_rate", "avg_churn_rate")))

SWEEPS = {
    "W-01_available_sweeps": f"""SELECT sweep, workflow_type, {N} AS n_scenarios, COUNT(*) FILTER (WHERE status = 'completed') AS n_completed, MIN(run_timestamp) AS first_run,
        MAX(run_timestamp) AS last_run FROM simulation_scenarios GROUP BY 1, 2""",
    **{f"W-02_volume_report_{w}": _volume(w) for w in DETAILS},
    **{f"W-03_per_table_breakdown_{w}": f"SELECT tbl, CAST(SUM(row_count) AS BIGINT) AS row_count FROM ({_counts(w)}) WHERE {SWEEP_OF} = '{d[0]}' GROUP BY 1" for w, d in DETAILS.items()},
    **{f"W-04_variety_report_{w}": _variety(w) for w in DETAILS},
    **{f"W-05_scenario_summary_{w}": _summary(w) for w in DETAILS},
    "W-06_scenario_scores": "SELECT * EXCLUDE (config_json) FROM scored",
    "W-07_min_max_normalise": "SELECT * EXCLUDE (config_json) FROM normalised",
    "W-08_composite_rank": "SELECT * EXCLUDE (config_json) FROM ranked",
    "W-09_recommend_params": "SELECT * FROM recommended",
    "W-10_by_section": "SELECT r.* EXCLUDE (values_seen), COALESCE(section, 'unknown') AS section FROM recommended r LEFT JOIN sections s ON s.parameter = r.parameter",
    "W-11_extract_overrides": """SELECT r.sweep, r.workflow_type, section, r.parameter, CASE WHEN type = 'fixed' THEN min ELSE COALESCE(p.value, (min + max) / 2) END AS value
        FROM recommended r JOIN sections s ON s.parameter = r.parameter LEFT JOIN top_params p ON p.rank = 1 AND p.sweep = r.sweep AND p.parameter = r.parameter""",
    "W-14_sweep_summary": f"""SELECT sweep, {N} AS total_scenarios, {', '.join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('completed', 'failed', 'running'))}, {AVG},
        MIN(conversion_rate) AS min_conversion, MAX(conversion_rate) AS max_conversion FROM simulation_scenarios GROUP BY 1""",
    "W-15_list_scenarios": "SELECT * EXCLUDE (sweep) FROM simulation_scenarios WHERE status = 'completed'",
    "W-15_get_scenario": "SELECT * EXCLUDE (sweep) FROM simulation_scenarios WHERE scenario_id = 'conversion_0003'",
    "W-16_scenario_grid": """SELECT g.*, COALESCE(n, 0) AS visits FROM grid_conversion g LEFT JOIN (SELECT scenario_id, COUNT(*) AS n FROM customer_journeys GROUP BY 1) j
        ON j.scenario_id = g.scenario_id""",
    "W-17_scenario_sample": _sample("conversion", 36, 42),
    "W-18_scenario_states": """SELECT g.scenario_id, COALESCE(s, 'created') AS status,
            CASE WHEN s = 'failed' THEN CAST(json_merge_patch(config_json, json_object('error', 'payment failed in ' || channel)) AS VARCHAR) ELSE config_json END AS config_json
        FROM grid_conversion g LEFT JOIN (SELECT *, CASE WHEN completed THEN 'completed' WHEN payment_failed THEN 'failed' ELSE 'running' END AS s FROM customer_journeys
            QUALIFY ROW_NUMBER() OVER (PARTITION BY scenario_id ORDER BY arrival_time DESC, journey_id DESC) = 1) j ON j.scenario_id = g.scenario_id""",
    "W-19_scenario_kpis": "SELECT * FROM scenario_kpis",
    "W-20_recommendations_report": """
        SELECT a.sweep, a.workflow_type, n AS n_scenarios_scored, b.scenario_id AS top_scenario, ROUND(b.composite, 4) AS top_composite_score,
            '{"recommendations":' || recs || ',"top_n_details":' || details || '}' AS report
        FROM (SELECT sweep, workflow_type, COUNT(*) AS n FROM ranked GROUP BY 1, 2) a JOIN ranked b ON b.sweep = a.sweep AND b.rank = 1
        JOIN (SELECT sweep, CAST(to_json(LIST({'parameter': r.parameter, 'section': COALESCE(section, 'unknown'), 'type': type, 'min': min, 'max': max, 'values_seen': values_seen}
                ORDER BY r.parameter)) AS VARCHAR) AS recs FROM recommended r LEFT JOIN sections s ON s.parameter = r.parameter GROUP BY 1) c ON c.sweep = a.sweep
        JOIN (SELECT sweep, '[' || STRING_AGG(doc, ',' ORDER BY rank) || ']' AS details FROM (SELECT sweep, rank, '{"rank":' || rank || ',"scenario_id":"' || scenario_id || '","composite":' || ROUND(composite, 4)
                || ',"volume":' || volume || ',"variety":' || variety || ',"kpi":' || ROUND(kpi, 2) || ',"params":' || json_extract(config_json, '$.parameters') || '}' AS doc FROM ranked WHERE rank <= 5) GROUP BY 1) d
            ON d.sweep = a.sweep""",
}

CUSTOMER_DOCS = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_mktsegment AS first_tag, c_acctbal AS balance FROM customer"""
KEYS = {
    "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}
MERGE_SOURCE = """SELECT o_orderkey, o_custkey, o_totalprice, l_linenumber AS first_line, l_partkey AS first_part FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _pair(left: dict[str, str], right: dict[str, str]) -> str:
    rows = []
    for name in {**left, **right}:
        a = f"(SELECT COUNT(*) FROM {left[name]})" if name in left else "0"
        b = f"(SELECT COUNT(*) FROM {right[name]})" if name in right else "0"
        rows.append(f"SELECT '{name}' AS table_name, CAST({a} AS BIGINT) AS left_rows, CAST({b} AS BIGINT) AS right_rows, {a} <> {b} AS differs")
    return " UNION ALL ".join(rows)


SPARK_TYPE = """CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
    ELSE lower(column_type) END"""
CART_TOTAL = "ROUND(qty1 * price1, 2)"
STORES = {
    "S-01_export_table": "SELECT * FROM inventory",
    "S-02_read_documents": CUSTOMER_DOCS,
    "S-03_export_documents": """SELECT '{"id":"' || sku || '","partition_key":"' || sku || '","sku":' || sku || ',"location_id":' || location_id || ',"quantity_on_hand":' || quantity_on_hand || '}' AS value FROM inventory""",
    "S-04_import_ndjson": CUSTOMER_DOCS,
    "S-05_load_relational": "SELECT * FROM payments",
    "S-06_merge_insert_new": f"""SELECT o_orderkey, o_custkey, o_totalprice, 0 AS first_line, CAST(NULL AS BIGINT) AS first_part FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT * FROM ({MERGE_SOURCE} WHERE o_orderstatus <> 'F' QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) = 1)""",
    "S-06_merge_counts": """SELECT (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS target_rows, COUNT(*) AS source_rows,
        COUNT(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS new_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "S-07_upsert": """SELECT COALESCE(i.sku, s.sku) AS sku, COALESCE(i.location_id, s.location) AS location_id,
            CASE WHEN s.sku IS NULL THEN i.quantity_on_hand ELSE s.quantity_on_hand END AS quantity_on_hand, quantity_reserved,
            CASE WHEN s.sku IS NULL THEN on_order_qty ELSE quantity_on_order END AS on_order_qty, reorder_point
        FROM inventory i FULL JOIN (SELECT * FROM inventory_snapshots QUALIFY ROW_NUMBER() OVER (PARTITION BY sku, location ORDER BY snapshot_day DESC) = 1) s
            ON s.sku = i.sku AND s.location = i.location_id""",
    "S-06_merge_stored": f"""SELECT o_orderkey, o_custkey, o_totalprice, 0 AS first_line, CAST(NULL AS BIGINT) AS first_part FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT * FROM ({MERGE_SOURCE} WHERE o_orderstatus <> 'F' QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) = 1)""",
    "S-08_nested_report": SWEEPS["W-20_recommendations_report"],
    "S-09_column_listing": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, column_name, {SPARK_TYPE} AS data_type, "null" = 'YES' AS nullable, null_count FROM (DESCRIBE {t})
            JOIN (UNPIVOT (SELECT COUNT(*) - COUNT(COLUMNS(*)) AS '\\0' FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE null_count) USING (column_name)""" for t in KEYS),
    "S-08_write_report": "SELECT channel, COUNT(*) AS total_journeys FROM customer_journeys GROUP BY 1",
    "S-09_validate_table": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS distinct_keys, COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys,
            CAST(COALESCE(SUM(n) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k)}), 0) AS BIGINT) AS null_keys FROM (SELECT {', '.join(k)}, COUNT(*) AS n FROM {t} GROUP BY ALL)"""
        for t, k in KEYS.items()),
    "S-10_compare_counts": _pair(
        {"journeys": "events", "orders": "orders", "reviews": "documents", "lines": "lineitem"},
        {"journeys": "customer_journeys", "orders": "order_metrics", "reviews": "customer_reviews", "deliveries": "supplier_deliveries"}),
    "S-11_document_query": """SELECT CAST(c_custkey AS VARCHAR) AS "customerId", c_name AS name, CAST(c_nationkey AS VARCHAR) AS address_nation, CAST(NULL AS VARCHAR) AS phone
        FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "S-12_partition_key": "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey AS VARCHAR) AS partition_key FROM customer",
    "S-13_sample_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "S-14_result_parity": f"SELECT channel, {mean('total_amount')} AS left_value, TRUE AS matches FROM customer_journeys WHERE completed GROUP BY 1",
    "S-15_decimal_to_double": "SELECT o_orderkey, o_totalprice AS price, o_totalprice AS inner_price FROM orders",
    "S-16_next_ids": """SELECT c_custkey, c_mktsegment, (SELECT GREATEST(MAX(o_orderkey), 10000) FROM orders) + ROW_NUMBER() OVER (ORDER BY c_custkey) AS new_id FROM customer""",
    "S-17_write_complete_order": f"SELECT cart_id AS order_id, customer_id, {CART_TOTAL} AS total_amount, 'pending' AS status FROM carts",
    "S-17_order_items": """SELECT cart_id AS order_id, 1 AS line, sku1 AS sku, qty1 AS quantity, price1 AS unit_price, ROUND(qty1 * price1, 4) AS subtotal FROM carts
        UNION ALL SELECT cart_id, 2, sku2, 1, NULL, 0 FROM carts""",
    "S-17_payments": f"SELECT cart_id AS order_id, {CART_TOTAL} AS amount, payment_method, 'authorized' AS status FROM carts",
}

TWINS = {**FACTS, **CUSTOMERS, **SWEEPS, **STORES}
