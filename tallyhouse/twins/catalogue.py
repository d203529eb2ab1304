"""DuckDB twins of the KPI catalogue, the drill-downs, the analyses and the further formulas."""

from __future__ import annotations

from tallyhouse.twins.views import mean, pct, total

POS, NEG = "sentiment_category IN ('positive', 'very_positive')", "sentiment_category IN ('negative', 'very_negative')"


def v(expr: str, table: str, where: str = "", name: str = "value") -> str:
    return f"SELECT CAST({expr} AS DOUBLE) AS {name} FROM {table}" + (f" WHERE {where}" if where else "")


def g(keys: str, table: str, where: str = "", **aggs: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in aggs.items())
    return f"SELECT {keys}, {cols} FROM {table}" + (f" WHERE {where}" if where else "") + " GROUP BY ALL"


N = "COUNT(*)"


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


J, S, O, H = "customer_journeys", "customer_snapshots", "order_metrics", "hourly_demand"
CI, PT, ST, LA = "campaign_interactions", "points_transactions", "support_tickets", "loyalty_account"
INV, IE, IS, SD, CR = "inventory", "inventory_events", "inventory_snapshots", "supplier_deliveries", "customer_reviews"
SHRINK = "COALESCE(SUM(ABS(quantity_change)) FILTER (WHERE event_type = 'SHRINKAGE'), 0)"
SOLD = "COALESCE(SUM(ABS(quantity_change)) FILTER (WHERE event_type = 'SALE'), 0)"
OUT = "COUNT(*) FILTER (WHERE stockout_occurred)"
SALES = "COUNT(*) FILTER (WHERE event_type = 'SALE')"

METRICS = {
    "M-01_revenue": v(total("total_amount"), J, "completed"),
    "M-02_customers": v("COUNT(DISTINCT customer_id)", S),
    "M-03_conversion": v(pct("completed"), J),
    "M-04_aov": v(mean("total_amount"), J, "completed"),
    "M-05_clv": v(mean("total_spend"), S, "total_spend > 0"),
    "M-06_return_rate": v(pct("returned"), O),
    "M-07_omni_arrival_rate": v("CAST(COUNT(*) AS DOUBLE) / NULLIF(MAX(arrival_time) - MIN(arrival_time), 0)", J),
    "M-08_omni_conversion": v(pct("completed"), J),
    "M-09_omni_cart_abandon": v(pct("abandoned"), J),
    "M-10_omni_avg_journey": v(mean("total_journey_time"), J),
    "M-11_omni_total_orders": v(N, O),
    "M-12_omni_ontime": v(pct("on_time"), O),
    "M-13_omni_fulfillment_dur": v(mean("fulfillment_duration"), O),
    "M-14_omni_payment_success": v(pct("NOT payment_failed"), J, "completed OR payment_failed"),
    "M-15_ce_active_rate": v(pct("activity_state = 'active'"), S),
    "M-16_ce_churn_rate": v(pct("churned"), S),
    "M-17_ce_open_rate": v(pct("opened"), CI),
    "M-18_ce_campaign_ctr": v(pct("clicked"), CI),
    "M-19_ce_enrollment_rate": v(
        "COUNT(DISTINCT la.customer_id) * 1e2 / NULLIF(COUNT(DISTINCT cs.customer_id), 0)",
        "customer_snapshots cs LEFT JOIN loyalty_account la ON cs.customer_id = la.customer_id"),
    "M-20_ce_redemption_rate": v(
        "CAST(SUM(CASE WHEN points_change < 0 THEN -points_change ELSE 0 END) AS BIGINT) * 1e2"
        " / NULLIF(CAST(SUM(CASE WHEN points_change > 0 THEN points_change ELSE 0 END) AS BIGINT), 0)", PT),
    "M-21_ce_resolution_rate": v(pct("status = 'resolved'"), ST),
    "M-22_ce_satisfaction": v(mean("satisfaction_rating"), ST, "satisfaction_rating IS NOT NULL"),
    "M-23_ir_qty_on_hand": v("SUM(quantity_on_hand)", INV),
    "M-24_ir_below_reorder": v(N, INV, "quantity_on_hand <= reorder_point"),
    "M-25_ir_stockout_count": v(N, IE, "stockout_occurred"),
    "M-26_ir_fill_rate": v(f"(1 - CAST({OUT} AS DOUBLE) / NULLIF(COUNT(*), 0)) * 1e2", IE),
    "M-27_ir_supplier_ontime": v(pct("on_time"), SD),
    "M-28_ir_avg_lead_time": v(mean("actual_lead_time_days"), SD),
    "M-29_ir_turnover": v(f"({mean('daily_demand')}) * 365 / NULLIF({mean('quantity_on_hand')}, 0)", IS),
    "M-30_ir_shrinkage_rate": v(f"CAST({SHRINK} AS BIGINT) * 1e2 / NULLIF(CAST({SOLD} + {SHRINK} AS BIGINT), 0)", IE),
    "M-31_cr_total_reviews": v(N, CR),
    "M-32_cr_positive_pct": v(pct(POS), CR),
    "M-33_cr_negative_pct": v(pct(NEG), CR),
    "M-34_cr_avg_score": v(mean("sentiment_score"), CR, "sentiment_score IS NOT NULL"),
    "M-35_cr_needs_review": v(N, CR, "status = 'Needing human review'"),
    "M-36_cr_processed_pct": v(pct("status = 'processed for response'"), CR),
    "M-37_arrival_rate_by_sim_hours": v("CAST(COUNT(*) AS DOUBLE) / NULLIF((SELECT MAX(hour_of_simulation) FROM hourly_demand), 0)", J),
    "M-38_payment_success_payments": v(pct("status = 'authorized'"), "payments"),
    "M-39_enrollment_accounts": v(
        "COUNT(DISTINCT customer_id) * 1e2 / NULLIF((SELECT COUNT(DISTINCT customer_id) FROM customer_snapshots), 0)", LA),
    "M-40_fill_rate_sales": v(f"(1 - CAST({OUT} AS DOUBLE) / NULLIF({SALES}, 0)) * 1e2", IE),
    "M-41_turnover_total": v(
        f"CASE WHEN {mean('quantity_on_hand')} > 0 THEN CAST(SUM(daily_demand) AS BIGINT) * 365::DOUBLE / ({mean('quantity_on_hand')}) ELSE 0 END", IS),
    "M-42_shrinkage_vs_stock": v(
        f"CAST({SHRINK} AS BIGINT) * 1e2 / NULLIF((SELECT CAST(SUM(quantity_on_hand) AS BIGINT) FROM inventory), 0)", IE),
    "M-43_response_rate": v(pct("chatbot_statement IS NOT NULL"), CR),
}

# metric key -> (tab, label, format) for the summaries.
TABS = {
    "main": {
        "M-01_revenue": ("Total Revenue", "currency"), "M-02_customers": ("Total Customers", "number"),
        "M-03_conversion": ("Conversion Rate", "percentage"), "M-04_aov": ("Average Order Value", "currency"),
        "M-05_clv": ("Customer Lifetime Value", "currency"), "M-06_return_rate": ("Return Rate", "percentage"),
    },
    "omnichannel": {
        "M-07_omni_arrival_rate": ("Arrival Rate", "number"), "M-08_omni_conversion": ("Conversion Rate", "percentage"),
        "M-09_omni_cart_abandon": ("Cart Abandonment Rate", "percentage"), "M-10_omni_avg_journey": ("Avg Journey Time", "number"),
        "M-11_omni_total_orders": ("Total Orders", "number"), "M-12_omni_ontime": ("On-Time Delivery %", "percentage"),
        "M-13_omni_fulfillment_dur": ("Avg Fulfillment Duration", "number"),
        "M-14_omni_payment_success": ("Payment Success Rate", "percentage"),
    },
    "customer-engagement": {
        "M-15_ce_active_rate": ("Active Customer Rate", "percentage"), "M-16_ce_churn_rate": ("Churn Rate", "percentage"),
        "M-17_ce_open_rate": ("Campaign Open Rate", "percentage"), "M-18_ce_campaign_ctr": ("Campaign CTR", "percentage"),
        "M-19_ce_enrollment_rate": ("Loyalty Enrollment Rate", "percentage"),
        "M-20_ce_redemption_rate": ("Points Redemption Rate", "percentage"),
        "M-21_ce_resolution_rate": ("Ticket Resolution Rate", "percentage"),
        "M-22_ce_satisfaction": ("Avg Satisfaction Rating", "number"),
    },
    "inventory-replenishment": {
        "M-23_ir_qty_on_hand": ("Total Qty on Hand", "number"), "M-24_ir_below_reorder": ("Items Below Reorder Point", "number"),
        "M-25_ir_stockout_count": ("Stockout Count", "number"), "M-26_ir_fill_rate": ("Fill Rate", "percentage"),
        "M-27_ir_supplier_ontime": ("Supplier On-Time %", "percentage"), "M-28_ir_avg_lead_time": ("Avg Lead Time", "number"),
        "M-29_ir_turnover": ("Inventory Turnover", "number"), "M-30_ir_shrinkage_rate": ("Shrinkage Rate", "percentage"),
    },
    "customer-reviews": {
        "M-31_cr_total_reviews": ("Total Reviews", "number"), "M-32_cr_positive_pct": ("Positive Review Rate", "percentage"),
        "M-33_cr_negative_pct": ("Negative Review Rate", "percentage"), "M-34_cr_avg_score": ("Average Sentiment Score", "number"),
        "M-35_cr_needs_review": ("Needs Human Review", "number"), "M-36_cr_processed_pct": ("Processed", "percentage"),
    },
}
SUMMARIES = {
    f"M-44_tab_summary_{tab.replace('-', '_')}": " UNION ALL ".join(
        f"SELECT '{key}' AS metric_id, '{label}' AS label, value, '{fmt}' AS format FROM ({METRICS[key]})"
        for key, (label, fmt) in rows.items())
    for tab, rows in TABS.items()
}
SUMMARIES["M-45_health_check"] = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, value FROM ({METRICS[key]})"
    for name, key in {
        "revenue": "M-01_revenue", "total_customers": "M-02_customers", "conversion_rate": "M-03_conversion",
        "total_orders": "M-11_omni_total_orders", "ontime_delivery": "M-12_omni_ontime",
        "avg_fulfillment": "M-13_omni_fulfillment_dur", "active_rate": "M-15_ce_active_rate",
        "churn_rate": "M-16_ce_churn_rate", "fill_rate": "M-40_fill_rate_sales",
        "stockout_count": "M-25_ir_stockout_count", "supplier_ontime": "M-27_ir_supplier_ontime"}.items())
SUMMARIES["M-46_trend"] = f"""
    SELECT metric_id, run, value, previous,
        COALESCE(CASE WHEN previous = 0 THEN 0 ELSE ABS((value - previous) * 1e2 / previous) END, 0) AS change_percent,
        CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'neutral' END AS trend
    FROM (SELECT *, LAG(value) OVER (PARTITION BY metric_id ORDER BY run) AS previous FROM (
        SELECT CAST(hour_of_simulation AS INTEGER) AS run, 'arrivals' AS metric_id, CAST(SUM(arrival_count) AS DOUBLE) AS value FROM hourly_demand GROUP BY 1
        UNION ALL SELECT CAST(hour_of_simulation AS INTEGER), 'orders', CAST(SUM(order_count) AS DOUBLE) FROM hourly_demand GROUP BY 1
        UNION ALL SELECT CAST(hour_of_simulation AS INTEGER), 'revenue', {total('revenue')} FROM hourly_demand GROUP BY 1))"""

LATE = "actual_lead_time_days - expected_lead_time_days"
DRILLS = {
    "D-01_order_volume": v(N, J, "completed"),
    "D-02_basket_size": v(mean("basket_size"), J, "completed"),
    "D-03_avg_unit_price": v(f"({total('total_amount')}) / NULLIF(CAST(SUM(basket_size) AS BIGINT), 0)", J, "completed"),
    "D-04_channel_mix": g("channel", J, "completed", revenue=total("total_amount"), orders=N),
    "D-05_active_customers": v(N, S, "activity_state = 'active'"),
    "D-06_lapsed_customers": v(N, S, "activity_state = 'lapsed'"),
    "D-07_churned_customers": v(N, S, "churned"),
    "D-08_by_value_tier": g("value_tier", S, count=N),
    "D-09_abandonment_by_reason": g("abandonment_reason", J, "abandoned", count=N),
    "D-10_payment_failure_rate": v(pct("payment_failed"), J),
    "D-11_queue_balk_rate": v(
        "COUNT(*) FILTER (WHERE abandonment_reason = 'queue_too_long') * 1e2 / NULLIF(COUNT(*) FILTER (WHERE channel = 'in_store'), 0)", J),
    "D-12_browsing_duration": v(mean("browsing_duration"), J),
    "D-13_unit_price_mean": v(mean("unit_price"), "order_items"),
    "D-14_product_mix": g("product_id", "order_items", revenue=total("subtotal"), units=isum("quantity")),
    "D-15_channel_aov": g("channel", J, "completed", avg_aov=mean("total_amount")),
    "D-16_purchase_frequency": v(mean("purchase_count"), S),
    "D-17_avg_order_value": v(mean("avg_order_value"), S),
    "D-18_tenure": v(mean("days_since_join"), S),
    "D-19_points": v(mean("loyalty_points"), S),
    "D-20_churn_risk": v(mean("churn_risk_score"), S),
    "D-21_returns_by_channel": g("channel", O, returns="COUNT(*) FILTER (WHERE returned)", total=N, return_rate=pct("returned")),
    "D-22_late_delivery_effect": g("on_time", O, return_rate=pct("returned")),
    "D-23_fulfillment_effect": g("returned", O, avg_fulfillment=mean("fulfillment_duration")),
    "D-24_hourly_arrivals": g("hour_of_simulation", H, avg_arrivals=mean("arrival_count")),
    "D-25_hourly_revenue": g("hour_of_simulation", H, avg_revenue=mean("revenue")),
    "D-26_hourly_orders": g("hour_of_simulation", H, avg_orders=mean("order_count")),
    "D-27_hourly_abandons": g("hour_of_simulation", H, avg_abandons=mean("abandonment_count")),
    "D-28_conversion_by_channel": g("channel", J, conversion_rate=pct("completed"), total=N),
    "D-29_price": v(N, J, "abandonment_reason = 'price'"),
    "D-30_queue": v(N, J, "abandonment_reason = 'queue_too_long'"),
    "D-31_browsing_fatigue": v(N, J, "abandonment_reason = 'browsing_fatigue'"),
    "D-32_queue_wait": v(mean("queue_wait_time"), J),
    "D-33_checkout_time": v(mean("checkout_time"), J),
    "D-34_orders_by_channel": g("channel", O, orders=N),
    "D-35_payment_methods": g("payment_method", "payments", count=N),
    "D-36_late_orders": v(N, O, "on_time = FALSE"),
    "D-37_fulfillment_by_channel": g("channel", O, avg_duration=mean("fulfillment_duration")),
    "D-38_success_by_method": g("payment_method", "payments", success_rate=pct("status = 'authorized'")),
    "D-39_gateway_failure_rate": v(pct("status <> 'authorized'"), "payments", name="failure_rate"),
    "D-40_lapsed_rate": v(pct("activity_state = 'lapsed'"), S),
    "D-41_retention_rate": v("(1 - CAST(COUNT(*) FILTER (WHERE churned) AS DOUBLE) / NULLIF(COUNT(*), 0)) * 1e2", S),
    "D-42_state_distribution": g("activity_state", S, count=N),
    "D-43_days_since_purchase": v(mean("days_since_last_purchase"), S),
    "D-44_unresponsive": v(mean("unresponsive_count"), S),
    "D-45_churn_by_tier": g("value_tier", S, churned="COUNT(*) FILTER (WHERE churned)", total=N),
    "D-46_open_by_type": g("campaign_type", CI, open_rate=pct("opened"), total=N),
    "D-47_ctr_by_type": g("campaign_type", CI, ctr=pct("clicked")),
    "D-48_click_to_open": v("COUNT(*) FILTER (WHERE clicked) * 1e2 / NULLIF(COUNT(*) FILTER (WHERE opened), 0)", CI),
    "D-49_campaign_conversion": v(pct("converted"), CI),
    "D-50_points_balance": v(mean("current_points"), LA),
    "D-51_tier_distribution": g("tier", LA, count=N),
    "D-52_lifetime_points": v("SUM(lifetime_points)", LA),
    "D-53_issued": v("SUM(points_change)", PT, "points_change > 0"),
    "D-54_redeemed": v("SUM(ABS(points_change))", PT, "points_change < 0"),
    "D-55_reasons": g("reason", PT, count=N),
    "D-56_open_tickets": v(N, ST, "status = 'open'"),
    "D-57_by_issue": g("issue_type", ST, count=N),
    "D-58_satisfaction_by_issue": g("issue_type", ST, avg_rating=mean("satisfaction_rating"), count=N),
    "D-59_total_tickets": v(N, ST),
    "D-60_qty_by_location": g("location_id", INV, qty=isum("quantity_on_hand")),
    "D-61_reserved": v("SUM(quantity_reserved)", INV),
    "D-61_on_order": v("SUM(on_order_qty)", INV),
    "D-61b_days_of_supply": v(mean("CASE WHEN daily_demand > 0 THEN CAST(quantity_on_hand AS DOUBLE) / daily_demand END"), IS),
    "D-62_demand_spikes": v(N, IS, f"daily_demand > 2 * (SELECT {mean('daily_demand')} FROM inventory_snapshots)"),
    "D-63_slow_deliveries": v(mean(LATE), SD, "actual_lead_time_days > expected_lead_time_days", "avg_delay"),
    "D-64_below_reorder_detail": "SELECT sku, location_id, quantity_on_hand, reorder_point FROM inventory WHERE quantity_on_hand <= reorder_point",
    "D-65_demand_rate": v(mean("daily_demand"), IS),
    "D-66_shrinkage_events": f"SELECT {N} AS total_events, {isum('ABS(quantity_change)')} AS total_units FROM inventory_events WHERE event_type = 'SHRINKAGE'",
    "D-67_supplier_reliability": f"SELECT {pct('on_time')} AS on_time_pct, {pct('short_shipped')} AS short_ship_pct FROM supplier_deliveries",
    "D-68_stockout_rate": v(f"{OUT} * 1e2 / NULLIF({SALES}, 0)", IE),
    "D-69_stockout_by_sku": g("sku", IE, "stockout_occurred", stockouts=N),
    "D-70_lead_time_stddev": v("ROUND(STDDEV(actual_lead_time_days), 6)", SD),
    "D-71_lead_time_accuracy": v(mean(LATE), SD),
    "D-72_short_ship_rate": v(pct("short_shipped"), SD),
    "D-73_lead_time_by_supplier": g("supplier_id", SD, avg_lead_time=mean("actual_lead_time_days"), deliveries=N),
    "D-74_qty_leadtime_corr": v("ROUND(CORR(order_quantity, actual_lead_time_days), 8)", SD, name="correlation"),
    "D-75_received_vs_ordered": v(f"{isum('received_quantity')} * 1e2 / NULLIF({isum('order_quantity')}, 0)", SD, name="fill_rate"),
    "D-76_reorder_trigger_rate": v(pct("reorder_triggered"), IS),
    "D-77_demand_trend": g("snapshot_day", IS, total_demand=isum("daily_demand")),
    "D-78_shrinkage_by_sku": g("sku", IE, "event_type = 'SHRINKAGE'", shrinkage_units=isum("ABS(quantity_change)")),
    "D-79_sentiment_distribution": g("sentiment_category", CR, count=N, avg_score=mean("sentiment_score")),
    "D-80_lowest_scored": "SELECT id, review_text, sentiment_score, sentiment_category FROM customer_reviews WHERE sentiment_score IS NOT NULL ORDER BY sentiment_score, id LIMIT 5",
    "D-81_reviews_by_status": g("status", CR, count=N),
    "D-82_by_sentiment": g("sentiment_category", CR, count=N),
    "D-83_positive_detail": f"SELECT id, review_text, sentiment_score FROM customer_reviews WHERE {POS} ORDER BY sentiment_score DESC, id LIMIT 5",
    "D-84_negative_detail": f"SELECT id, review_text, sentiment_score FROM customer_reviews WHERE {NEG} ORDER BY sentiment_score, id LIMIT 5",
    "D-85_unresolved_negative": f"SELECT id, review_text, sentiment_score, status FROM customer_reviews WHERE {NEG} AND chatbot_statement IS NULL",
    "D-86_pending_reviews": "SELECT id, review_text, status, error_message FROM customer_reviews WHERE chatbot_statement IS NULL",
    "D-87_response_by_status": g("status", CR, count=N, responded="COUNT(chatbot_statement)"),
}

DONE_AMOUNT = "CASE WHEN completed THEN total_amount END"
CHANNELS = g("channel", J, conversion_rate=pct("completed"), avg_order_value=mean(DONE_AMOUNT), total_journeys=N,
             completed_orders="COUNT(*) FILTER (WHERE completed)", avg_journey_time=mean("total_journey_time"),
             abandonment_rate=pct("abandoned"), total_revenue=f"COALESCE({total(DONE_AMOUNT)}, 0)")
ORDERS = g("channel", O, avg_fulfillment=mean("fulfillment_duration"), ontime_rate=pct("on_time"), return_rate=pct("returned"))
STATES = g("activity_state", S, customers=N, avg_spend=mean("total_spend"), avg_churn_risk=mean("churn_risk_score"), avg_purchases=mean("purchase_count"))


def _long(sql: str, scope: str, key: str, names: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, {key} AS group_name, '{n}' AS measure, CAST({n} AS DOUBLE) AS value FROM ({sql})" for n in names.split())


TREND_COLUMNS = "hour_of_simulation, hour_of_day, day_of_week, channel, arrival_count, order_count, abandonment_count, revenue, avg_basket_size, id"
LISTING = "SELECT id, review_text, sentiment_category, sentiment_score, status, chatbot_statement, created_at FROM customer_reviews WHERE {} ORDER BY id DESC LIMIT 200"

ANALYSES = {
    "A-01_channel_comparison": g(
        "channel", J, total_journeys=N, completed_orders="COUNT(*) FILTER (WHERE completed)", conversion_rate=pct("completed"),
        avg_order_value=mean(DONE_AMOUNT), avg_journey_time=mean("total_journey_time"), abandonment_rate=pct("abandoned")),
    "A-02_segment_analysis": g(
        "value_tier, activity_state", S, customers=N, avg_spend=mean("total_spend"), avg_purchases=mean("purchase_count"),
        avg_churn_risk=mean("churn_risk_score"), avg_loyalty_points=mean("loyalty_points")),
    "A-03_sku_status_summary": g(
        "CASE WHEN quantity_on_hand <= reorder_point THEN 'below_reorder' ELSE 'above_reorder' END AS status", INV, sku_count=N,
        avg_qty_on_hand=f"ROUND({mean('quantity_on_hand')}, 1)", avg_qty_reserved=f"ROUND({mean('quantity_reserved')}, 1)",
        avg_on_order=f"ROUND({mean('on_order_qty')}, 1)", zero_stock_count="COUNT(*) FILTER (WHERE quantity_on_hand = 0)"),
    "A-04_critical_skus": """SELECT sku, location_id, quantity_on_hand, quantity_reserved, on_order_qty, reorder_point,
        quantity_on_hand <= reorder_point AS below_reorder FROM inventory ORDER BY quantity_on_hand - reorder_point, sku, location_id LIMIT 20""",
    "A-05_review_analysis": g(
        "sentiment_category", CR, review_count=N, avg_score=mean("sentiment_score"), responded="COUNT(chatbot_statement)",
        pending_response="COUNT(*) FILTER (WHERE chatbot_statement IS NULL)"),
    "A-06_channel_breakdown": CHANNELS,
    "A-07_order_kpis_by_channel": ORDERS,
    "A-08_customer_kpis_by_state": STATES,
    "A-09_correlation_bundle": " UNION ALL ".join([
        _long(CHANNELS, "channel", "channel", "conversion_rate avg_order_value total_journeys completed_orders avg_journey_time abandonment_rate total_revenue"),
        _long(ORDERS, "channel", "channel", "avg_fulfillment ontime_rate return_rate"),
        _long(STATES, "activity_state", "activity_state", "customers avg_spend avg_churn_risk avg_purchases")]),
    "A-10_hourly_trend": f"SELECT {TREND_COLUMNS} FROM hourly_demand ORDER BY hour_of_simulation DESC, channel, id LIMIT 24",
    "A-10_hourly_trend_online": f"SELECT {TREND_COLUMNS} FROM hourly_demand WHERE channel = 'online' ORDER BY hour_of_simulation DESC, channel, id LIMIT 5000",
    "A-11_demand_by_hour_of_day": g(
        "hour_of_day", H, avg_arrivals=mean("arrival_count"), avg_orders=mean("order_count"),
        avg_abandonments=mean("abandonment_count"), avg_revenue=mean("revenue"), data_points=N),
    "T-01_review_listing": LISTING.format("TRUE"),
    "T-01_review_listing_positive": LISTING.format(POS),
    "T-01_review_listing_negative": LISTING.format(NEG),
    "T-01_review_listing_needs_review": LISTING.format("status = 'Needing human review'"),
}

HOURS = "date_diff('second', created_at, resolved_at) / 3600.0::DOUBLE"
TENURE = "GREATEST(days_since_join, 1)"
STATE = "CASE WHEN date_diff('day', before, day) < 30 THEN 'active' WHEN date_diff('day', before, day) < 180 THEN 'lapsed' ELSE 'churned' END"
FORMULAS = {
    "G-01_category_mix": g("category", "order_items JOIN products USING (product_id)", revenue=total("subtotal")),
    "G-02_returns_by_dow": g("day_of_week", O, returns="COUNT(*) FILTER (WHERE returned)", total=N, return_rate=pct("returned")),
    "G-03_orders_by_hour": g("order_hour", O, orders=N),
    "G-04_state_transitions": f"""
        SELECT from_state, state AS to_state, COUNT(*) AS transitions FROM (
            SELECT *, LAG(state) OVER (PARTITION BY customer_id ORDER BY day) AS from_state FROM (
                SELECT *, {STATE} AS state FROM (
                    SELECT *, LAG(day) OVER (PARTITION BY customer_id ORDER BY day) AS before FROM (
                        SELECT DISTINCT customer_id, CAST(purchase_date AS DATE) AS day FROM customer_purchase_history))
                WHERE before IS NOT NULL))
        WHERE from_state IS NOT NULL GROUP BY 1, 2""",
    "G-05_spend_stagnation": v(
        pct(f"total_spend / {TENURE} < (SELECT MEDIAN(total_spend / {TENURE}) FROM customer_snapshots)"), S),
    "G-06_service_issues": v(N, ST, "status <> 'resolved' OR satisfaction_rating <= 3"),
    "G-07_open_by_segment": g("value_tier, rfm_segment", CI, open_rate=pct("opened"), sends=N),
    "G-08_fatigue_trend": g("CAST(FLOOR(send_time / 24) AS INTEGER) AS day", CI, avg_unresponsive=mean("unresponsive_count")),
    "G-09_resolution_time": v(mean(HOURS), ST, name="avg_hours"),
    "G-10_satisfaction_by_speed": g(
        f"CASE WHEN {HOURS} < 12 THEN 'under_12h' WHEN {HOURS} < 24 THEN '12h_to_24h' WHEN {HOURS} < 48 THEN '24h_to_48h' ELSE 'over_48h' END AS speed",
        ST, "resolved_at IS NOT NULL", avg_rating=mean("satisfaction_rating"), tickets=N),
    "G-11_spike_skus": f"""SELECT sku, COUNT(*) AS spike_days, MAX(daily_demand) AS peak_demand FROM inventory_snapshots
        JOIN (SELECT sku, {mean('daily_demand')} AS m FROM inventory_snapshots GROUP BY sku) USING (sku) WHERE daily_demand > 2 * m GROUP BY sku""",
    "G-12_safety_coverage": v(
        mean("CAST(p.safety_stock AS DOUBLE) / NULLIF(daily_demand, 0)"),
        "inventory_snapshots s JOIN replenishment_policy p ON p.sku = s.sku AND p.location_id = s.location"),
    "G-13_reorder_adequacy": f"""SELECT COUNT(*) AS policies, COUNT(*) FILTER (WHERE reorder_point >= need) AS adequate, {pct('reorder_point >= need')} AS adequate_pct
        FROM (SELECT reorder_point, d * lead_time_days AS need FROM replenishment_policy p
              JOIN (SELECT sku, location, {mean('daily_demand')} AS d FROM inventory_snapshots GROUP BY 1, 2) s ON p.sku = s.sku AND p.location_id = s.location)""",
    "G-14_stockout_hours": v("SUM(stockout_hours)", IS),
    "G-15_po_count": v(N, "purchase_orders"),
    "G-16_po_status": g("po_status", "purchase_orders", orders=N),
    "G-17_avg_order_qty": v(mean("order_quantity"), "purchase_orders"),
    "G-18_shrinkage_by_type": g("sku, location", IE, "event_type = 'SHRINKAGE'", shrinkage_units=isum("ABS(quantity_change)")),
    "G-19_shrinkage_impact": v(
        f"CAST({SHRINK} AS BIGINT) * 1e2 / NULLIF((SELECT CAST(SUM(quantity_on_hand) AS BIGINT) FROM inventory), 0) / 1e2", IE),
    "G-20_daily_review_rate": v(
        "CAST(COUNT(*) AS DOUBLE) / (date_diff('day', CAST(MIN(created_at) AS DATE), CAST(MAX(created_at) AS DATE)) + 1)", CR),
    "G-21_with_text": v("COUNT(review_text)", CR),
    "G-22_category_counts": "SELECT " + ", ".join(
        f"COUNT(*) FILTER (WHERE sentiment_category = '{c}') AS {c}" for c in ("very_positive", "positive", "negative", "very_negative")) + " FROM customer_reviews",
    "G-23_score_histogram": g(
        "CAST(CASE WHEN sentiment_score < -1 THEN 0 WHEN sentiment_score >= 1 THEN 11 ELSE FLOOR((sentiment_score + 1) / 2 * 10) + 1 END AS INTEGER) AS bucket",
        CR, "sentiment_score IS NOT NULL", reviews=N),
    "G-24_score_stddev": v("ROUND(STDDEV(sentiment_score), 6)", CR),
    "G-25_ambiguous_reviews": v(N, CR, "status = 'Needing human review' AND sentiment_category = 'neutral'"),
    "G-26_auto_vs_manual": "SELECT COUNT(chatbot_statement) AS automatic, COUNT(*) FILTER (WHERE chatbot_statement IS NULL) AS manual FROM customer_reviews WHERE status <> 'To be processed'",
    "G-27_rfm_distribution": g("rfm_segment", S, customers=N),
    "G-27_spend_by_tier": g("value_tier", S, avg_spend=mean("total_spend")),
    "G-27_purchases_by_segment": g("rfm_segment", S, avg_purchases=mean("purchase_count")),
    "G-28_stockout_by_location": g("location", IE, "stockout_occurred", stockouts=N),
    "G-29_supplier_scorecard": g(
        "supplier_id", SD, deliveries=N, on_time_pct=pct("on_time"), short_ship_pct=pct("short_shipped"),
        avg_lead_time=mean("actual_lead_time_days"), lead_time_stddev="ROUND(STDDEV(actual_lead_time_days), 6)",
        fill_rate=f"{isum('received_quantity')} * 1e2 / NULLIF({isum('order_quantity')}, 0)"),
    "G-30_max_queue_wait": v("MAX(queue_wait_time)", J),
    "G-31_basket_by_hour": g("hour_of_simulation", H, avg_basket=mean("avg_basket_size")),
    "G-32_low_points_vs_tenure": g(
        "CASE WHEN days_since_join < 2500 THEN 'under_2500' WHEN days_since_join < 2600 THEN '2500_to_2600' ELSE 'over_2600' END AS tenure",
        S, customers=N, low_points="COUNT(*) FILTER (WHERE loyalty_points < 100000)", low_points_pct=pct("loyalty_points < 100000")),
}

TWINS = {**METRICS, **SUMMARIES, **DRILLS, **ANALYSES, **FORMULAS}
