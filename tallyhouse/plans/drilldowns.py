"""Drill-downs, multi-column analyses and further report formulas over the retail tables.

Each entry is one DataFrame expression ``tables -> DataFrame``. Top-k lists carry a unique key as the
last sort column so that ties have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.exprs import activity_state, corr_or_null, count_rows, int_sum, mean, only_value, pct, ratio, total
from tallyhouse.operators import customers as cust
from tallyhouse.plans import metrics

POSITIVE, NEGATIVE = ("positive", "very_positive"), ("negative", "very_negative")


def one(df: DataFrame, value: Column, name: str = "value", where: str | None = None) -> DataFrame:
    rows = df.filter(where) if where else df
    return rows.agg(value.cast("double").alias(name))


def by(df: DataFrame, keys, order: list, where: str | None = None, **aggs: Column) -> DataFrame:
    rows = df.filter(where) if where else df
    keys = [keys] if isinstance(keys, (str, Column)) else keys
    return rows.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]).orderBy(*order)


def high(c: str) -> Column:
    return F.desc_nulls_last(c)


def low(c: str) -> Column:
    return F.asc_nulls_last(c)


def _done(c: str) -> Column:
    return F.when(F.col("completed"), F.col(c))




def _negative(t) -> DataFrame:
    return t["customer_reviews"].filter(F.col("sentiment_category").isin(*NEGATIVE))


DRILLS = {
    # sales
    "D-01_order_volume": lambda t: one(t["customer_journeys"], count_rows(), where="completed"),
    "D-02_basket_size": lambda t: one(t["customer_journeys"], mean("basket_size"), where="completed"),
    "D-03_avg_unit_price": lambda t: one(
        t["customer_journeys"], F.try_divide(total("total_amount"), F.sum("basket_size")), where="completed"),
    "D-04_channel_mix": lambda t: by(
        t["customer_journeys"], "channel", [high("revenue"), low("channel")], "completed",
        revenue=total("total_amount"), orders=count_rows()),
    "D-05_active_customers": lambda t: one(t["customer_snapshots"], count_rows(), where="activity_state = 'active'"),
    "D-06_lapsed_customers": lambda t: one(t["customer_snapshots"], count_rows(), where="activity_state = 'lapsed'"),
    "D-07_churned_customers": lambda t: one(t["customer_snapshots"], count_rows(), where="churned"),
    "D-08_by_value_tier": lambda t: by(t["customer_snapshots"], "value_tier", [high("count"), low("value_tier")], count=count_rows()),
    "D-09_abandonment_by_reason": lambda t: by(
        t["customer_journeys"], "abandonment_reason", [high("count"), low("abandonment_reason")], "abandoned", count=count_rows()),
    "D-10_payment_failure_rate": lambda t: one(t["customer_journeys"], pct("payment_failed")),
    "D-11_queue_balk_rate": lambda t: one(
        t["customer_journeys"],
        F.try_divide(F.count_if(F.col("abandonment_reason") == "queue_too_long") * F.lit(100.0),
                     F.count_if(F.col("channel") == "in_store"))),
    "D-12_browsing_duration": lambda t: one(t["customer_journeys"], mean("browsing_duration")),
    "D-13_unit_price_mean": lambda t: one(t["order_items"], mean("unit_price")),
    "D-14_product_mix": lambda t: by(
        t["order_items"], "product_id", [high("revenue"), low("product_id")], revenue=total("subtotal"), units=int_sum("quantity")),
    "D-15_channel_aov": lambda t: by(
        t["customer_journeys"], "channel", [high("avg_aov"), low("channel")], "completed", avg_aov=mean("total_amount")),
    "D-16_purchase_frequency": lambda t: one(t["customer_snapshots"], mean("purchase_count")),
    "D-17_avg_order_value": lambda t: one(t["customer_snapshots"], mean("avg_order_value")),
    "D-18_tenure": lambda t: one(t["customer_snapshots"], mean("days_since_join")),
    "D-19_points": lambda t: one(t["customer_snapshots"], mean("loyalty_points")),
    "D-20_churn_risk": lambda t: one(t["customer_snapshots"], mean("churn_risk_score")),
    "D-21_returns_by_channel": lambda t: by(
        t["order_metrics"], "channel", [high("return_rate"), low("channel")],
        returns=F.count_if("returned"), total=count_rows(), return_rate=pct("returned")),
    "D-22_late_delivery_effect": lambda t: by(t["order_metrics"], "on_time", [low("on_time")], return_rate=pct("returned")),
    "D-23_fulfillment_effect": lambda t: by(
        t["order_metrics"], "returned", [low("returned")], avg_fulfillment=mean("fulfillment_duration")),
    # channels
    "D-24_hourly_arrivals": lambda t: by(
        t["hourly_demand"], "hour_of_simulation", [low("hour_of_simulation")], avg_arrivals=mean("arrival_count")),
    "D-25_hourly_revenue": lambda t: by(
        t["hourly_demand"], "hour_of_simulation", [low("hour_of_simulation")], avg_revenue=mean("revenue")),
    "D-26_hourly_orders": lambda t: by(
        t["hourly_demand"], "hour_of_simulation", [low("hour_of_simulation")], avg_orders=mean("order_count")),
    "D-27_hourly_abandons": lambda t: by(
        t["hourly_demand"], "hour_of_simulation", [low("hour_of_simulation")], avg_abandons=mean("abandonment_count")),
    "D-28_conversion_by_channel": lambda t: by(
        t["customer_journeys"], "channel", [high("conversion_rate"), low("channel")],
        conversion_rate=pct("completed"), total=count_rows()),
    "D-29_price": lambda t: one(t["customer_journeys"], count_rows(), where="abandonment_reason = 'price'"),
    "D-30_queue": lambda t: one(t["customer_journeys"], count_rows(), where="abandonment_reason = 'queue_too_long'"),
    "D-31_browsing_fatigue": lambda t: one(t["customer_journeys"], count_rows(), where="abandonment_reason = 'browsing_fatigue'"),
    "D-32_queue_wait": lambda t: one(t["customer_journeys"], mean("queue_wait_time")),
    "D-33_checkout_time": lambda t: one(t["customer_journeys"], mean("checkout_time")),
    "D-34_orders_by_channel": lambda t: by(t["order_metrics"], "channel", [high("orders"), low("channel")], orders=count_rows()),
    "D-35_payment_methods": lambda t: by(t["payments"], "payment_method", [high("count"), low("payment_method")], count=count_rows()),
    "D-36_late_orders": lambda t: one(t["order_metrics"], count_rows(), where="NOT on_time"),
    "D-37_fulfillment_by_channel": lambda t: by(
        t["order_metrics"], "channel", [high("avg_duration"), low("channel")], avg_duration=mean("fulfillment_duration")),
    "D-38_success_by_method": lambda t: by(
        t["payments"], "payment_method", [high("success_rate"), low("payment_method")],
        success_rate=pct(F.col("status") == "authorized")),
    "D-39_gateway_failure_rate": lambda t: one(t["payments"], pct(F.col("status") != "authorized"), "failure_rate"),
    # engagement
    "D-40_lapsed_rate": lambda t: one(t["customer_snapshots"], pct(F.col("activity_state") == "lapsed")),
    "D-41_retention_rate": lambda t: one(
        t["customer_snapshots"],
        (F.lit(1.0) - F.try_divide(F.count_if("churned").cast("double"), count_rows())) * 100.0),
    "D-42_state_distribution": lambda t: by(
        t["customer_snapshots"], "activity_state", [high("count"), low("activity_state")], count=count_rows()),
    "D-43_days_since_purchase": lambda t: one(t["customer_snapshots"], mean("days_since_last_purchase")),
    "D-44_unresponsive": lambda t: one(t["customer_snapshots"], mean("unresponsive_count")),
    "D-45_churn_by_tier": lambda t: by(
        t["customer_snapshots"], "value_tier", [high("churned"), low("value_tier")],
        churned=F.count_if("churned"), total=count_rows()),
    "D-46_open_by_type": lambda t: by(
        t["campaign_interactions"], "campaign_type", [high("open_rate"), low("campaign_type")],
        open_rate=pct("opened"), total=count_rows()),
    "D-47_ctr_by_type": lambda t: by(
        t["campaign_interactions"], "campaign_type", [high("ctr"), low("campaign_type")], ctr=pct("clicked")),
    "D-48_click_to_open": lambda t: one(
        t["campaign_interactions"], F.try_divide(F.count_if("clicked") * F.lit(100.0), F.count_if("opened"))),
    "D-49_campaign_conversion": lambda t: one(t["campaign_interactions"], pct("converted")),
    "D-50_points_balance": lambda t: one(t["loyalty_account"], mean("current_points")),
    "D-51_tier_distribution": lambda t: by(t["loyalty_account"], "tier", [high("count"), low("tier")], count=count_rows()),
    "D-52_lifetime_points": lambda t: one(t["loyalty_account"], F.sum("lifetime_points")),
    "D-53_issued": lambda t: one(t["points_transactions"], int_sum("points_change"), where="points_change > 0"),
    "D-54_redeemed": lambda t: one(t["points_transactions"], int_sum(F.abs("points_change")), where="points_change < 0"),
    "D-55_reasons": lambda t: by(t["points_transactions"], "reason", [high("count"), low("reason")], count=count_rows()),
    "D-56_open_tickets": lambda t: one(t["support_tickets"], count_rows(), where="status = 'open'"),
    "D-57_by_issue": lambda t: by(t["support_tickets"], "issue_type", [high("count"), low("issue_type")], count=count_rows()),
    "D-58_satisfaction_by_issue": lambda t: by(
        t["support_tickets"], "issue_type", [high("avg_rating"), low("issue_type")],
        avg_rating=mean("satisfaction_rating"), count=count_rows()),
    "D-59_total_tickets": lambda t: one(t["support_tickets"], count_rows()),
    # stock
    "D-60_qty_by_location": lambda t: by(
        t["inventory"], "location_id", [high("qty"), low("location_id")], qty=int_sum("quantity_on_hand")),
    "D-61_reserved": lambda t: one(t["inventory"], int_sum("quantity_reserved")),
    "D-61_on_order": lambda t: one(t["inventory"], int_sum("on_order_qty")),
    "D-61b_days_of_supply": lambda t: one(
        t["inventory_snapshots"], mean(F.when(F.col("daily_demand") > 0, ratio("quantity_on_hand", "daily_demand")))),
    "D-62_demand_spikes": lambda t: one(
        t["inventory_snapshots"].withColumn("__m", only_value(t["inventory_snapshots"].agg(mean("daily_demand")))),
        F.count_if(F.col("daily_demand") > F.col("__m") * 2)),
    "D-63_slow_deliveries": lambda t: one(
        t["supplier_deliveries"], mean(F.col("actual_lead_time_days") - F.col("expected_lead_time_days")), "avg_delay",
        "actual_lead_time_days > expected_lead_time_days"),
    "D-64_below_reorder_detail": lambda t: t["inventory"].filter("quantity_on_hand <= reorder_point")
        .select("sku", "location_id", "quantity_on_hand", "reorder_point").orderBy("quantity_on_hand", "sku", "location_id"),
    "D-65_demand_rate": lambda t: one(t["inventory_snapshots"], mean("daily_demand")),
    "D-66_shrinkage_events": lambda t: t["inventory_events"].filter("event_type = 'SHRINKAGE'").agg(
        count_rows().alias("total_events"), int_sum(F.abs("quantity_change")).alias("total_units")),
    "D-67_supplier_reliability": lambda t: t["supplier_deliveries"].agg(
        pct("on_time").alias("on_time_pct"), pct("short_shipped").alias("short_ship_pct")),
    "D-68_stockout_rate": lambda t: one(
        t["inventory_events"],
        F.try_divide(F.count_if("stockout_occurred") * F.lit(100.0), F.count_if(F.col("event_type") == "SALE"))),
    "D-69_stockout_by_sku": lambda t: by(
        t["inventory_events"], "sku", [high("stockouts"), low("sku")], "stockout_occurred", stockouts=count_rows()),
    "D-70_lead_time_stddev": lambda t: one(t["supplier_deliveries"], F.round(F.stddev_samp("actual_lead_time_days"), 6)),
    "D-71_lead_time_accuracy": lambda t: one(
        t["supplier_deliveries"], mean(F.col("actual_lead_time_days") - F.col("expected_lead_time_days"))),
    "D-72_short_ship_rate": lambda t: one(t["supplier_deliveries"], pct("short_shipped")),
    "D-73_lead_time_by_supplier": lambda t: by(
        t["supplier_deliveries"], "supplier_id", [high("avg_lead_time"), low("supplier_id")],
        avg_lead_time=mean("actual_lead_time_days"), deliveries=count_rows()),
    "D-74_qty_leadtime_corr": lambda t: one(
        t["supplier_deliveries"], F.round(corr_or_null("order_quantity", "actual_lead_time_days"), 8), "correlation"),
    "D-75_received_vs_ordered": lambda t: one(
        t["supplier_deliveries"],
        F.try_divide(int_sum("received_quantity") * F.lit(100.0), int_sum("order_quantity")), "fill_rate"),
    "D-76_reorder_trigger_rate": lambda t: one(t["inventory_snapshots"], pct("reorder_triggered")),
    "D-77_demand_trend": lambda t: by(
        t["inventory_snapshots"], "snapshot_day", [low("snapshot_day")], total_demand=int_sum("daily_demand")),
    "D-78_shrinkage_by_sku": lambda t: by(
        t["inventory_events"], "sku", [high("shrinkage_units"), low("sku")], "event_type = 'SHRINKAGE'",
        shrinkage_units=int_sum(F.abs("quantity_change"))),
    # reviews
    "D-79_sentiment_distribution": lambda t: by(
        t["customer_reviews"], "sentiment_category", [high("avg_score"), low("sentiment_category")],
        count=count_rows(), avg_score=mean("sentiment_score")),
    "D-80_lowest_scored": lambda t: with_text(
        t["customer_reviews"], "sentiment_score IS NOT NULL", ["sentiment_score", "id"], 5,
        ["id", "review_text", "sentiment_score", "sentiment_category"]),
    "D-81_reviews_by_status": lambda t: by(t["customer_reviews"], "status", [high("count"), low("status")], count=count_rows()),
    "D-82_by_sentiment": lambda t: by(
        t["customer_reviews"], "sentiment_category", [high("count"), low("sentiment_category")], count=count_rows()),
    "D-83_positive_detail": lambda t: with_text(
        t["customer_reviews"], F.col("sentiment_category").isin(*POSITIVE), [high("sentiment_score"), "id"], 5,
        ["id", "review_text", "sentiment_score"]),
    "D-84_negative_detail": lambda t: with_text(
        t["customer_reviews"], F.col("sentiment_category").isin(*NEGATIVE), ["sentiment_score", "id"], 5,
        ["id", "review_text", "sentiment_score"]),
    "D-85_unresolved_negative": lambda t: _negative(t).filter("chatbot_statement IS NULL")
        .select("id", "review_text", "sentiment_score", "status").orderBy("sentiment_score", "id"),
    "D-86_pending_reviews": lambda t: t["customer_reviews"].filter("chatbot_statement IS NULL")
        .orderBy(high("created_at"), "id").select("id", "review_text", "status", "error_message"),
    "D-87_response_by_status": lambda t: by(
        t["customer_reviews"], "status", [high("count"), low("status")],
        count=count_rows(), responded=F.count("chatbot_statement")),
}


# --- analyses -----------------------------------------------------------------------------------


def channel_comparison(journeys: DataFrame) -> DataFrame:
    return by(
        journeys, "channel", [high("completed_orders"), low("channel")],
        total_journeys=count_rows(), completed_orders=F.count_if("completed"), conversion_rate=pct("completed"),
        avg_order_value=mean(_done("total_amount")), avg_journey_time=mean("total_journey_time"),
        abandonment_rate=pct("abandoned"))


def segment_analysis(snapshots: DataFrame) -> DataFrame:
    return by(
        snapshots, ["value_tier", "activity_state"], [low("value_tier"), low("activity_state")],
        customers=count_rows(), avg_spend=mean("total_spend"), avg_purchases=mean("purchase_count"),
        avg_churn_risk=mean("churn_risk_score"), avg_loyalty_points=mean("loyalty_points"))


def sku_status_summary(inventory: DataFrame) -> DataFrame:
    status = F.when(F.col("quantity_on_hand") <= F.col("reorder_point"), "below_reorder").otherwise("above_reorder")
    return by(
        inventory, status.alias("status"), [low("status")],
        sku_count=count_rows(), avg_qty_on_hand=F.round(mean("quantity_on_hand"), 1),
        avg_qty_reserved=F.round(mean("quantity_reserved"), 1), avg_on_order=F.round(mean("on_order_qty"), 1),
        zero_stock_count=F.count_if(F.col("quantity_on_hand") == 0))


def critical_skus(inventory: DataFrame, n: int = 20) -> DataFrame:
    columns = ["sku", "location_id", "quantity_on_hand", "quantity_reserved", "on_order_qty", "reorder_point"]
    below = (F.col("quantity_on_hand") <= F.col("reorder_point")).alias("below_reorder")
    return inventory.orderBy(F.col("quantity_on_hand") - F.col("reorder_point"), "sku", "location_id").limit(n).select(
        *columns, below)


def review_analysis(reviews: DataFrame) -> DataFrame:
    return by(
        reviews, "sentiment_category", [high("avg_score"), low("sentiment_category")],
        review_count=count_rows(), avg_score=mean("sentiment_score"), responded=F.count("chatbot_statement"),
        pending_response=F.count_if(F.col("chatbot_statement").isNull()))


def channel_breakdown(journeys: DataFrame) -> DataFrame:
    return journeys.groupBy("channel").agg(
        pct("completed").alias("conversion_rate"),
        mean(_done("total_amount")).alias("avg_order_value"),
        count_rows().alias("total_journeys"),
        F.count_if("completed").alias("completed_orders"),
        mean("total_journey_time").alias("avg_journey_time"),
        pct("abandoned").alias("abandonment_rate"),
        F.coalesce(total(_done("total_amount")), F.lit(0.0)).alias("total_revenue"),
    )


def order_kpis_by_channel(orders: DataFrame) -> DataFrame:
    return orders.groupBy("channel").agg(
        mean("fulfillment_duration").alias("avg_fulfillment"),
        pct("on_time").alias("ontime_rate"),
        pct("returned").alias("return_rate"),
    )


def customer_kpis_by_state(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("activity_state").agg(
        count_rows().alias("customers"),
        mean("total_spend").alias("avg_spend"),
        mean("churn_risk_score").alias("avg_churn_risk"),
        mean("purchase_count").alias("avg_purchases"),
    )


def correlation_bundle(t) -> DataFrame:
    """The three breakdowns in one long result: (scope, group_name, measure, value)."""

    def long(df: DataFrame, scope: str, key: str) -> DataFrame:
        names = [c for c in df.columns if c != key]
        wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in names])
        return wide.unpivot([key], names, "measure", "value").select(
            F.lit(scope).alias("scope"), F.col(key).alias("group_name"), "measure", "value")

    per_channel = channel_breakdown(t["customer_journeys"]).join(
        order_kpis_by_channel(t["order_metrics"]), "channel", "full")
    return long(per_channel, "channel", "channel").unionByName(
        long(customer_kpis_by_state(t["customer_snapshots"]), "activity_state", "activity_state"))


def hourly_trend(hourly: DataFrame, hours: int = 24, channel: str | None = None) -> DataFrame:
    rows = hourly.filter(F.col("channel") == channel) if channel else hourly
    return rows.orderBy(high("hour_of_simulation"), "channel", "id").limit(hours).select(
        "hour_of_simulation", "hour_of_day", "day_of_week", "channel", "arrival_count", "order_count",
        "abandonment_count", "revenue", "avg_basket_size", "id")


def demand_by_hour_of_day(hourly: DataFrame) -> DataFrame:
    return by(
        hourly, "hour_of_day", [low("hour_of_day")],
        avg_arrivals=mean("arrival_count"), avg_orders=mean("order_count"), avg_abandonments=mean("abandonment_count"),
        avg_revenue=mean("revenue"), data_points=count_rows())


def with_text(reviews: DataFrame, where, order: list, n: int, columns: list[str]) -> DataFrame:
    """The first n reviews. They are ranked without their texts; only the chosen ids, n at most, are sent to the texts."""
    chosen = reviews.filter(where).orderBy(*order).limit(n).select("id")
    return reviews.join(F.broadcast(chosen), "id", "left_semi").filter(where).orderBy(*order).limit(n).select(*columns)


def review_listing(reviews: DataFrame, only: str = "all", n: int = 200) -> DataFrame:
    kept = {
        "all": F.lit(True),
        "positive": F.col("sentiment_category").isin(*POSITIVE),
        "negative": F.col("sentiment_category").isin(*NEGATIVE),
        "needs_review": F.col("status") == "Needing human review",
    }[only]
    columns = ["id", "review_text", "sentiment_category", "sentiment_score", "status", "chatbot_statement", "created_at"]
    return with_text(reviews, kept, [F.desc("id")], n, columns)


ANALYSES = {
    "A-01_channel_comparison": lambda t: channel_comparison(t["customer_journeys"]),
    "A-02_segment_analysis": lambda t: segment_analysis(t["customer_snapshots"]),
    "A-03_sku_status_summary": lambda t: sku_status_summary(t["inventory"]),
    "A-04_critical_skus": lambda t: critical_skus(t["inventory"]),
    "A-05_review_analysis": lambda t: review_analysis(t["customer_reviews"]),
    "A-06_channel_breakdown": lambda t: channel_breakdown(t["customer_journeys"]),
    "A-07_order_kpis_by_channel": lambda t: order_kpis_by_channel(t["order_metrics"]),
    "A-08_customer_kpis_by_state": lambda t: customer_kpis_by_state(t["customer_snapshots"]),
    "A-09_correlation_bundle": correlation_bundle,
    "A-10_hourly_trend": lambda t: hourly_trend(t["hourly_demand"], 24),
    "A-10_hourly_trend_online": lambda t: hourly_trend(t["hourly_demand"], 5000, "online"),
    "A-11_demand_by_hour_of_day": lambda t: demand_by_hour_of_day(t["hourly_demand"]),
    "T-01_review_listing": lambda t: review_listing(t["customer_reviews"]),
    "T-01_review_listing_positive": lambda t: review_listing(t["customer_reviews"], "positive"),
    "T-01_review_listing_negative": lambda t: review_listing(t["customer_reviews"], "negative"),
    "T-01_review_listing_needs_review": lambda t: review_listing(t["customer_reviews"], "needs_review"),
}


# --- further formulas ---------------------------------------------------------------------------


def category_mix(t) -> DataFrame:
    """Revenue by product category. Lines are summed per product first, so the join with the products
    sees one row per product and a best-seller cannot skew it."""
    sold = t["order_items"].groupBy("product_id").agg(total("subtotal").alias("__revenue"))
    named = sold.join(t["products"].select("product_id", "category"), "product_id")
    return named.groupBy("category").agg(total("__revenue").alias("revenue")).orderBy(high("revenue"), low("category"))


def state_transitions(t) -> DataFrame:
    """Moves of customers between activity states from one purchase day to the next. The state on a
    purchase day follows from the days since the purchase before.

    A customer has one row per calendar day at most, so plain windows do.
    """
    days = t["customer_purchase_history"].select("customer_id", F.to_date("purchase_date").alias("day")).distinct()
    along = Window.partitionBy("customer_id").orderBy("day")
    gaps = days.withColumn("before", F.lag("day").over(along))
    states = gaps.withColumn("state", activity_state(F.datediff("day", "before"))).filter("before IS NOT NULL")
    moves = states.select("customer_id", "day", "state").withColumn("from_state", F.lag("state").over(along))
    return (
        moves.filter("from_state IS NOT NULL")
        .groupBy("from_state", F.col("state").alias("to_state"))
        .agg(count_rows().alias("transitions"))
    )


def _resolution_hours() -> Column:
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.col("resolved_at"))
    return seconds / 3600.0


def satisfaction_by_speed(t) -> DataFrame:
    h = _resolution_hours()
    bucket = F.when(h < 12, "under_12h").when(h < 24, "12h_to_24h").when(h < 48, "24h_to_48h").otherwise("over_48h")
    rows = t["support_tickets"].filter("resolved_at IS NOT NULL").withColumn("speed", bucket)
    return rows.groupBy("speed").agg(mean("satisfaction_rating").alias("avg_rating"), count_rows().alias("tickets"))


def spike_skus(t) -> DataFrame:
    """SKUs with a day above twice their own mean demand. The mean per SKU is joined back, so a SKU's
    days need not fit into one task."""
    days = t["inventory_snapshots"].select("sku", "daily_demand")
    means = days.groupBy("sku").agg(mean("daily_demand").alias("__mean"))
    high_days = days.join(means, "sku").filter(F.col("daily_demand") > F.col("__mean") * 2)
    return high_days.groupBy("sku").agg(count_rows().alias("spike_days"), F.max("daily_demand").alias("peak_demand"))


def _demand_per_sku(t) -> DataFrame:
    return t["inventory_snapshots"].groupBy("sku", "location").agg(mean("daily_demand").alias("avg_demand"))


def reorder_adequacy(t) -> DataFrame:
    policy = t["replenishment_policy"].withColumnRenamed("location_id", "location")
    need = F.col("avg_demand") * F.col("lead_time_days")
    joined = policy.join(_demand_per_sku(t), ["sku", "location"])
    return joined.agg(
        count_rows().alias("policies"),
        F.count_if(F.col("reorder_point") >= need).alias("adequate"),
        pct(F.col("reorder_point") >= need).alias("adequate_pct"),
    )


def safety_coverage(t) -> DataFrame:
    policy = t["replenishment_policy"].select("sku", F.col("location_id").alias("location"), "safety_stock")
    rows = t["inventory_snapshots"].select("sku", "location", "daily_demand").join(policy, ["sku", "location"])
    return one(rows, mean(ratio("safety_stock", "daily_demand")))


def low_points_vs_tenure(t) -> DataFrame:
    d = F.col("days_since_join")
    bucket = F.when(d < 2500, "under_2500").when(d < 2600, "2500_to_2600").otherwise("over_2600")
    return t["customer_snapshots"].groupBy(bucket.alias("tenure")).agg(
        count_rows().alias("customers"),
        F.count_if(F.col("loyalty_points") < 100_000).alias("low_points"),
        pct(F.col("loyalty_points") < 100_000).alias("low_points_pct"),
    )


def score_histogram(reviews: DataFrame, low_end: float = -1.0, high_end: float = 1.0, buckets: int = 10) -> DataFrame:
    b = F.width_bucket("sentiment_score", F.lit(low_end), F.lit(high_end), F.lit(buckets)).cast("int")
    rows = reviews.filter("sentiment_score IS NOT NULL")
    return rows.groupBy(b.alias("bucket")).agg(count_rows().alias("reviews")).orderBy("bucket")


FORMULAS = {
    "G-01_category_mix": category_mix,
    "G-02_returns_by_dow": lambda t: by(
        t["order_metrics"], "day_of_week", [low("day_of_week")],
        returns=F.count_if("returned"), total=count_rows(), return_rate=pct("returned")),
    "G-03_orders_by_hour": lambda t: by(t["order_metrics"], "order_hour", [low("order_hour")], orders=count_rows()),
    "G-04_state_transitions": state_transitions,
    "G-05_spend_stagnation": lambda t: cust.spend_stagnation(t["customer_snapshots"]),
    "G-06_service_issues": lambda t: one(
        t["support_tickets"], count_rows(), where="status <> 'resolved' OR satisfaction_rating <= 3"),
    "G-07_open_by_segment": lambda t: by(
        t["campaign_interactions"], ["value_tier", "rfm_segment"], [low("value_tier"), low("rfm_segment")],
        open_rate=pct("opened"), sends=count_rows()),
    "G-08_fatigue_trend": lambda t: by(
        t["campaign_interactions"], F.floor(F.col("send_time") / 24).cast("int").alias("day"), [low("day")],
        avg_unresponsive=mean("unresponsive_count")),
    "G-09_resolution_time": lambda t: one(t["support_tickets"], mean(_resolution_hours()), "avg_hours"),
    "G-10_satisfaction_by_speed": satisfaction_by_speed,
    "G-11_spike_skus": spike_skus,
    "G-12_safety_coverage": safety_coverage,
    "G-13_reorder_adequacy": reorder_adequacy,
    "G-14_stockout_hours": lambda t: one(t["inventory_snapshots"], F.sum("stockout_hours")),
    "G-15_po_count": lambda t: one(t["purchase_orders"], count_rows()),
    "G-16_po_status": lambda t: by(t["purchase_orders"], "po_status", [low("po_status")], orders=count_rows()),
    "G-17_avg_order_qty": lambda t: one(t["purchase_orders"], mean("order_quantity")),
    "G-18_shrinkage_by_type": lambda t: by(
        t["inventory_events"], ["sku", "location"], [high("shrinkage_units"), low("sku"), low("location")],
        "event_type = 'SHRINKAGE'", shrinkage_units=int_sum(F.abs("quantity_change"))),
    "G-19_shrinkage_impact": lambda t: metrics.scalar(t, "M-42_shrinkage_vs_stock").select(
        (F.col("value") / 100.0).alias("value")),
    "G-20_daily_review_rate": lambda t: one(
        t["customer_reviews"],
        F.try_divide(count_rows().cast("double"),
                     F.datediff(F.to_date(F.max("created_at")), F.to_date(F.min("created_at"))) + 1)),
    "G-21_with_text": lambda t: one(t["customer_reviews"], F.count("review_text")),
    "G-22_category_counts": lambda t: t["customer_reviews"].agg(
        *[F.count_if(F.col("sentiment_category") == c).alias(c) for c in ("very_positive", "positive", "negative", "very_negative")]),
    "G-23_score_histogram": lambda t: score_histogram(t["customer_reviews"]),
    "G-24_score_stddev": lambda t: one(t["customer_reviews"], F.round(F.stddev_samp("sentiment_score"), 6)),
    "G-25_ambiguous_reviews": lambda t: one(
        t["customer_reviews"], count_rows(), where="status = 'Needing human review' AND sentiment_category = 'neutral'"),
    "G-26_auto_vs_manual": lambda t: t["customer_reviews"].filter("status <> 'To be processed'").agg(
        F.count("chatbot_statement").alias("automatic"),
        F.count_if(F.col("chatbot_statement").isNull()).alias("manual")),
    "G-27_rfm_distribution": lambda t: by(
        t["customer_snapshots"], "rfm_segment", [low("rfm_segment")], customers=count_rows()),
    "G-27_spend_by_tier": lambda t: by(
        t["customer_snapshots"], "value_tier", [low("value_tier")], avg_spend=mean("total_spend")),
    "G-27_purchases_by_segment": lambda t: by(
        t["customer_snapshots"], "rfm_segment", [low("rfm_segment")], avg_purchases=mean("purchase_count")),
    "G-28_stockout_by_location": lambda t: by(
        t["inventory_events"], "location", [low("location")], "stockout_occurred", stockouts=count_rows()),
    "G-29_supplier_scorecard": lambda t: by(
        t["supplier_deliveries"], "supplier_id", [low("supplier_id")],
        deliveries=count_rows(), on_time_pct=pct("on_time"), short_ship_pct=pct("short_shipped"),
        avg_lead_time=mean("actual_lead_time_days"),
        lead_time_stddev=F.round(F.stddev_samp("actual_lead_time_days"), 6),
        fill_rate=F.try_divide(int_sum("received_quantity") * F.lit(100.0), int_sum("order_quantity"))),
    "G-30_max_queue_wait": lambda t: one(t["customer_journeys"], F.max("queue_wait_time")),
    "G-31_basket_by_hour": lambda t: by(
        t["hourly_demand"], "hour_of_simulation", [low("hour_of_simulation")], avg_basket=mean("avg_basket_size")),
    "G-32_low_points_vs_tenure": low_points_vs_tenure,
}

# Which drill-downs explain which KPI, with the label shown.
DRIVERS: dict[str, list[tuple[str, str]]] = {
    "revenue": [("Order Volume", "D-01_order_volume"), ("Average Order Value", "M-04_aov"), ("Basket Size", "D-02_basket_size"),
                ("Average Unit Price", "D-03_avg_unit_price"), ("Channel Mix", "D-04_channel_mix")],
    "customers": [("Active Customers", "D-05_active_customers"), ("Lapsed Customers", "D-06_lapsed_customers"),
                  ("Churned Customers", "D-07_churned_customers"), ("By Value Tier", "D-08_by_value_tier")],
    "conversion": [("Cart Abandonment Rate", "M-09_omni_cart_abandon"), ("Abandonment by Reason", "D-09_abandonment_by_reason"),
                   ("Payment Failure Rate", "D-10_payment_failure_rate"), ("Queue Balk Rate", "D-11_queue_balk_rate"),
                   ("Browsing Duration", "D-12_browsing_duration")],
    "aov": [("Basket Size", "D-02_basket_size"), ("Unit Price Distribution", "D-13_unit_price_mean"),
            ("Product Mix", "D-14_product_mix"), ("Channel Effect", "D-15_channel_aov")],
    "clv": [("Purchase Frequency", "D-16_purchase_frequency"), ("Average Order Value", "D-17_avg_order_value"),
            ("Customer Tenure", "D-18_tenure"), ("Loyalty Points Balance", "D-19_points"), ("Churn Risk Score", "D-20_churn_risk")],
    "return-rate": [("Returns by Channel", "D-21_returns_by_channel"), ("Late Delivery Effect", "D-22_late_delivery_effect"),
                    ("Fulfillment Duration Effect", "D-23_fulfillment_effect")],
    "omni-arrival-rate": [("Hourly Arrival Count", "D-24_hourly_arrivals"), ("Hourly Revenue", "D-25_hourly_revenue"),
                          ("Hourly Order Count", "D-26_hourly_orders"), ("Hourly Abandonment", "D-27_hourly_abandons")],
    "omni-conversion": [("Conversion by Channel", "D-28_conversion_by_channel"), ("Payment Failure Rate", "D-10_payment_failure_rate"),
                        ("Queue Balk Rate", "D-11_queue_balk_rate")],
    "omni-cart-abandon": [("Price Sensitivity", "D-29_price"), ("Queue Too Long", "D-30_queue"), ("Browsing Fatigue", "D-31_browsing_fatigue")],
    "omni-avg-journey": [("Avg Browsing Duration", "D-12_browsing_duration"), ("Avg Queue Wait Time", "D-32_queue_wait"),
                         ("Avg Checkout Time", "D-33_checkout_time")],
    "omni-total-orders": [("Orders by Channel", "D-34_orders_by_channel"), ("Avg Basket Size", "D-02_basket_size"),
                          ("Payment Method Distribution", "D-35_payment_methods")],
    "omni-ontime": [("Late Orders", "D-36_late_orders"), ("Fulfillment by Channel", "D-37_fulfillment_by_channel"), ("Return Rate", "M-06_return_rate")],
    "omni-fulfillment-dur": [("Duration by Channel", "D-37_fulfillment_by_channel"), ("On-Time Delivery %", "M-12_omni_ontime"),
                             ("Late Orders", "D-36_late_orders")],
    "omni-payment-success": [("By Payment Method", "D-38_success_by_method"), ("Gateway Reliability", "D-39_gateway_failure_rate"),
                             ("Conversion Impact", "D-10_payment_failure_rate")],
    "ce-active-rate": [("Lapsed Customer Rate", "D-40_lapsed_rate"), ("Retention Rate", "D-41_retention_rate"),
                       ("Lifecycle State Distribution", "D-42_state_distribution")],
    "ce-churn-rate": [("Days Since Last Purchase", "D-43_days_since_purchase"), ("Unresponsive Count", "D-44_unresponsive"),
                      ("Churn by Value Tier", "D-45_churn_by_tier")],
    "ce-open-rate": [("Response by Campaign Type", "D-46_open_by_type"), ("Campaign Fatigue", "D-44_unresponsive")],
    "ce-campaign-ctr": [("Click-to-Open Rate", "D-48_click_to_open"), ("Campaign Conversion Rate", "D-49_campaign_conversion"),
                        ("CTR by Campaign Type", "D-47_ctr_by_type")],
    "ce-enrollment-rate": [("Avg Points Balance", "D-50_points_balance"), ("Tier Distribution", "D-51_tier_distribution"),
                           ("Lifetime Points Earned", "D-52_lifetime_points")],
    "ce-redemption-rate": [("Points Issued", "D-53_issued"), ("Points Redeemed", "D-54_redeemed"), ("Transaction Reasons", "D-55_reasons")],
    "ce-resolution-rate": [("Open Tickets", "D-56_open_tickets"), ("Tickets by Issue Type", "D-57_by_issue")],
    "ce-satisfaction": [("Satisfaction by Issue Type", "D-58_satisfaction_by_issue"), ("Total Tickets", "D-59_total_tickets")],
    "ir-qty-on-hand": [("Quantity by Location", "D-60_qty_by_location"), ("Reserved Inventory", "D-61_reserved"),
                       ("On-Order Inventory", "D-61_on_order"), ("Days of Supply", "D-61b_days_of_supply")],
    "ir-below-reorder": [("Demand Spikes", "D-62_demand_spikes"), ("Slow Supplier Deliveries", "D-63_slow_deliveries"),
                         ("Items Below Reorder Detail", "D-64_below_reorder_detail")],
    "ir-stockout-count": [("Demand Rate", "D-65_demand_rate"), ("Supplier Lead Time", "M-28_ir_avg_lead_time"),
                          ("Shrinkage Events", "D-66_shrinkage_events"), ("Supplier Reliability", "D-67_supplier_reliability")],
    "ir-fill-rate": [("Stockout Rate", "D-68_stockout_rate"), ("Stockout by SKU", "D-69_stockout_by_sku")],
    "ir-supplier-ontime": [("Lead Time Variance", "D-70_lead_time_stddev"), ("Lead Time Accuracy", "D-71_lead_time_accuracy"),
                           ("Short Shipment Rate", "D-72_short_ship_rate")],
    "ir-avg-lead-time": [("By Supplier", "D-73_lead_time_by_supplier"), ("Order Quantity Effect", "D-74_qty_leadtime_corr"),
                         ("Received vs Ordered", "D-75_received_vs_ordered")],
    "ir-turnover": [("Reorder Trigger Rate", "D-76_reorder_trigger_rate"), ("Demand Trend", "D-77_demand_trend")],
    "ir-shrinkage-rate": [("Shrinkage Events", "D-66_shrinkage_events"), ("Shrinkage by SKU", "D-78_shrinkage_by_sku")],
    "cr-avg-sentiment": [("Sentiment Distribution", "D-79_sentiment_distribution"), ("Lowest Scored Reviews", "D-80_lowest_scored")],
    "cr-review-volume": [("Reviews by Status", "D-81_reviews_by_status"), ("Reviews by Sentiment", "D-82_by_sentiment")],
    "cr-positive-rate": [("Positive Reviews Detail", "D-83_positive_detail"), ("Sentiment Distribution", "D-82_by_sentiment")],
    "cr-negative-rate": [("Negative Reviews Detail", "D-84_negative_detail"), ("Unresolved Negative Reviews", "D-85_unresolved_negative")],
    "cr-response-rate": [("Pending Reviews", "D-86_pending_reviews"), ("Response Status Breakdown", "D-87_response_by_status")],
}


def drivers(t, metric_id: str) -> list[tuple[str, DataFrame]]:
    """Labelled drill-downs of a KPI."""
    if metric_id not in DRIVERS:
        raise KeyError(f"unknown metric {metric_id!r}; known: {sorted(DRIVERS)}")
    return [
        (label, metrics.scalar(t, key) if key in metrics.METRICS else DRILLS[key](t)) for label, key in DRIVERS[metric_id]
    ]
