"""Feature sets for the models: one projection or grouped pass per data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.exprs import count_rows, int_sum, total


def _of(df: DataFrame, scenario_ids: Sequence[str] | None) -> DataFrame:
    return df.filter(F.col("scenario_id").isin(list(scenario_ids))) if scenario_ids else df


def conversion(t, scenario_ids=None) -> DataFrame:
    rows = _of(t["customer_journeys"], scenario_ids).filter("basket_size > 0")
    return rows.select(
        "channel", "arrival_hour", "day_of_week", "browsing_duration", "basket_size", "queue_wait_time", "completed")


def order_value(t, scenario_ids=None) -> DataFrame:
    rows = _of(t["customer_journeys"], scenario_ids).filter("completed AND total_amount > 0")
    return rows.select(
        "channel", "basket_size", "arrival_hour", "day_of_week", "browsing_duration", "queue_wait_time", "total_amount")


def demand(t, scenario_ids=None, channel: str | None = None) -> DataFrame:
    """Orders, arrivals and revenue by hour of the week and channel; ``ds`` is that hour of a fixed week."""
    rows = _of(t["hourly_demand"], scenario_ids)
    rows = rows.filter(F.col("channel") == channel) if channel else rows
    grouped = rows.groupBy("hour_of_day", "day_of_week", "channel").agg(
        int_sum("order_count").alias("y"), int_sum("arrival_count").alias("arrivals"), total("revenue").alias("revenue"))
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return grouped.withColumn("ds", start + F.make_dt_interval(hours=F.col("day_of_week") * 24 + F.col("hour_of_day")))


def fulfillment(t, scenario_ids=None) -> DataFrame:
    rows = _of(t["order_metrics"], scenario_ids).filter("fulfillment_duration > 0")
    return rows.select("channel", "order_hour", "day_of_week", "fulfillment_duration")


def stockout(t, scenario_ids=None) -> DataFrame:
    rows = _of(t["inventory_events"], scenario_ids).filter("event_type IN ('SALE', 'demand_consumed')")
    return rows.select(
        "quantity_before", "reorder_point", "safety_stock", "on_order_qty", "event_hour", "day_of_week", "stockout_occurred")


def lead_time(t, scenario_ids=None) -> DataFrame:
    """Day of week from the order day rounded half to even, as the recorded data sets have it."""
    rows = _of(t["supplier_deliveries"], scenario_ids).filter("actual_lead_time_days > 0")
    day = (F.rint(F.col("order_time") / 24).cast("int") % 7).alias("day_of_week")
    return rows.select(
        "supplier_id", "order_quantity", day, "expected_lead_time_days", "actual_lead_time_days", "on_time", "short_shipped")


def inventory_demand(t, scenario_ids=None) -> DataFrame:
    return _of(t["inventory_snapshots"], scenario_ids).select(
        "sku", "location", "snapshot_day", "daily_demand", "daily_receipts", "quantity_on_hand", "stockout_hours", "reorder_triggered")


def churn(t, scenario_ids=None) -> DataFrame:
    return _of(t["customer_snapshots"], scenario_ids).select(
        "days_since_last_purchase", "days_since_join", "total_spend", "purchase_count", "avg_order_value", "loyalty_points",
        "unresponsive_count", "value_tier", "rfm_segment", "churn_risk_score", "churned")


def campaign(t, scenario_ids=None) -> DataFrame:
    return _of(t["campaign_interactions"], scenario_ids).select(
        "campaign_type", "value_tier", "rfm_segment", "unresponsive_count", "days_since_last_engagement", "opened", "clicked", "converted")


def clv(t, scenario_ids=None) -> DataFrame:
    return _of(t["customer_snapshots"], scenario_ids).filter("total_spend > 0").select(
        "days_since_join", "purchase_count", "avg_order_value", "loyalty_points", "value_tier", "rfm_segment", "total_spend")


def dataset_stats(t) -> DataFrame:
    """Sizes of what the models can learn from, as (section, name, value)."""

    def rows(df: DataFrame, section: str, **counts) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in counts.items()])
        return one.unpivot([], list(counts), "name", "value").select(F.lit(section).alias("section"), "name", "value")

    return (
        rows(t["simulation_scenarios"], "scenarios", total=count_rows(), completed=F.count_if(F.col("status") == "completed"))
        .unionByName(rows(t["customer_journeys"], "journeys", total=count_rows(), completed=F.count_if("completed"),
                          scenarios=F.count_distinct("scenario_id")))
        .unionByName(rows(t["order_metrics"], "orders", total=count_rows()))
        .unionByName(rows(t["hourly_demand"], "hourly_demand", total=count_rows()))
    )
