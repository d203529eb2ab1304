"""Catalogue of scalar KPIs.

A KPI is data: the table it reads, an aggregate in Spark SQL and how to show it. The aggregate is
complete on its own (its condition is inside), so one KPI can run alone with its filter pushed to the
scan, and any number of KPIs of a table can run together in one pass over that table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import ordered
from tallyhouse.functions.exprs import mean_sql as mean, only_value, total as exact_total, total_sql as total


def pct(condition: str, among: str | None = None) -> str:
    rows = f"count_if({among})" if among else "count(*)"
    both = f"({condition}) AND ({among})" if among else condition
    return f"try_divide(count_if({both}) * 1e2, {rows})"


@dataclass(frozen=True)
class Metric:
    key: str
    tab: str
    label: str
    format: str
    table: str
    value: str
    where: str | None = None  # rows that can matter; only a pushdown aid
    extra: tuple[str, str] | None = None  # (table, aggregate), a scalar subquery named "other"


def _done(x: str) -> str:
    return f"CASE WHEN completed THEN {x} END"


def _units(kind: str) -> str:
    return f"sum(CASE WHEN event_type = '{kind}' THEN abs(quantity_change) ELSE 0 END)"


J, S, O = "customer_journeys", "customer_snapshots", "order_metrics"
CI, PT, ST = "campaign_interactions", "points_transactions", "support_tickets"
INV, IE, IS, SD, CR = "inventory", "inventory_events", "inventory_snapshots", "supplier_deliveries", "customer_reviews"
MAIN, OMNI, ENG, STOCK, REV = "main", "omnichannel", "customer-engagement", "inventory-replenishment", "customer-reviews"
POSITIVE, NEGATIVE = "('positive', 'very_positive')", "('negative', 'very_negative')"

# Titles, formats and definitions of the KPIs.
DASHBOARD = (
    Metric("M-01_revenue", MAIN, "Total Revenue", "currency", J, total(_done("total_amount")), "completed"),
    Metric("M-02_customers", MAIN, "Total Customers", "number", S, "count(DISTINCT customer_id)"),
    Metric("M-03_conversion", MAIN, "Conversion Rate", "percentage", J, pct("completed")),
    Metric("M-04_aov", MAIN, "Average Order Value", "currency", J, mean(_done("total_amount")), "completed"),
    Metric("M-05_clv", MAIN, "Customer Lifetime Value", "currency", S,
           mean("CASE WHEN total_spend > 0 THEN total_spend END"), "total_spend > 0"),
    Metric("M-06_return_rate", MAIN, "Return Rate", "percentage", O, pct("returned")),
    Metric("M-07_omni_arrival_rate", OMNI, "Arrival Rate", "number", J,
           "try_divide(CAST(count(*) AS DOUBLE), max(arrival_time) - min(arrival_time))"),
    Metric("M-08_omni_conversion", OMNI, "Conversion Rate", "percentage", J, pct("completed")),
    Metric("M-09_omni_cart_abandon", OMNI, "Cart Abandonment Rate", "percentage", J, pct("abandoned")),
    Metric("M-10_omni_avg_journey", OMNI, "Avg Journey Time", "number", J, mean("total_journey_time")),
    Metric("M-11_omni_total_orders", OMNI, "Total Orders", "number", O, "count(*)"),
    Metric("M-12_omni_ontime", OMNI, "On-Time Delivery %", "percentage", O, pct("on_time")),
    Metric("M-13_omni_fulfillment_dur", OMNI, "Avg Fulfillment Duration", "number", O, mean("fulfillment_duration")),
    Metric("M-14_omni_payment_success", OMNI, "Payment Success Rate", "percentage", J,
           pct("NOT payment_failed", "completed OR payment_failed"), "completed OR payment_failed"),
    Metric("M-15_ce_active_rate", ENG, "Active Customer Rate", "percentage", S, pct("activity_state = 'active'")),
    Metric("M-16_ce_churn_rate", ENG, "Churn Rate", "percentage", S, pct("churned")),
    Metric("M-17_ce_open_rate", ENG, "Campaign Open Rate", "percentage", CI, pct("opened")),
    Metric("M-18_ce_campaign_ctr", ENG, "Campaign CTR", "percentage", CI, pct("clicked")),
    Metric("M-19_ce_enrollment_rate", ENG, "Loyalty Enrollment Rate", "percentage", "snapshot_enrollment",
           "try_divide(count_if(enrolled) * 1e2, count(*))"),
    Metric("M-20_ce_redemption_rate", ENG, "Points Redemption Rate", "percentage", PT,
           "try_divide(sum(CASE WHEN points_change < 0 THEN abs(points_change) ELSE 0 END) * 1e2,"
           " CAST(sum(CASE WHEN points_change > 0 THEN points_change ELSE 0 END) AS DOUBLE))"),
    Metric("M-21_ce_resolution_rate", ENG, "Ticket Resolution Rate", "percentage", ST, pct("status = 'resolved'")),
    Metric("M-22_ce_satisfaction", ENG, "Avg Satisfaction Rating", "number", ST, mean("satisfaction_rating"),
           "satisfaction_rating IS NOT NULL"),
    Metric("M-23_ir_qty_on_hand", STOCK, "Total Qty on Hand", "number", INV, "sum(quantity_on_hand)"),
    Metric("M-24_ir_below_reorder", STOCK, "Items Below Reorder Point", "number", INV,
           "count_if(quantity_on_hand <= reorder_point)"),
    Metric("M-25_ir_stockout_count", STOCK, "Stockout Count", "number", IE, "count_if(stockout_occurred)"),
    Metric("M-26_ir_fill_rate", STOCK, "Fill Rate", "percentage", IE,
           "(1D - try_divide(CAST(count_if(stockout_occurred) AS DOUBLE), count(*))) * 1e2"),
    Metric("M-27_ir_supplier_ontime", STOCK, "Supplier On-Time %", "percentage", SD, pct("on_time")),
    Metric("M-28_ir_avg_lead_time", STOCK, "Avg Lead Time", "number", SD, mean("actual_lead_time_days")),
    Metric("M-29_ir_turnover", STOCK, "Inventory Turnover", "number", IS,
           f"try_divide({mean('daily_demand')} * 365D, {mean('quantity_on_hand')})"),
    Metric("M-30_ir_shrinkage_rate", STOCK, "Shrinkage Rate", "percentage", IE,
           f"try_divide({_units('SHRINKAGE')} * 1e2, CAST({_units('SALE')} + {_units('SHRINKAGE')} AS DOUBLE))"),
    Metric("M-31_cr_total_reviews", REV, "Total Reviews", "number", CR, "count(*)"),
    Metric("M-32_cr_positive_pct", REV, "Positive Review Rate", "percentage", CR, pct(f"sentiment_category IN {POSITIVE}")),
    Metric("M-33_cr_negative_pct", REV, "Negative Review Rate", "percentage", CR, pct(f"sentiment_category IN {NEGATIVE}")),
    Metric("M-34_cr_avg_score", REV, "Average Sentiment Score", "number", CR, mean("sentiment_score"),
           "sentiment_score IS NOT NULL"),
    Metric("M-35_cr_needs_review", REV, "Needs Human Review", "number", CR,
           "count_if(status = 'Needing human review')", "status = 'Needing human review'"),
    Metric("M-36_cr_processed_pct", REV, "Processed", "percentage", CR, pct("status = 'processed for response'")),
)

# The same names with another formula.
VARIANTS = (
    Metric("M-37_arrival_rate_by_sim_hours", OMNI, "Arrival Rate", "number", J,
           "try_divide(CAST(count(*) AS DOUBLE), max(other))", extra=("hourly_demand", "max(hour_of_simulation)")),
    Metric("M-38_payment_success_payments", OMNI, "Payment Success Rate", "percentage", "payments",
           pct("status = 'authorized'")),
    Metric("M-39_enrollment_accounts", ENG, "Loyalty Enrollment Rate", "percentage", "loyalty_account",
           "try_divide(count(DISTINCT customer_id) * 1e2, max(other))", extra=(S, "count(DISTINCT customer_id)")),
    Metric("M-40_fill_rate_sales", STOCK, "Fill Rate", "percentage", IE,
           "(1D - try_divide(CAST(count_if(stockout_occurred) AS DOUBLE), count_if(event_type = 'SALE'))) * 1e2"),
    Metric("M-41_turnover_total", STOCK, "Inventory Turnover", "number", IS,
           f"CASE WHEN {mean('quantity_on_hand')} > 0 THEN try_divide(sum(daily_demand) * 365D,"
           f" {mean('quantity_on_hand')}) ELSE 0D END"),
    Metric("M-42_shrinkage_vs_stock", STOCK, "Shrinkage Rate", "percentage", IE,
           f"try_divide({_units('SHRINKAGE')} * 1e2, CAST(max(other) AS DOUBLE))", extra=(INV, "sum(quantity_on_hand)")),
    Metric("M-43_response_rate", REV, "Chatbot Response Rate", "percentage", CR, pct("chatbot_statement IS NOT NULL")),
)

METRICS = {m.key: m for m in DASHBOARD + VARIANTS}
TABS = (MAIN, OMNI, ENG, STOCK, REV)

# The cross-tab health check: name -> metric.
HEALTH = {
    "revenue": "M-01_revenue",
    "total_customers": "M-02_customers",
    "conversion_rate": "M-03_conversion",
    "total_orders": "M-11_omni_total_orders",
    "ontime_delivery": "M-12_omni_ontime",
    "avg_fulfillment": "M-13_omni_fulfillment_dur",
    "active_rate": "M-15_ce_active_rate",
    "churn_rate": "M-16_ce_churn_rate",
    "fill_rate": "M-40_fill_rate_sales",
    "stockout_count": "M-25_ir_stockout_count",
    "supplier_ontime": "M-27_ir_supplier_ontime",
}


def source(t, m: Metric) -> DataFrame:
    """Rows a metric aggregates. Enrolment needs one row per customer: accounts are matched by a
    left join of distinct ids, which replaces two distinct counts over the joined rows."""
    if m.table == "snapshot_enrollment":
        people = t[S].select("customer_id").filter("customer_id IS NOT NULL").distinct()
        accounts = t["loyalty_account"].select("customer_id").distinct().withColumn("__has", F.lit(True))
        return people.join(accounts, "customer_id", "left").select(F.coalesce("__has", F.lit(False)).alias("enrolled"))
    rows = t[m.table]
    if m.extra:
        table, aggregate = m.extra
        rows = rows.withColumn("other", only_value(t[table].agg(F.expr(aggregate))))
    return rows


def scalar(t, key: str) -> DataFrame:
    """One KPI on its own, as a single row."""
    m = METRICS[key]
    rows = source(t, m)
    if m.where:
        rows = rows.filter(m.where)
    return rows.agg(F.expr(m.value).cast("double").alias("value"))


def together(t, metrics: list[Metric]) -> DataFrame:
    """Many KPIs as rows (key, value): one pass per table, whatever the number of KPIs."""
    groups: dict[tuple, list[Metric]] = {}
    for m in metrics:
        groups.setdefault((m.table, m.extra), []).append(m)
    parts = []
    for members in groups.values():
        one = source(t, members[0]).agg(*[F.expr(m.value).cast("double").alias(m.key) for m in members])
        parts.append(one.unpivot([], [m.key for m in members], "key", "value"))
    return reduce(DataFrame.unionByName, parts)


def tab_summary(t, tab: str) -> DataFrame:
    """All KPIs of a tab as (metric_id, label, value, format)."""
    chosen = [m for m in DASHBOARD if m.tab == tab]
    return _described(together(t, chosen), {m.key: m for m in chosen})


def _described(values: DataFrame, by_key: dict[str, Metric]) -> DataFrame:
    def lookup(text) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, m in by_key.items() for x in (k, text(m))]), F.col("key"))

    return values.select(
        F.col("key").alias("metric_id"),
        lookup(lambda m: m.label).alias("label"),
        "value",
        lookup(lambda m: m.format).alias("format"),
    )


def health_check(t) -> DataFrame:
    names = F.create_map(*[F.lit(x) for name, key in HEALTH.items() for x in (key, name)])
    values = together(t, [METRICS[key] for key in HEALTH.values()])
    return values.select(F.element_at(names, F.col("key")).alias("check_name"), "value")


def trend(snapshots: DataFrame) -> DataFrame:
    """Change of each metric against the run before: (metric_id, run, value) in, direction out."""
    moved = ordered.previous_value(snapshots, ["metric_id"], ["run"], "value", "previous")
    value, previous = F.col("value"), F.col("previous")
    change = F.when(previous == 0, 0.0).otherwise(F.abs(F.try_divide((value - previous) * 100.0, previous)))
    return moved.select(
        "metric_id",
        "run",
        "value",
        "previous",
        F.coalesce(change, F.lit(0.0)).alias("change_percent"),
        F.when(value > previous, "up").when(value < previous, "down").otherwise("neutral").alias("trend"),
    )


def hourly_snapshots(t) -> DataFrame:
    """Metric history to follow: sales figures of every simulation hour."""
    per_hour = t["hourly_demand"].groupBy(F.col("hour_of_simulation").cast("int").alias("run")).agg(
        F.sum("arrival_count").cast("double").alias("arrivals"),
        F.sum("order_count").cast("double").alias("orders"),
        exact_total("revenue").alias("revenue"),
    )
    return per_hour.unpivot(["run"], ["arrivals", "orders", "revenue"], "metric_id", "value")
