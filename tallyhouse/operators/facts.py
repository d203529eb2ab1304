"""Fact-table builders: raw operational records in, one analytic row per subject out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import ordered
from tallyhouse.functions.exprs import count_rows, day_of_week, hour_of_day, int_sum, mean, only_row, pct, to_places, total

# Replenishment defaults for a product without a policy.
POLICY_DEFAULTS = {"reorder_point": 50, "order_quantity": 100, "safety_stock": 20, "lead_time_days": 7.0}
ON_TIME_SLACK = 1.1


def time_features(df: DataFrame, t: str, unit: str, hour: str = "hour", day: str = "day_of_week") -> DataFrame:
    """Hour of day and day of week of a simulation clock in minutes or hours; day 0 is the first day."""
    return df.withColumn(hour, hour_of_day(t, unit)).withColumn(day, day_of_week(t, unit))


def _latest(event_type: str, *fields: str) -> Column:
    """Fields of the latest event of a type as one struct; rows of other types have no order and drop out."""
    return F.max_by(F.struct(*fields), F.when(F.col("event_type") == event_type, F.col("event_time")))


def _happened(event_type: str) -> Column:
    return F.coalesce(F.bool_or(F.col("event_type") == event_type), F.lit(False))


def journeys(steps: DataFrame) -> DataFrame:
    """Fold lifecycle events to one row per visit (a conditional pivot with map-side combine)."""
    folded = steps.groupBy("journey_id").agg(
        _latest("arrival", "scenario_id", "customer_id", "channel", "event_time").alias("arrived"),
        _latest("browsed", "duration", "quantity").alias("browsed"),
        _latest("queued", "duration").alias("queued"),
        _latest("checked_out", "duration", "amount").alias("paid"),
        _latest("abandoned", "reason").alias("left"),
        _latest("completed", "order_id", "event_time").alias("bought"),
        _happened("payment_failed").alias("payment_failed"),
    )
    zero = F.lit(0.0)
    arrival, completed = F.col("arrived.event_time"), F.col("bought").isNotNull()
    spent = F.when(completed, to_places(F.col("bought.event_time") - arrival)).otherwise(zero)
    rows = folded.select(
        "journey_id",
        "arrived.scenario_id",
        "arrived.customer_id",
        "arrived.channel",
        arrival.alias("arrival_time"),
        F.coalesce("browsed.duration", zero).alias("browsing_duration"),
        F.coalesce("browsed.quantity", F.lit(0)).alias("basket_size"),
        F.coalesce("queued.duration", zero).alias("queue_wait_time"),
        F.coalesce("paid.duration", zero).alias("checkout_time"),
        F.coalesce("paid.amount", zero).alias("total_amount"),
        F.col("left").isNotNull().alias("abandoned"),
        F.col("left.reason").alias("abandonment_reason"),
        "payment_failed",
        completed.alias("completed"),
        "bought.order_id",
        spent.alias("total_journey_time"),
    )
    return time_features(rows, "arrival_time", "minutes", "arrival_hour")


def order_metrics(events: DataFrame) -> DataFrame:
    """One row per order from its lifecycle events; the latest event of a kind wins."""
    folded = events.groupBy("order_id").agg(
        _latest("created", "scenario_id", "channel", "event_time").alias("created"),
        F.max(F.when(F.col("event_type") == "fulfillment_started", F.col("event_time"))).alias("fulfillment_start_time"),
        _latest("fulfilled", "event_time", "deadline").alias("done"),
        _happened("returned").alias("returned"),
    )
    complete = F.col("done.event_time")
    rows = folded.select(
        "order_id",
        "created.scenario_id",
        "created.channel",
        F.col("created.event_time").alias("order_time"),
        "fulfillment_start_time",
        complete.alias("fulfillment_complete_time"),
        (complete - F.col("fulfillment_start_time")).alias("fulfillment_duration"),
        (complete <= F.col("done.deadline")).alias("on_time"),
        "returned",
    )
    return time_features(rows, "order_time", "minutes", "order_hour")


def inventory_events(
    movements: DataFrame, policy: DataFrame, opening_stock: int = 60, tie_break: tuple[str, ...] = (), position: str | None = None
) -> DataFrame:
    """Stock before and after each movement, with the policy of its SKU and location.

    The running total follows time within (sku, location); ``position`` names a column for the movement's number in that order.
    """
    order = ["event_time", *tie_break]
    levels = policy.select(
        "sku", F.col("location_id").alias("location"), F.col("reorder_point"), F.col("safety_stock")
    )
    sums = {"__moved": "quantity_change"} | ({position: "__one"} if position else {})
    moved = ordered.running_sums(movements.withColumn("__one", F.lit(1)), ["sku", "location"], order, sums, levels)
    after = (F.col("__moved") + F.lit(opening_stock)).cast("int")
    stocked = (
        moved.withColumn("quantity_after", after)
        .withColumn("quantity_before", F.col("quantity_after") - F.col("quantity_change"))
        .withColumn("reorder_point", F.coalesce("reorder_point", F.lit(0)))
        .withColumn("safety_stock", F.coalesce("safety_stock", F.lit(0)))
        .withColumn("stockout_occurred", F.col("quantity_after") <= 0)
        .drop("__moved", "__one")
    )
    return time_features(stocked, "event_time", "hours", "event_hour")


def hourly_demand(journeys_df: DataFrame) -> DataFrame:
    """Arrivals, orders, revenue, mean basket and abandonments by scenario, hour and channel."""
    done, basket = F.col("completed"), F.col("basket_size")
    hour = F.floor(F.col("arrival_time") / 60)
    grouped = journeys_df.groupBy("scenario_id", hour.alias("__hour"), "channel").agg(
        count_rows().cast("int").alias("arrival_count"),
        F.count_if(done).cast("int").alias("order_count"),
        F.coalesce(total(F.when(done, F.col("total_amount"))), F.lit(0.0)).alias("revenue"),
        F.count_if("abandoned").cast("int").alias("abandonment_count"),
        F.coalesce(mean(F.when(done & (basket > 0), basket)), F.lit(0.0)).alias("avg_basket_size"),
    )
    return grouped.select(
        F.concat_ws("_", "scenario_id", F.col("__hour").cast("string"), "channel").alias("id"),
        "scenario_id",
        F.col("__hour").cast("double").alias("hour_of_simulation"),
        (F.col("__hour") % 24).cast("int").alias("hour_of_day"),
        (F.floor(F.col("__hour") / 24) % 7).cast("int").alias("day_of_week"),
        "channel",
        "arrival_count",
        "order_count",
        "revenue",
        "abandonment_count",
        "avg_basket_size",
    )


def inventory_snapshots(events: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One row per SKU, location and day: demand, receipts, hours out of stock, closing levels.

    Most groups are one row, so the rows are exchanged before they are grouped: no task holds more groups than it can.
    """
    kind, change = F.col("event_type"), F.col("quantity_change")
    at = F.struct("event_time", *tie_break)
    keys = ("scenario_id", "sku", "location", "snapshot_day")
    needed = ("event_type", "quantity_change", "quantity_after", "on_order_qty", "reorder_point", "event_time")
    days = events.withColumn("snapshot_day", F.floor(F.col("event_time") / 24).cast("int")).select(*keys, *dict.fromkeys((*needed, *tie_break)))
    grouped = days.repartition(ordered.tasks(events.count()), *keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(kind == "SALE", F.abs(change))), F.lit(0)).cast("int").alias("daily_demand"),
        F.coalesce(F.sum(F.when(kind == "RECEIPT", change)), F.lit(0)).cast("int").alias("daily_receipts"),
        F.count_if(F.col("quantity_after") <= 0).cast("double").alias("stockout_hours"),
        F.max_by(F.struct("quantity_after", "on_order_qty"), at).alias("__closing"),
        F.bool_or(
            (kind == "SALE") & (F.col("reorder_point") > 0) & (F.col("quantity_after") <= F.col("reorder_point"))
        ).alias("reorder_triggered"),
    )
    key = F.concat_ws("_", "scenario_id", *[F.col(c).cast("string") for c in ("sku", "location", "snapshot_day")])
    closing = {"quantity_on_hand": F.col("__closing.quantity_after"), "quantity_on_order": F.col("__closing.on_order_qty")}
    return grouped.withColumns({**closing, "snapshot_id": key}).drop("__closing")


def supplier_deliveries(purchase_orders: DataFrame) -> DataFrame:
    """Lead time and delivery flags of purchase orders; NULL until an order is RECEIVED."""
    received = F.col("po_status") == "RECEIVED"
    lead = (F.col("actual_delivery_time") - F.col("order_time")) / 24.0
    return (
        purchase_orders.withColumn("actual_lead_time_days", F.when(received, lead))
        .withColumn("actual_delivery_time", F.when(received, F.col("actual_delivery_time")))
        .withColumn("received_quantity", F.when(received, F.col("received_quantity")).otherwise(0))
        .withColumn(
            "on_time", F.when(received, lead <= F.col("expected_lead_time_days") * F.lit(ON_TIME_SLACK))
        )
        .withColumn(
            "short_shipped", F.when(received, F.col("received_quantity") < F.col("order_quantity"))
        )
    )


def reorder_triggers(positions: DataFrame, policy: DataFrame) -> DataFrame:
    """Stock positions at or below their reorder point, with the order to place."""
    rules = policy.select("sku", "location_id", "supplier_id", "reorder_point", "order_quantity", "safety_stock")
    return (
        positions.select("sku", "location_id", F.col("quantity_on_hand").alias("current_stock"))
        .join(rules, ["sku", "location_id"])
        .filter(F.col("current_stock") <= F.col("reorder_point"))
        .withColumn("alert", F.lit("low_stock_alert"))
    )


def fifo_backorders(queue: DataFrame, stock: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Serve waiting orders in time order while the stock lasts; the first that does not fit stops the
    queue of its SKU and location, so a running total up to the stock is exactly what gets served."""
    levels = stock.select("sku", "location_id", F.col("quantity_on_hand").alias("available"))
    waiting = ordered.running_sums(queue, ["sku", "location_id"], ["queued_at", *tie_break], {"needed": "quantity"}, levels, "inner")
    return waiting.withColumn("served", F.col("needed") <= F.col("available"))


def workflow_rollup(journeys_df: DataFrame, orders: DataFrame, stockouts: DataFrame) -> DataFrame:
    """Run summary in one row: two aggregation passes and the lost sales."""
    done = F.col("completed")

    def done_mean(c: str, positive: bool = False) -> Column:
        kept = done & (F.col(c) > 0) if positive else done
        return F.coalesce(mean(F.when(kept, F.col(c))), F.lit(0.0))

    zero = F.lit(0.0)
    visits = journeys_df.agg(
        count_rows().alias("total_customers"),
        F.count_if(done).alias("completed_purchases"),
        F.count_if("abandoned").alias("abandoned_carts"),
        F.count_if("payment_failed").alias("payment_failures"),
        done_mean("browsing_duration").alias("avg_browsing_time"),
        done_mean("queue_wait_time", positive=True).alias("avg_queue_wait_time"),
        done_mean("checkout_time").alias("avg_checkout_time"),
        F.coalesce(F.max(F.when(F.col("queue_wait_time") > 0, F.col("queue_wait_time"))), zero).alias(
            "max_queue_wait_time"
        ),
        done_mean("basket_size", positive=True).alias("avg_basket_size"),
        F.coalesce(total(F.when(done, F.col("total_amount"))), zero).alias("total_revenue"),
        F.coalesce(mean(F.when(done, F.col("total_amount"))), zero).alias("avg_order_value"),
        F.coalesce(pct(done), zero).alias("conversion_rate"),
        *[
            F.count_if(F.col("channel") == name).alias(f"customers_{name}")
            for name in ("online", "in_store", "bopis")
        ],
    )
    fulfilled = F.col("fulfillment_complete_time").isNotNull()
    placed = orders.agg(
        count_rows().alias("total_orders"),
        F.coalesce(mean(F.when(fulfilled, F.col("fulfillment_duration"))), zero).alias("avg_fulfillment_time"),
        F.count_if(fulfilled & F.col("on_time")).alias("on_time_orders"),
        F.count_if(fulfilled & ~F.col("on_time")).alias("late_orders"),
        F.coalesce(
            F.try_divide(F.count_if(fulfilled & F.col("on_time")) * F.lit(100.0), F.count_if(fulfilled)), zero
        ).alias("on_time_percentage"),
        F.count_if("returned").alias("total_returns"),
        F.coalesce(pct("returned"), zero).alias("return_rate"),
        *[F.count_if(F.col("channel") == name).alias(f"orders_{name}") for name in ("online", "in_store", "bopis")],
    )
    rows = visits.withColumn("__placed", only_row(placed)).withColumn("__lost", only_row(lost_sales(stockouts)))
    return rows.select(*visits.columns, "__placed.*", "__lost.*")


def lost_sales(stockouts: DataFrame) -> DataFrame:
    return stockouts.agg(
        count_rows().alias("total_stockouts"),
        F.coalesce(int_sum(F.col("requested") - F.col("available")), F.lit(0)).alias("lost_sales"),
    )


def supplier_performance(suppliers: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries, on-time share and mean lead time; a supplier without deliveries keeps its listed lead time."""
    received = deliveries.filter(F.col("po_status") == "RECEIVED")
    per = received.groupBy("supplier_id").agg(
        count_rows().alias("total_orders"),
        F.try_divide(F.count_if("on_time").cast("double"), count_rows()).alias("on_time_rate"),
        mean("actual_lead_time_days").alias("avg_lead_time"),
    )
    return suppliers.join(per, "supplier_id", "left").select(
        "supplier_id",
        "name",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("on_time_rate", F.lit(0.0)).alias("on_time_rate"),
        F.coalesce("avg_lead_time", F.col("mean_lead_time_days")).alias("avg_lead_time"),
    )


def apply_stock_deltas(inventory: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the summed changes of each SKU and location to its stock row."""
    summed = deltas.groupBy("sku", "location_id").agg(
        int_sum("on_hand_delta").alias("__h"), int_sum("reserved_delta").alias("__r"), int_sum("on_order_delta").alias("__o")
    )
    def moved(c: str, d: str) -> Column:
        return (F.col(c) + F.coalesce(d, F.lit(0))).cast("int").alias(c)

    return inventory.join(summed, ["sku", "location_id"], "left").select(
        "sku",
        "location_id",
        moved("quantity_on_hand", "__h"),
        moved("quantity_reserved", "__r"),
        moved("on_order_qty", "__o"),
        "reorder_point",
    )


def counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("metric").agg(total("value").alias("value"))


ITEM_SCHEMA = "array<struct<sku:bigint,qty:int,price:double>>"


def active_cart_items(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Items of active carts, priced from the catalogue when the cart has no price; unknown SKUs drop out."""
    items = carts.filter(F.col("status") == "active").select(
        "cart_id", "customer_id", F.explode(F.from_json("items", ITEM_SCHEMA)).alias("item")
    )
    items = items.select(
        "cart_id",
        "customer_id",
        F.col("item.sku").alias("sku"),
        F.coalesce("item.qty", F.lit(1)).alias("quantity"),
        F.col("item.price").alias("__own"),
    )
    listed = products.select("sku", F.col("price").alias("__list"))
    return items.join(listed, "sku").select(
        "cart_id", "customer_id", "sku", "quantity", F.coalesce("__own", "__list").alias("unit_price")
    )


def products_with_policy(products: DataFrame, policy: DataFrame) -> DataFrame:
    """Products with each of their policies; a missing or zero value takes the default."""

    def or_default(c: str) -> Column:
        return F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(POLICY_DEFAULTS[c])).alias(c)

    rules = policy.select("sku", "location_id", "supplier_id", *POLICY_DEFAULTS)
    return (
        products.filter(F.col("sku").isNotNull())
        .select("sku", "name")
        .join(rules, "sku", "left")
        .select("sku", "name", "location_id", "supplier_id", *[or_default(c) for c in POLICY_DEFAULTS])
    )


def engagement_events(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Engagement events with the segment, spend, points and risk of their customer."""
    profile = snapshots.select(
        "customer_id",
        "value_tier",
        "activity_state",
        "days_since_last_purchase",
        "total_spend",
        "purchase_count",
        "loyalty_points",
        "churn_risk_score",
    )
    return time_features(events.join(profile, "customer_id"), "event_time", "hours", "event_hour")


def state_update(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest value per order of each status column; a column without an update keeps its value."""
    columns = ("status", "payment_status", "fulfillment_status")
    latest = updates.groupBy("order_id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", c))).alias(f"__{c}")
            for c in columns
        ]
    )
    others = [c for c in orders.columns if c not in columns]
    return orders.join(latest, "order_id", "left").select(
        *others, *[F.coalesce(f"__{c}", c).alias(c) for c in columns]
    )
