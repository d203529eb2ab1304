"""Event-time versions of the hourly demand, the daily stock snapshot and the stock alerts.

Windows come in two forms. `hourly_demand` and `daily_snapshot` keep state up to a watermark and drop what is later. A window store
keeps partial counts, sums and last values per window and micro-batch instead: parts merge by key in any order, so a row counts however
late it comes, no state grows, and a repeated batch overwrites its own part.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.functions.exprs import count_rows, exact_parts, joined_parts, mean, total

SIMULATION_START = "2024-01-01 00:00:00"
STOCK_START = "1995-01-01 00:00:00"


def with_event_time(df: DataFrame, clock: str, unit: str, start: str, out: str = "event_ts") -> DataFrame:
    """Simulation clock as a TIMESTAMP (watermarks do not accept TIMESTAMP_NTZ)."""
    seconds = F.col(clock) * {"minutes": 60, "hours": 3600}[unit]
    begin = F.unix_timestamp(F.to_timestamp(F.lit(start)))
    return df.withColumn(out, F.timestamp_seconds(begin + seconds))


def hourly_demand(journeys: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Arrivals, orders, revenue and abandonments by tumbling hour and channel; rows later than the
    watermark are dropped."""
    done = F.col("completed")
    timed = with_event_time(journeys, "arrival_time", "minutes", SIMULATION_START)
    grouped = timed.withWatermark("event_ts", delay).groupBy(F.window("event_ts", "1 hour").alias("w"), "channel").agg(
        count_rows().alias("arrival_count"),
        F.count_if(done).alias("order_count"),
        F.coalesce(total(F.when(done, F.col("total_amount"))), F.lit(0.0)).alias("revenue"),
        F.count_if("abandoned").alias("abandonment_count"),
        F.coalesce(mean(F.when(done & (F.col("basket_size") > 0), F.col("basket_size"))), F.lit(0.0)).alias("avg_basket_size"),
    )
    return grouped.withColumn("window_start", F.col("w.start")).drop("w")


def daily_snapshot(events: DataFrame, tie_break: tuple[str, ...] = (), delay: str = "2 days") -> DataFrame:
    """Demand, receipts, hours out of stock and closing level by day, SKU and location."""
    timed = with_event_time(events, "event_time", "hours", STOCK_START)
    kind, change = F.col("event_type"), F.col("quantity_change")
    grouped = timed.withWatermark("event_ts", delay).groupBy(F.window("event_ts", "1 day").alias("w"), "sku", "location").agg(
        F.coalesce(F.sum(F.when(kind == "SALE", F.abs(change))), F.lit(0)).alias("daily_demand"),
        F.coalesce(F.sum(F.when(kind == "RECEIPT", change)), F.lit(0)).alias("daily_receipts"),
        F.count_if(F.col("quantity_after") <= 0).alias("stockout_hours"),
        F.max_by("quantity_after", F.struct("event_time", *tie_break)).alias("quantity_on_hand"),
    )
    return grouped.withColumn("window_start", F.col("w.start")).drop("w")


class WindowStore(NamedTuple):
    """How windows are kept: `partial` makes parts of a batch, `merge` makes one part of several, `finish` the figures of a part."""

    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def hourly_store() -> WindowStore:
    """Arrivals, orders, revenue and abandonments by tumbling hour and channel."""
    keys = ("window_start", "channel")
    revenue = ("revenue_whole", "revenue_part", "revenue_rest")
    sums = ("arrival_count", "order_count", *revenue, "abandonment_count", "basket_sum", "baskets")

    def partial(batch: DataFrame) -> DataFrame:
        done = F.col("completed")
        basket = F.when(done & (F.col("basket_size") > 0), F.col("basket_size"))
        amounts = zip(exact_parts(F.when(done, F.col("total_amount"))), revenue, strict=True)
        timed = with_event_time(batch, "arrival_time", "minutes", SIMULATION_START)
        return timed.groupBy(F.window("event_ts", "1 hour").start.alias("window_start"), "channel").agg(
            count_rows().alias("arrival_count"), F.count_if(done).alias("order_count"),
            *(F.sum(part).alias(name) for part, name in amounts), F.count_if("abandoned").alias("abandonment_count"),
            F.sum(basket.cast("bigint")).alias("basket_sum"), F.count(basket).alias("baskets"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    def finish(merged: DataFrame) -> DataFrame:
        basket = F.try_divide(F.col("basket_sum").cast("double"), F.col("baskets").cast("double"))
        amount = joined_parts([F.col(c) for c in revenue])
        return merged.select(
            "channel", "arrival_count", "order_count", F.coalesce(amount, F.lit(0.0)).alias("revenue"),
            "abandonment_count", F.coalesce(basket, F.lit(0.0)).alias("avg_basket_size"), "window_start")

    return WindowStore(keys, partial, merge, finish)


def daily_store(tie_break: tuple[str, ...] = ()) -> WindowStore:
    """Demand, receipts, hours out of stock and closing level by day, SKU and location."""
    keys = ("window_start", "sku", "location")

    def partial(batch: DataFrame) -> DataFrame:
        timed = with_event_time(batch, "event_time", "hours", STOCK_START)
        kind, change, at = F.col("event_type"), F.col("quantity_change"), F.struct("event_time", *tie_break)
        return timed.groupBy(F.window("event_ts", "1 day").start.alias("window_start"), "sku", "location").agg(
            F.sum(F.when(kind == "SALE", F.abs(change))).alias("daily_demand"), F.sum(F.when(kind == "RECEIPT", change)).alias("daily_receipts"),
            F.count_if(F.col("quantity_after") <= 0).alias("stockout_hours"), F.max_by("quantity_after", at).alias("quantity_on_hand"),
            F.max(at).alias("last_at"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(
            *(F.sum(c).alias(c) for c in ("daily_demand", "daily_receipts", "stockout_hours")),
            F.max_by("quantity_on_hand", "last_at").alias("quantity_on_hand"), F.max("last_at").alias("last_at"))

    def finish(merged: DataFrame) -> DataFrame:
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("daily_demand", "daily_receipts")}
        return merged.withColumns(zero).drop("last_at")

    return WindowStore(keys, partial, merge, finish)


def record_windows(stream: DataFrame, store: WindowStore, log: str, checkpoint: str):
    """Write the parts of each micro-batch under its number; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.partial(batch).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_windows(spark: SparkSession, store: WindowStore, log: str) -> DataFrame:
    """The figures of all windows so far."""
    return store.finish(store.merge(spark.read.option("basePath", log).parquet(log).drop("batch_id")))


def low_stock_alerts(events: DataFrame, policy: DataFrame) -> DataFrame:
    """Alerts on movements that leave the stock at or below the reorder point, or empty. The policy is
    a static table: each micro-batch joins it without state."""
    rules = policy.select(
        "sku", F.col("location_id").alias("location"), F.col("reorder_point").alias("policy_point"), "order_quantity", "supplier_id")
    joined = events.join(rules, ["sku", "location"])
    alert = F.when(F.col("quantity_after") <= 0, "stockout_occurred").when(
        F.col("quantity_after") <= F.col("policy_point"), "low_stock_alert")
    return joined.withColumn("alert", alert).filter("alert IS NOT NULL").select(
        "event_id", "sku", "location", "event_time", "quantity_after", "policy_point", "order_quantity", "supplier_id", "alert")
