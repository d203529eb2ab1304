"""Customer analytics: purchase history, segments, scores, loyalty and campaign results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import ordered, selection
from tallyhouse.functions.exprs import (
    activity_state,
    churn_risk,
    count_rows,
    int_sum,
    mean,
    only_value,
    pct,
    ratio,
    rfm_segment,
    total,
    value_tier,
)

LOYALTY_SHARE_OF_SPEND = 0.1
POINTS_PER_UNIT_SPEND = 1.0


def purchase_history(history: DataFrame) -> DataFrame:
    """Last purchase, distinct orders, spend and mean line per customer."""
    return history.groupBy("customer_id").agg(
        F.max("purchase_date").alias("last_purchase_date"),
        F.count_distinct("order_id").alias("purchase_count"),
        total("line_total").alias("total_spend"),
        mean("line_total").alias("avg_line_value"),
    )


def top_customers(snapshots: DataFrame, n: int = 5) -> DataFrame:
    return (
        snapshots.select("customer_id", "total_spend", "purchase_count", "loyalty_points")
        .orderBy(F.desc_nulls_last("total_spend"), "customer_id")
        .limit(n)
    )


def recommendations(customers: DataFrame, products: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``k`` products per customer from the preferred categories, topped up from the whole catalogue.

    Products get a position within their category and within the catalogue; a customer's seeded
    start picks k consecutive positions. Each pick is an equi-join on (category, position), so a
    customer costs k rows whatever the size of the catalogue.
    """
    by_category = ordered.row_numbers(products.select("sku", "category"), ["category"], ["sku"], "position")
    overall = ordered.row_numbers(products.select("sku", "category"), [], ["sku"], "position")
    sizes = products.groupBy("category").agg(count_rows().alias("__size"))
    everything = products.agg(count_rows().alias("__size"))
    start = F.col("customer_id").cast("decimal(38,0)") * F.lit(7919) + F.lit(seed)

    def picks(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    liked = picks(customers.select("customer_id", F.explode("preferred_categories").alias("category")))
    liked = (
        liked.join(sizes, "category")
        .filter(F.col("slot") < F.col("__size"))
        .withColumn("position", F.pmod(start + F.col("slot"), F.col("__size")).cast("bigint") + 1)
        .join(by_category, ["category", "position"])
        .select("customer_id", "sku", F.lit(0).alias("source"), "slot")
    )
    # 2k positions of the catalogue leave k unseen ones even if k of them are liked already.
    filler = customers.select("customer_id", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("slot"))
    filler = (
        filler.withColumn("__size", only_value(everything))
        .filter(F.col("slot") < F.col("__size"))
        .withColumn("position", F.pmod(start + F.col("slot"), F.col("__size")).cast("bigint") + 1)
        .join(overall.drop("category"), "position")
        .select("customer_id", "sku", F.lit(1).alias("source"), "slot")
    )
    best = liked.unionByName(filler).groupBy("customer_id", "sku").agg(
        F.min(F.struct("source", "slot")).alias("__at")
    )
    ranked = ordered.top_n(
        best.select("customer_id", "sku", "__at.source", "__at.slot"), ["customer_id"], ["source", "slot", "sku"], k
    )
    return ranked.groupBy("customer_id").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("sku"))).alias(f"sku_rank_{i}") for i in range(1, k + 1)]
    )


def purchase_points(history: DataFrame, rate: float = POINTS_PER_UNIT_SPEND) -> DataFrame:
    """One ledger row per order: whole points of the amount paid."""
    spent = history.groupBy("customer_id", "order_id").agg(
        total("line_total").alias("amount"), F.max("purchase_date").alias("transaction_date")
    )
    return spent.withColumn("points_change", F.floor(F.col("amount") * F.lit(rate)).cast("int"))


def loyalty_ledger(transactions: DataFrame) -> DataFrame:
    """Transactions with the running balance of their customer."""
    return ordered.running_sum(
        transactions,
        ["customer_id"],
        ["transaction_date", "transaction_id"],
        "points_change",
        "balance",
    )


def customer_snapshots(customers: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """One row per customer as of a date: spend, recency, segments, churn risk."""
    stats = purchase_history(history).drop("avg_line_value")
    base = customers.join(stats, "customer_id", "left")
    day = F.to_date(F.lit(as_of))
    days = F.datediff(day, F.to_date("last_purchase_date"))
    tenure = F.datediff(day, F.to_date("join_date"))
    spend = F.coalesce("total_spend", F.lit(0.0))
    bought = F.coalesce("purchase_count", F.lit(0)).cast("int")
    snapshot = (
        base.withColumn("total_spend", spend)
        .withColumn("purchase_count", bought)
        .withColumn("__days", days)
        .withColumn("days_since_last_purchase", F.coalesce(F.col("__days"), F.lit(999)).cast("double"))
        .withColumn("days_since_join", tenure.cast("double"))
        .withColumn("avg_order_value", F.coalesce(ratio("total_spend", "purchase_count"), F.lit(0.0)))
        .withColumn("loyalty_points", F.floor(F.col("total_spend") * F.lit(LOYALTY_SHARE_OF_SPEND)).cast("int"))
        .withColumn("activity_state", activity_state("days_since_last_purchase"))
        .withColumn("value_tier", value_tier("total_spend"))
        .withColumn("rfm_segment", rfm_segment("__days", "purchase_count", "total_spend"))
        .withColumn("churn_risk_score", churn_risk("__days", "unresponsive_count", "value_tier"))
        .withColumn("churned", F.col("activity_state") == "churned")
        .withColumn(
            "snapshot_id", F.concat_ws("_", "scenario_id", F.col("customer_id").cast("string"))
        )
    )
    return snapshot.select(
        "snapshot_id",
        "scenario_id",
        "customer_id",
        "activity_state",
        "value_tier",
        "rfm_segment",
        "total_spend",
        "purchase_count",
        "avg_order_value",
        "days_since_last_purchase",
        "days_since_join",
        "loyalty_points",
        "unresponsive_count",
        "churn_risk_score",
        "churned",
        "last_purchase_date",
    )


def loyalty_account(transactions: DataFrame, subtract_redemptions: bool = False) -> DataFrame:
    """Points of each customer. Redemptions leave the balance alone unless asked otherwise."""
    earned = int_sum(F.greatest(F.lit(0), F.col("points_change")))
    current = int_sum("points_change") if subtract_redemptions else earned
    points = transactions.groupBy("customer_id").agg(
        current.alias("current_points"), earned.alias("lifetime_points")
    )
    return points.withColumn("tier", value_tier("lifetime_points", "dynamic"))


def _counts(df: DataFrame, group: str, c: str) -> DataFrame:
    return df.groupBy(F.col(c).alias("name")).agg(count_rows().cast("double").alias("value")).select(
        F.lit(group).alias("section"), "name", "value"
    )


def engagement_summary(snapshots: DataFrame, campaigns: DataFrame, tickets: DataFrame) -> DataFrame:
    """Counts by state, segment and tier plus the campaign, retention and service rates."""

    def rate(df: DataFrame, section: str, **values: Column) -> DataFrame:
        one = df.agg(*[F.coalesce(v, F.lit(0.0)).cast("double").alias(n) for n, v in values.items()])
        return one.unpivot([], list(values), "name", "value").select(F.lit(section).alias("section"), "name", "value")

    size = only_value(snapshots.agg(count_rows()))
    segments = _counts(snapshots, "segment_pct", "rfm_segment").withColumn("__all", size)
    segments = segments.select("section", "name", F.try_divide(F.col("value") * 100.0, F.col("__all")).alias("value"))
    resolved = F.col("status") == "resolved"
    parts = [
        _counts(snapshots, "state", "activity_state"),
        _counts(snapshots, "segment", "rfm_segment"),
        segments,
        _counts(snapshots, "tier", "value_tier"),
        rate(
            campaigns,
            "campaign",
            sent=count_rows(),
            opened=F.count_if("opened"),
            clicked=F.count_if("clicked"),
            open_rate=pct("opened"),
            click_rate=pct("clicked"),
        ),
        rate(snapshots, "retention", churned=F.count_if("churned"), retention_rate=pct(~F.col("churned"))),
        rate(
            tickets,
            "service",
            created=count_rows(),
            resolved=F.count_if(resolved),
            satisfied=F.count_if(F.col("satisfaction_rating") >= 4),
            satisfaction_rate=F.try_divide(
                F.count_if(F.col("satisfaction_rating") >= 4) * F.lit(100.0), F.count_if(resolved)
            ),
        ),
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return summary


def campaign_audience(snapshots: DataFrame, preferences: DataFrame, segment: str) -> DataFrame:
    willing = preferences.filter("marketing_opt_in").select("customer_id")
    return snapshots.filter(F.col("rfm_segment") == segment).join(willing, "customer_id", "left_semi").select(
        "customer_id", "rfm_segment", "value_tier", "unresponsive_count"
    )


def campaign_interactions(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Open, click and conversion flags of each customer and campaign, from their events.

    A customer's days since the last engagement count back from the last event of the campaign.
    """
    kind = F.col("event_type")
    grouped = events.groupBy("customer_id", "campaign_id", "campaign_type").agg(
        F.min("event_time").alias("send_time"),
        count_rows().alias("events"),
        F.coalesce(F.bool_or(kind.isin("view", "click", "purchase")), F.lit(False)).alias("opened"),
        F.coalesce(F.bool_or(kind.isin("click", "purchase")), F.lit(False)).alias("clicked"),
        F.coalesce(F.bool_or(kind == "purchase"), F.lit(False)).alias("converted"),
        F.max("event_time").alias("__last"),
        F.max(F.when(kind.isin("click", "purchase"), F.col("event_time"))).alias("__engaged"),
    )
    profile = snapshots.select("customer_id", "value_tier", "rfm_segment", "unresponsive_count")
    return (
        grouped.withColumn("days_since_last_engagement", (F.col("__last") - F.col("__engaged")) / 24.0)
        .drop("__last", "__engaged")
        .join(profile, "customer_id")
    )


def customer_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("customer_id", "total_spend", "last_purchase_date", "purchase_count", "avg_order_value")


def customer_scores(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "customer_id", F.col("rfm_segment").alias("segment"), "value_tier", "churn_risk_score", "activity_state"
    )


def spend_stagnation(snapshots: DataFrame) -> DataFrame:
    """Share of customers whose spend per day of tenure is below the median of all."""
    own = F.try_divide(F.col("total_spend"), F.greatest(F.col("days_since_join"), F.lit(1.0)))
    middle = only_value(selection.median(snapshots, own))
    return snapshots.withColumn("__middle", middle).agg(pct(own < F.col("__middle")).alias("value"))
