"""Retail tables derived from the stored star-schema tables.

Plain column arithmetic stands in for recorded fields the inputs lack (channel, basket, location,
policy). Wherever an operator of this package builds the table (daily snapshots, hourly demand,
customer snapshots, ...), the derivation feeds it and returns its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.exprs import day_of_week, hour_of_day, only_value, to_places, total
from tallyhouse.operators import customers as cust, facts, sweeps
from tallyhouse.session import cut_lineage

AS_OF = "2001-08-02"
LOCATIONS = 5

OMNI_SWEEP, OMNI_SIZE = "conversion", 36
STOCK_SWEEP, STOCK_SIZE = "inventory_policy", 27
ENGAGE_SWEEP, ENGAGE_SIZE = "engagement_loyalty", 27

MOVE_ORDER = (
    "l_orderkey l_linenumber l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()

# Number of a stock movement within its SKU and location, in the order of time and MOVE_ORDER.
POSITION = "position"


def scenario(sweep: str, index: Column) -> Column:
    return F.concat(F.lit(f"{sweep}_"), F.format_string("%04d", index.cast("bigint")))


def pick(index: Column, *names: str) -> Column:
    chosen = F.lit(names[-1])
    for i, name in list(enumerate(names[:-1]))[::-1]:
        chosen = F.when(index == i, name).otherwise(chosen)
    return chosen


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _days(end: str, start: str) -> Column:
    return F.datediff(F.col(end), F.to_date(F.lit(start)))


def customer_journeys(t) -> DataFrame:
    k, kind = _k(), F.col("event_type")
    channel = pick(F.col("event_id") % 3, "online", "in_store", "bopis")
    rows = t["events"].select(
        F.col("event_id").alias("journey_id"),
        scenario(OMNI_SWEEP, _days("ts", "2024-01-01") % OMNI_SIZE).alias("scenario_id"),
        F.col("user_id").alias("customer_id"),
        channel.alias("channel"),
        (_days("ts", "2024-01-01") * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("arrival_time"),
        to_places(F.col("value") % 45).alias("browsing_duration"),
        (k % 8).alias("basket_size"),
        F.when(channel == "in_store", k % 15).otherwise(0).cast("double").alias("queue_wait_time"),
        (k % 6 + 1).cast("double").alias("checkout_time"),
        kind.isin("view", "error").alias("abandoned"),
        F.when(kind == "view", pick(k % 3, "price", "queue_too_long", "browsing_fatigue")).alias("abandonment_reason"),
        ((kind == "error") & (k % 2 == 0)).alias("payment_failed"),
        kind.isin("purchase", "signup").alias("completed"),
        F.col("value").alias("__value"),
    )
    done = F.col("completed")
    spent = to_places(F.col("browsing_duration") + F.col("queue_wait_time") + F.col("checkout_time"))
    return rows.select(
        *[c for c in rows.columns if c != "__value"],
        hour_of_day("arrival_time", "minutes").alias("arrival_hour"),
        day_of_week("arrival_time", "minutes").alias("day_of_week"),
        F.when(done, F.col("__value")).otherwise(0.0).alias("total_amount"),
        F.when(done, F.col("journey_id")).alias("order_id"),
        F.when(done, spent).otherwise(0.0).alias("total_journey_time"),
    )


def journey_steps(t) -> DataFrame:
    """Lifecycle events of the visits: each visit becomes the steps it went through."""
    j = t["customer_journeys"]
    at = F.col("arrival_time")

    def step(kind: str, when: Column, **fields: Column) -> Column:
        blank = {"duration": "double", "quantity": "int", "amount": "double", "reason": "string", "order_id": "bigint"}
        values = [fields.get(n, F.lit(None)).cast(ty).alias(n) for n, ty in blank.items()]
        return F.struct(F.lit(kind).alias("event_type"), when.cast("double").alias("event_time"), *values)

    browse, queue, pay = F.col("browsing_duration"), F.col("queue_wait_time"), F.col("checkout_time")
    steps = F.array(
        step("arrival", at),
        step("browsed", at + browse, duration=browse, quantity=F.col("basket_size")),
        step("queued", at + browse + queue, duration=queue),
        step("checked_out", at + browse + queue + pay, duration=pay, amount=F.col("total_amount")),
        F.when(F.col("abandoned"), step("abandoned", at + browse, reason=F.col("abandonment_reason"))),
        F.when(F.col("payment_failed"), step("payment_failed", at + browse + queue)),
        F.when(F.col("completed"), step("completed", at + F.col("total_journey_time"), order_id=F.col("order_id"))),
    )
    exploded = j.select("journey_id", "scenario_id", "customer_id", "channel", F.explode(steps).alias("s"))
    return exploded.filter(F.col("s").isNotNull()).select("journey_id", "scenario_id", "customer_id", "channel", "s.*")


def _order_facts(t) -> DataFrame:
    key = F.col("o_orderkey")
    duration = F.when(F.col("o_orderstatus") != "O", 30 + (key * 7919) % 4320).cast("double")
    return t["orders"].select(
        key.alias("order_id"),
        scenario(OMNI_SWEEP, key % OMNI_SIZE).alias("scenario_id"),
        pick(F.col("o_custkey") % 3, "online", "in_store", "bopis").alias("channel"),
        (_days("o_orderdate", "1995-01-01") * 1440 + key % 1440).cast("double").alias("order_time"),
        duration.alias("fulfillment_duration"),
    )


def order_metrics(t) -> DataFrame:
    returned = t["lineitem"].filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id")).distinct()
    start = F.when(F.col("fulfillment_duration").isNotNull(), F.col("order_time") + 15)
    rows = _order_facts(t).join(returned.withColumn("__r", F.lit(True)), "order_id", "left")
    return (
        rows.withColumn("order_hour", hour_of_day("order_time", "minutes"))
        .withColumn("day_of_week", day_of_week("order_time", "minutes"))
        .withColumn("fulfillment_start_time", start)
        .withColumn("fulfillment_complete_time", F.col("fulfillment_start_time") + F.col("fulfillment_duration"))
        .withColumn("on_time", F.col("fulfillment_duration") <= 2880)
        .withColumn("returned", F.coalesce("__r", F.lit(False)))
        .drop("__r")
    )


def order_events(t) -> DataFrame:
    """Lifecycle events of the orders; every returned line reports the return again."""
    o = _order_facts(t)
    start = F.col("order_time") + 15
    done = F.col("fulfillment_duration").isNotNull()

    def event(kind: str, at: Column, deadline: Column | None = None) -> Column:
        deadline = F.lit(None) if deadline is None else deadline
        return F.struct(
            F.lit(kind).alias("event_type"), at.alias("event_time"), deadline.cast("double").alias("deadline")
        )

    life = F.array(
        event("created", F.col("order_time")),
        F.when(done, event("fulfillment_started", start)),
        F.when(done, event("fulfilled", start + F.col("fulfillment_duration"), start + 2880)),
    )
    placed = o.select("order_id", "scenario_id", "channel", F.explode(life).alias("e")).filter("e is not null")
    placed = placed.select("order_id", "scenario_id", "channel", "e.*")
    back = t["lineitem"].filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id"),
        F.lit("returned").alias("event_type"),
        (_days("l_shipdate", "1995-01-01") * 1440).cast("double").alias("event_time"),
    )
    known = t["orders"].select(F.col("o_orderkey").alias("order_id"))
    return placed.unionByName(back.join(known, "order_id", "left_semi"), allowMissingColumns=True)


def stock_moves(t) -> DataFrame:
    """What moved when: all that the running stock needs. Names and texts follow from it (`described`), so no exchange carries them."""
    qty = F.col("l_quantity").cast("int")
    flag = F.col("l_returnflag")
    return t["lineitem"].select(
        *MOVE_ORDER,
        F.col("l_partkey").alias("sku"),
        (F.col("l_suppkey") % LOCATIONS).cast("int").alias("location"),
        F.when(flag == "N", -qty).when(flag == "A", qty).otherwise(-(qty % 5)).alias("quantity_change"),
        (_days("l_shipdate", "1995-01-01") * 24 + F.col("l_orderkey") % 24).cast("double").alias("event_time"),
    )


def described(moves: DataFrame) -> DataFrame:
    """Movements with their number, scenario, kind and reference."""
    flag = F.col("l_returnflag")
    return moves.withColumns({
        "event_id": F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "sku", "l_suppkey", "l_linenumber")]),
        "scenario_id": scenario(STOCK_SWEEP, F.col("sku") % STOCK_SIZE),
        "event_type": F.when(flag == "N", "SALE").when(flag == "A", "RECEIPT").otherwise("SHRINKAGE"),
        "on_order_qty": (F.col("l_orderkey") % 40).cast("int"),
        "reference_id": F.col("l_orderkey").cast("string"),
    })


def stock_movements(t) -> DataFrame:
    return described(t["stock_moves"]).select(
        *MOVE_ORDER, "event_id", "scenario_id", "sku", "location", "event_type", "quantity_change", "event_time", "on_order_qty", "reference_id")


def inventory_events_keyed(t) -> DataFrame:
    """Stock events with their POSITION within SKU and location, which stands for the fields that order them."""
    rows = described(facts.inventory_events(t["stock_moves"], t["replenishment_policy"], tie_break=tuple(MOVE_ORDER), position=POSITION))
    return rows.select(
        "sku", "location", "event_id", "scenario_id", "event_type", "quantity_change", "event_time", "on_order_qty", "reference_id",
        "reorder_point", "safety_stock", "quantity_after", "quantity_before", "stockout_occurred", "event_hour", "day_of_week", POSITION)


def inventory_events(t) -> DataFrame:
    return t["inventory_events_keyed"].drop(POSITION)


def inventory_snapshots(t) -> DataFrame:
    return facts.inventory_snapshots(t["inventory_events_keyed"], tie_break=(POSITION,))


def hourly_demand(t) -> DataFrame:
    return facts.hourly_demand(t["customer_journeys"])


def purchase_orders(t) -> DataFrame:
    """Every order line read as a purchase order to its supplier."""
    lines = t["lineitem"].join(t["orders"].select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    qty = F.col("l_quantity").cast("int")
    late = F.datediff("l_shipdate", "o_orderdate")
    placed = _days("o_orderdate", "1995-01-01") * 24.0
    expected = (3 + F.col("l_suppkey") % 10).cast("double")
    return lines.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias(
            "delivery_id"
        ),
        scenario(STOCK_SWEEP, F.col("l_partkey") % STOCK_SIZE).alias("scenario_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_orderkey").cast("string").alias("po_number"),
        F.col("l_partkey").alias("sku"),
        (F.col("l_suppkey") % LOCATIONS).cast("int").alias("location"),
        qty.alias("order_quantity"),
        F.when(F.col("l_returnflag") == "R", qty - 1).otherwise(qty).alias("received_quantity"),
        placed.alias("order_time"),
        (placed + expected * 24).alias("expected_delivery_time"),
        (placed + ((late % 15 + 15) % 15 + 1) * 24).cast("double").alias("actual_delivery_time"),
        expected.alias("expected_lead_time_days"),
        F.when(F.col("l_linestatus") == "F", "RECEIVED").otherwise("PENDING").alias("po_status"),
    )


def supplier_deliveries(t) -> DataFrame:
    return facts.supplier_deliveries(t["purchase_orders"])


def inventory(t) -> DataFrame:
    part = F.col("p_partkey")
    loc = F.col("location_id")
    return _part_locations(t).select(
        part.alias("sku"),
        loc,
        ((part * 37 + loc * 53) % 120).cast("int").alias("quantity_on_hand"),
        ((part + loc) % 10).cast("int").alias("quantity_reserved"),
        ((part * 3 + loc) % 50).cast("int").alias("on_order_qty"),
        (F.col("p_size") + 10).cast("int").alias("reorder_point"),
    )


def _part_locations(t) -> DataFrame:
    """Each part at each of the five locations (a fan-out of fixed size, no join)."""
    return t["part"].withColumn("location_id", F.explode(F.sequence(F.lit(0), F.lit(LOCATIONS - 1))))


def replenishment_policy(t) -> DataFrame:
    """Policies of parts by location; the far locations plan no small parts."""
    part, loc = F.col("p_partkey"), F.col("location_id")
    suppliers = only_value(t["supplier"].agg(F.count(F.lit(1))))
    return (
        _part_locations(t)
        .filter(F.col("p_size") > loc * 3)
        .withColumn("__n", suppliers)
        .select(
            part.alias("sku"),
            loc,
            ((part + loc) % F.col("__n")).alias("supplier_id"),
            (F.col("p_size") + 10).cast("int").alias("reorder_point"),
            (100 + 10 * F.col("p_size")).cast("int").alias("order_quantity"),
            F.col("p_size").cast("int").alias("safety_stock"),
            (2 + part % 9).cast("double").alias("lead_time_days"),
        )
    )


def suppliers(t) -> DataFrame:
    return t["supplier"].select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("name"),
        (3 + F.col("s_suppkey") % 10).cast("double").alias("mean_lead_time_days"),
    )


def customer_reviews(t) -> DataFrame:
    labelled = t["documents"].join(t["labels"], "doc_id", "left")
    quality, toxic = F.col("quality"), F.col("toxic")
    score = (
        F.when(toxic.isNull(), None)
        .when(toxic == 1, F.when(quality == 0, -0.9).otherwise(-0.4))
        .otherwise(F.when(quality == 0, 0.0).when(F.col("doc_id") % 2 == 0, 0.8).otherwise(0.4))
    )
    status = (
        F.when(toxic.isNull(), "To be processed")
        .when(toxic == 1, "Needing human review")
        .otherwise("processed for response")
    )
    rows = labelled.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("review_text"),
        score.alias("sentiment_score"),
        status.alias("status"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=F.floor(F.col("doc_id") / 24).cast("int"), hours=(F.col("doc_id") % 24).cast("int"))).alias(
            "created_at"
        ),
        (F.col("doc_id") % 5).cast("int").alias("retry_count"),
    )
    s = F.col("sentiment_score")
    category = (
        F.when(s <= -0.6, "very_negative")
        .when(s < -0.1, "negative")
        .when(s <= 0.1, "neutral")
        .when(s < 0.6, "positive")
        .when(s.isNotNull(), "very_positive")
    )
    reply = F.when(F.col("status") == "processed for response", F.concat(F.lit("Thank you, review "), F.col("id").cast("string")))
    return rows.withColumn("sentiment_category", category).withColumn("chatbot_statement", reply).withColumn(
        "error_message", F.lit(None).cast("string")
    )


def support_tickets(t) -> DataFrame:
    k = _k()
    solved = k % 3 != 0
    return t["events"].filter("event_type = 'error'").select(
        F.col("event_id").alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        pick(k % 4, "shipping_delay", "product_defect", "billing_issue", "return").alias("issue_type"),
        F.when(solved, "resolved").otherwise("open").alias("status"),
        F.when(solved, 1 + k % 5).alias("satisfaction_rating"),
        F.col("ts").alias("created_at"),
        F.when(solved, F.col("ts") + F.make_dt_interval(hours=k % 72)).alias("resolved_at"),
    )


def points_transactions(t) -> DataFrame:
    o = t["orders"]
    earned = o.select(
        (F.col("o_orderkey") * 2).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("points_change"),
        F.lit("purchase").alias("reason"),
        F.col("o_orderdate").alias("transaction_date"),
    )
    used = o.filter("o_orderstatus = 'P'").select(
        (F.col("o_orderkey") * 2 + 1).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.lit(-100).alias("points_change"),
        F.lit("redemption").alias("reason"),
        F.col("o_orderdate").alias("transaction_date"),
    )
    return earned.unionByName(used)


def loyalty_account(t) -> DataFrame:
    """Customers in good standing are enrolled."""
    enrolled = t["customer"].filter("c_acctbal >= 1000").select(F.col("c_custkey").alias("customer_id"))
    return cust.loyalty_account(t["points_transactions"].join(enrolled, "customer_id", "left_semi"))


def order_items(t) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("subtotal"),
    )


def products(t) -> DataFrame:
    return t["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_partkey").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def payments(t) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1)
    return t["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"),
        F.when(level == "2", "debit_card")
        .when(level == "3", "paypal")
        .when(level == "4", "bank_transfer")
        .otherwise("credit_card")
        .alias("payment_method"),
        F.when(F.col("o_orderstatus") == "F", "authorized")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("failed")
        .alias("status"),
    )


def customer_purchase_history(t) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    heads = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_total"),
        F.col("o_orderdate").alias("purchase_date"),
    )


def customers(t) -> DataFrame:
    key = F.col("c_custkey")
    return t["customer"].select(
        key.alias("customer_id"),
        F.col("c_name").alias("name"),
        scenario(ENGAGE_SWEEP, key % ENGAGE_SIZE).alias("scenario_id"),
        (F.to_date(F.lit("1994-01-01")) + (key % 365).cast("int")).alias("join_date"),
        (key % 6).cast("int").alias("unresponsive_count"),
    )


def customer_preferences(t) -> DataFrame:
    """Preferred category of a customer and, for every third, a second one; opt-in for seven in ten."""
    kinds = ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO"]
    key = F.col("c_custkey")
    names = F.array(*[F.lit(n) for n in kinds])
    first = F.element_at(names, (key % 6 + 1).cast("int"))
    second = F.element_at(names, ((key + 2) % 6 + 1).cast("int"))
    return t["customer"].select(
        key.alias("customer_id"),
        F.when(key % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("preferred_categories"),
        (key % 10 < 7).alias("marketing_opt_in"),
    )


def customer_snapshots(t) -> DataFrame:
    return cust.customer_snapshots(t["customers"], t["customer_purchase_history"], AS_OF)


def campaign_events(t) -> DataFrame:
    """Sends of the campaigns and their outcome, one campaign per type and week. Other events are sends nobody opened."""
    kind = pick(_k() % 3, "email", "sms", "push")
    at = _days("ts", "2024-01-01") * 24 + F.hour("ts")
    return t["events"].select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        F.concat(kind, F.lit("-"), F.floor(at / 168).cast("string")).alias("campaign_id"),
        kind.alias("campaign_type"),
        "event_type",
        at.cast("double").alias("event_time"),
    )


def campaign_interactions(t) -> DataFrame:
    """Each event read as one campaign send and its outcome. Profiles are unique by customer, which lets Spark leave the join
    out where no column of them is read."""
    kind = F.col("event_type")
    sends = t["campaign_events"].select(
        F.col("event_id").alias("interaction_id"),
        "customer_id",
        "campaign_id",
        "campaign_type",
        F.col("event_time").alias("send_time"),
        kind.isin("view", "click", "purchase").alias("opened"),
        kind.isin("click", "purchase").alias("clicked"),
        (kind == "purchase").alias("converted"),
        to_places(F.col("event_time") % 30).alias("days_since_last_engagement"),
    )
    profile = t["customer_snapshots"].select(
        "customer_id", "scenario_id", "value_tier", "rfm_segment", "unresponsive_count"
    ).dropDuplicates(["customer_id"])
    return sends.join(profile, "customer_id", "left")


def engagement_log(t) -> DataFrame:
    return t["events"].select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        scenario(ENGAGE_SWEEP, F.col("user_id") % ENGAGE_SIZE).alias("scenario_id"),
        "event_type",
        (_days("ts", "2024-01-01") * 24 + F.hour("ts")).cast("double").alias("event_time"),
    )


def engagement_events(t) -> DataFrame:
    return facts.engagement_events(t["engagement_log"], t["customer_snapshots"])


def unmet_demand(t) -> DataFrame:
    """Sales the stock could not cover, waiting in their order of arrival."""
    after, wanted = F.col("quantity_after"), F.abs("quantity_change")
    short = t["inventory_events_keyed"].filter((F.col("event_type") == "SALE") & (after < 0))
    return short.select(
        POSITION,
        "event_id",
        "sku",
        F.col("location").alias("location_id"),
        F.col("event_time").alias("queued_at"),
        F.least(wanted, -after).alias("quantity"),
        wanted.alias("requested"),
        F.greatest(F.lit(0), F.col("quantity_before")).alias("available"),
    )


def stock_deltas(t) -> DataFrame:
    """Stock changes of the movements: a receipt leaves the open orders, a sale its reservation."""
    kind, change = F.col("event_type"), F.col("quantity_change")
    return t["stock_movements"].select(
        "sku",
        F.col("location").alias("location_id"),
        change.alias("on_hand_delta"),
        F.when(kind == "SALE", change).otherwise(0).alias("reserved_delta"),
        F.when(kind == "RECEIPT", -change).otherwise(0).alias("on_order_delta"),
    )


def carts(t) -> DataFrame:
    """A cart per order line: the line's product with its price and one more item without a price,
    which for every seventh line number lies outside the catalogue."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    more = F.col("l_partkey") + F.when(F.col("l_linenumber") % 7 == 0, 10_000_000_000).otherwise(0)
    qty = F.col("l_quantity").cast("int")
    items = F.array(
        F.struct(F.col("l_partkey").alias("sku"), qty.alias("qty"), unit.alias("price")),
        F.struct(more.alias("sku"), F.lit(None).cast("int").alias("qty"), F.lit(None).cast("double").alias("price")),
    )
    return t["lineitem"].select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("cart_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("customer_id"),
        F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"),
        F.to_json(items).alias("items"),
        F.when(F.col("l_returnflag") == "A", "paypal").otherwise("credit_card").alias("payment_method"),
    )


def order_states(t) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.lit("pending").alias("payment_status"),
        F.lit(None).cast("string").alias("fulfillment_status"),
    )


def order_updates(t) -> DataFrame:
    """Status reports of the order lines; open lines say nothing about the payment."""
    return t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").alias("updated_at"),
        F.when(F.col("l_linestatus") == "F", "processing").alias("status"),
        F.when(F.col("l_linestatus") == "F", "paid").alias("payment_status"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("shipped").alias("fulfillment_status"),
    )


def channel_customers(t) -> DataFrame:
    """Recency, frequency, spend and ignored visits of a customer in one channel."""
    done = F.col("completed")
    grouped = t["customer_journeys"].groupBy("customer_id", "channel").agg(
        F.max(F.when(done, F.floor(F.col("arrival_time") / 1440))).alias("__last"),
        F.count_if(done).alias("purchase_count"),
        F.coalesce(total(F.when(done, F.col("total_amount"))), F.lit(0.0)).alias("total_spend"),
        (F.count_if("abandoned") % 6).alias("unresponsive_count"),
    )
    # Seven calendar days stand for each day of the log, so that the recency limits all occur.
    return grouped.withColumn("recency_days", ((F.lit(31) - F.col("__last")) * 7).cast("int")).drop("__last")


def scenario_updates(t) -> DataFrame:
    """Status reports of the running scenarios."""
    state = F.when(F.col("completed"), "completed").when(F.col("payment_failed"), "failed").otherwise("running")
    return t["customer_journeys"].select(
        "scenario_id",
        F.col("journey_id").alias("update_id"),
        F.col("arrival_time").alias("at"),
        state.alias("status"),
        F.when(state == "failed", F.concat(F.lit("payment failed in "), F.col("channel"))).alias("error"),
    )


def ranked_scenarios(t) -> DataFrame:
    """Scored and ranked scenarios. The scores, one row per scenario, are checkpointed: the ranking
    and everything after it would otherwise read all detail tables again."""
    return sweeps.composite_rank(cut_lineage(sweeps.scenario_scores(t)))


def simulation_scenarios(t) -> DataFrame:
    """Runs of three sweeps with the KPIs their detail tables give."""
    grids = None
    for sweep in (OMNI_SWEEP, STOCK_SWEEP, ENGAGE_SWEEP):
        grid = sweeps.scenario_grid(t.spark, sweep)
        grids = grid if grids is None else grids.unionByName(grid)
    kpis = sweeps.scenario_kpis(t)
    state = pick(F.col("scenario_index") % 9, *["completed"] * 7, "running", "failed")
    started = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("scenario_index"))
    return grids.withColumn("status", state).withColumn("run_timestamp", started).join(kpis, "scenario_id", "left")


BUILDERS = {
    f.__name__: f
    for f in (
        customer_journeys, journey_steps, order_metrics, order_events, stock_moves, stock_movements, inventory_events_keyed,
        inventory_events, inventory_snapshots, hourly_demand, purchase_orders, supplier_deliveries, inventory,
        replenishment_policy, suppliers, customer_reviews, support_tickets, points_transactions, loyalty_account,
        order_items, products, payments, customer_purchase_history, customers, customer_preferences,
        customer_snapshots, unmet_demand, stock_deltas, carts, order_states, order_updates, channel_customers,
        scenario_updates, ranked_scenarios, campaign_events, campaign_interactions, engagement_log, engagement_events,
        simulation_scenarios,
    )
}
