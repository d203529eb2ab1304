from conftest import rows
from tallyhouse.operators import facts


def test_time_features_truncate(spark):
    df = spark.createDataFrame([(59.9,), (60.0,), (1439.0,), (1440.0,), (10080.0,)], "t double")
    got = [(r["hour"], r["day_of_week"]) for r in facts.time_features(df, "t", "minutes").collect()]
    assert got == [(0, 0), (1, 0), (23, 0), (0, 1), (0, 0)]


STEP = "journey_id int, scenario_id string, customer_id int, channel string, event_type string, event_time double, duration double, quantity int, amount double, reason string, order_id bigint"


def _step(journey, kind, at, duration=None, quantity=None, amount=None, reason=None, order=None):
    return (journey, "s_1", 7, "online", kind, float(at), duration, quantity, amount, reason, order)


def test_journeys_keep_repeat_visits_apart_and_take_the_last_write(spark):
    steps = [
        _step(1, "arrival", 0), _step(1, "browsed", 5, 5.0, 2), _step(1, "browsed", 6, 6.0, 3),
        _step(1, "checked_out", 8, 2.0, amount=20.0), _step(1, "completed", 9, order=11),
        _step(2, "arrival", 100), _step(2, "abandoned", 101, reason="price"),
    ]
    got = {r["journey_id"]: r for r in facts.journeys(spark.createDataFrame(steps, STEP)).collect()}
    one, two = got[1], got[2]
    assert (one["browsing_duration"], one["basket_size"], one["total_amount"], one["completed"]) == (6.0, 3, 20.0, True)
    assert (one["total_journey_time"], one["order_id"]) == (9.0, 11)
    assert (two["completed"], two["abandoned"], two["abandonment_reason"], two["total_journey_time"]) == (False, True, "price", 0.0)


def test_inventory_events_without_policy_use_zero(spark):
    moves = spark.createDataFrame(
        [("a", 0, "SALE", -70, 1.0), ("a", 0, "RECEIPT", 30, 2.0), ("b", 1, "SALE", -10, 1.0)],
        "sku string, location int, event_type string, quantity_change int, event_time double")
    policy = spark.createDataFrame([("a", 0, 15, 5)], "sku string, location_id int, reorder_point int, safety_stock int")
    got = facts.inventory_events(moves, policy).select("sku", "quantity_before", "quantity_after", "reorder_point", "stockout_occurred")
    assert rows(got) == [("a", -10, 20, 15, False), ("a", 60, -10, 15, True), ("b", 60, 50, 0, False)]


def test_backorders_stop_at_the_first_that_does_not_fit(spark):
    queue = spark.createDataFrame([("a", 0, 1.0, 3), ("a", 0, 2.0, 5), ("a", 0, 3.0, 1)], "sku string, location_id int, queued_at double, quantity int")
    stock = spark.createDataFrame([("a", 0, 4)], "sku string, location_id int, quantity_on_hand int")
    got = facts.fifo_backorders(queue, stock).orderBy("queued_at")
    assert [r["served"] for r in got.collect()] == [True, False, False]


def test_deliveries_stay_null_until_received(spark):
    po = spark.createDataFrame(
        [("p1", 10, 10, 0.0, 110 * 24 / 10, 10.0, "RECEIVED"), ("p2", 10, 9, 0.0, 288.0, 10.0, "RECEIVED"), ("p3", 10, 10, 0.0, 24.0, 1.0, "PENDING")],
        "po string, order_quantity int, received_quantity int, order_time double, actual_delivery_time double, expected_lead_time_days double, po_status string")
    got = rows(facts.supplier_deliveries(po).select("po", "actual_lead_time_days", "on_time", "short_shipped", "received_quantity"))
    assert got == [("p1", 11.0, True, False, 10), ("p2", 12.0, False, True, 9), ("p3", None, None, None, 0)]


def test_zero_policy_values_take_the_default(spark):
    products = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "C")], "sku string, name string")
    policy = spark.createDataFrame([("a", 0, "s", 0, 5, 0, 0.0)], "sku string, location_id int, supplier_id string, reorder_point int, order_quantity int, safety_stock int, lead_time_days double")
    got = rows(facts.products_with_policy(products, policy).select("sku", "reorder_point", "order_quantity", "safety_stock", "lead_time_days"))
    assert got == [("a", 50, 5, 20, 7.0), ("b", 50, 100, 20, 7.0)]


def test_state_update_keeps_columns_without_an_update(spark):
    orders = spark.createDataFrame([(1, "new", "open", None), (2, "new", "open", "x")], "order_id int, status string, payment_status string, fulfillment_status string")
    updates = spark.createDataFrame([(1, 5, "paid", None, None), (1, 9, None, "done", None), (1, 7, "sent", "half", None)], "order_id int, updated_at int, status string, payment_status string, fulfillment_status string")
    assert rows(facts.state_update(orders, updates)) == [(1, "sent", "done", None), (2, "new", "open", "x")]


def test_rollup_of_nothing_is_zero(small, spark):
    stockouts = spark.createDataFrame([], "requested int, available int")
    row = facts.workflow_rollup(small["customer_journeys"].limit(0), small["order_metrics"].limit(0), stockouts).first()
    assert row["total_customers"] == 0 and row["avg_order_value"] == 0.0 and row["lost_sales"] == 0 and row["on_time_percentage"] == 0.0


def test_cart_items_price_from_the_catalogue_and_drop_unknown(spark):
    carts = spark.createDataFrame([("c", 1, "active", '[{"sku":1,"qty":2},{"sku":2,"qty":1,"price":9.5},{"sku":99}]'), ("d", 1, "closed", '[{"sku":1}]')], "cart_id string, customer_id int, status string, items string")
    products = spark.createDataFrame([(1, 3.0), (2, 4.0)], "sku bigint, price double")
    assert rows(facts.active_cart_items(carts, products).select("sku", "quantity", "unit_price")) == [(1, 2, 3.0), (2, 1, 9.5)]
