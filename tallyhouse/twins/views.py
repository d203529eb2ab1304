"""DuckDB views of the retail tables, written independently of the Spark derivations.

``with_views(sql)`` puts the views a query names (and those they need) in front of it.
"""

from __future__ import annotations

import re


UNITS = 2**44


def total(x: str) -> str:
    """Plain SUM without its dependence on row order: values as whole numbers of 2^-44, summed in HUGEINT, rounded once."""
    units = f"SUM((({x})::DOUBLE * {UNITS})::HUGEINT)"
    return f"(({units} // {UNITS})::DOUBLE + ({units} % {UNITS})::DOUBLE / {UNITS})"


def mean(x: str) -> str:
    return f"{total(x)} / NULLIF(COUNT({x}), 0)"


def pct(cond: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond}) * 1e2 / NULLIF(COUNT(*), 0)"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
JSON_K = f"SELECT *, {K} AS k FROM events"


def three(x: str, a: str, b: str, c: str) -> str:
    return f"CASE {x} WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END"


def scenario(sweep: str, x: str) -> str:
    return f"'{sweep}_' || LPAD(CAST({x} AS VARCHAR), 4, '0')"


def tier(x: str, vip: int, high: int, medium: int) -> str:
    return f"CASE WHEN {x} >= {vip} THEN 'VIP' WHEN {x} >= {high} THEN 'High' WHEN {x} >= {medium} THEN 'Medium' ELSE 'Low' END"


MOVES = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
KEY = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"

VIEWS: dict[str, str] = {
    "ev": JSON_K,
    "customer_journeys": f"""
        SELECT *, CAST(FLOOR(arrival_time / 60) AS INTEGER) % 24 AS arrival_hour, CAST(FLOOR(arrival_time / 1440) AS INTEGER) % 7 AS day_of_week,
            CASE WHEN completed THEN v ELSE 0 END AS total_amount, CASE WHEN completed THEN journey_id END AS order_id,
            CASE WHEN completed THEN ROUND(browsing_duration + queue_wait_time + checkout_time, 4) ELSE 0 END AS total_journey_time
        FROM (SELECT event_id AS journey_id, {scenario('conversion', "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 36")} AS scenario_id, user_id AS customer_id,
            {three('event_id % 3', 'online', 'in_store', 'bopis')} AS channel,
            CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts) AS DOUBLE) AS arrival_time,
            ROUND(value % 45, 4) AS browsing_duration, k % 8 AS basket_size,
            CAST(CASE WHEN event_id % 3 = 1 THEN k % 15 ELSE 0 END AS DOUBLE) AS queue_wait_time, CAST(k % 6 + 1 AS DOUBLE) AS checkout_time,
            event_type IN ('view', 'error') AS abandoned,
            CASE WHEN event_type = 'view' THEN {three('k % 3', 'price', 'queue_too_long', 'browsing_fatigue')} END AS abandonment_reason,
            event_type = 'error' AND k % 2 = 0 AS payment_failed, event_type IN ('purchase', 'signup') AS completed, value AS v FROM ev)""",
    "order_metrics": f"""
        SELECT o_orderkey AS order_id, {scenario('conversion', 'o_orderkey % 36')} AS scenario_id,
            {three('o_custkey % 3', 'online', 'in_store', 'bopis')} AS channel, clock AS order_time,
            CAST(FLOOR(clock / 60) AS INTEGER) % 24 AS order_hour, CAST(FLOOR(clock / 1440) AS INTEGER) % 7 AS day_of_week,
            CASE WHEN dur IS NOT NULL THEN clock + 15 END AS fulfillment_start_time, clock + 15 + dur AS fulfillment_complete_time,
            dur AS fulfillment_duration, dur <= 2880 AS on_time,
            o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned
        FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1440 + o_orderkey % 1440 AS DOUBLE) AS clock,
            CASE WHEN o_orderstatus <> 'O' THEN CAST(30 + (o_orderkey * 7919) % 4320 AS DOUBLE) END AS dur FROM orders)""",
    "replenishment_policy": """
        SELECT p_partkey AS sku, CAST(loc AS INTEGER) AS location_id, (p_partkey + loc) % (SELECT COUNT(*) FROM supplier) AS supplier_id,
            CAST(p_size + 10 AS INTEGER) AS reorder_point, CAST(100 + 10 * p_size AS INTEGER) AS order_quantity,
            CAST(p_size AS INTEGER) AS safety_stock, CAST(2 + p_partkey % 9 AS DOUBLE) AS lead_time_days
        FROM part, range(5) AS r(loc) WHERE p_size > loc * 3""",
    "inventory": """
        SELECT p_partkey AS sku, CAST(loc AS INTEGER) AS location_id, CAST((p_partkey * 37 + loc * 53) % 120 AS INTEGER) AS quantity_on_hand,
            CAST((p_partkey + loc) % 10 AS INTEGER) AS quantity_reserved, CAST((p_partkey * 3 + loc) % 50 AS INTEGER) AS on_order_qty,
            CAST(p_size + 10 AS INTEGER) AS reorder_point FROM part, range(5) AS r(loc)""",
    "inventory_log": f"""
        SELECT m.*, CAST(60 + SUM(quantity_change) OVER (PARTITION BY m.sku, location ORDER BY event_time, {MOVES}
                ROWS UNBOUNDED PRECEDING) AS INTEGER) AS quantity_after,
            COALESCE(p.reorder_point, 0) AS reorder_point, COALESCE(p.safety_stock, 0) AS safety_stock
        FROM (SELECT *, {KEY} AS event_id, {scenario('inventory_policy', 'l_partkey % 27')} AS scenario_id, l_partkey AS sku,
                CAST(l_suppkey % 5 AS INTEGER) AS location, CASE l_returnflag WHEN 'N' THEN 'SALE' WHEN 'A' THEN 'RECEIPT' ELSE 'SHRINKAGE' END AS event_type,
                CAST(CASE l_returnflag WHEN 'N' THEN -l_quantity WHEN 'A' THEN l_quantity ELSE -(l_quantity % 5) END AS INTEGER) AS quantity_change,
                CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 24 + l_orderkey % 24 AS DOUBLE) AS event_time,
                CAST(l_orderkey % 40 AS INTEGER) AS on_order_qty, CAST(l_orderkey AS VARCHAR) AS reference_id FROM lineitem) m
        LEFT JOIN replenishment_policy p ON p.sku = m.sku AND p.location_id = m.location""",
    "inventory_events": """
        SELECT event_id, scenario_id, sku, location, event_type, event_time, CAST(event_time AS INTEGER) % 24 AS event_hour,
            CAST(FLOOR(event_time / 24) AS INTEGER) % 7 AS day_of_week, quantity_change, quantity_after - quantity_change AS quantity_before,
            quantity_after, reorder_point, safety_stock, on_order_qty, quantity_after <= 0 AS stockout_occurred, reference_id
        FROM inventory_log""",
    "inventory_snapshots": f"""
        SELECT scenario_id, sku, location, snapshot_day,
            CAST(COALESCE(SUM(ABS(quantity_change)) FILTER (WHERE event_type = 'SALE'), 0) AS INTEGER) AS daily_demand,
            CAST(COALESCE(SUM(quantity_change) FILTER (WHERE event_type = 'RECEIPT'), 0) AS INTEGER) AS daily_receipts,
            CAST(COUNT(*) FILTER (WHERE quantity_after <= 0) AS DOUBLE) AS stockout_hours,
            MAX(quantity_after) FILTER (WHERE last) AS quantity_on_hand, MAX(on_order_qty) FILTER (WHERE last) AS quantity_on_order,
            BOOL_OR(event_type = 'SALE' AND reorder_point > 0 AND quantity_after <= reorder_point) AS reorder_triggered,
            scenario_id || '_' || sku || '_' || location || '_' || snapshot_day AS snapshot_id
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku, location, snapshot_day ORDER BY {', '.join(c + ' DESC' for c in ['event_time', *MOVES.split(', ')])}) = 1 AS last
              FROM (SELECT *, CAST(FLOOR(event_time / 24) AS INTEGER) AS snapshot_day FROM inventory_log))
        GROUP BY scenario_id, sku, location, snapshot_day""",
    "hourly_demand": f"""
        SELECT scenario_id || '_' || h || '_' || channel AS id, scenario_id, CAST(h AS DOUBLE) AS hour_of_simulation,
            CAST(h % 24 AS INTEGER) AS hour_of_day, CAST((h // 24) % 7 AS INTEGER) AS day_of_week, channel, CAST(COUNT(*) AS INTEGER) AS arrival_count,
            CAST(COUNT(*) FILTER (WHERE completed) AS INTEGER) AS order_count, COALESCE({total('CASE WHEN completed THEN total_amount END')}, 0) AS revenue,
            CAST(COUNT(*) FILTER (WHERE abandoned) AS INTEGER) AS abandonment_count,
            COALESCE({mean('CASE WHEN completed AND basket_size > 0 THEN basket_size END')}, 0) AS avg_basket_size
        FROM (SELECT *, CAST(FLOOR(arrival_time / 60) AS INTEGER) AS h FROM customer_journeys) GROUP BY scenario_id, h, channel""",
    "purchase_orders": f"""
        SELECT {KEY} AS delivery_id, {scenario('inventory_policy', 'l_partkey % 27')} AS scenario_id, l_suppkey AS supplier_id,
            CAST(l_orderkey AS VARCHAR) AS po_number, l_partkey AS sku, CAST(l_suppkey % 5 AS INTEGER) AS location, CAST(l_quantity AS INTEGER) AS order_quantity,
            CAST(l_quantity AS INTEGER) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS delivered,
            CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 24 AS DOUBLE) AS order_time,
            CAST(3 + l_suppkey % 10 AS DOUBLE) AS expected_lead_time_days,
            CAST(((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 15) + 15) % 15 + 1 AS DOUBLE) AS days,
            CASE l_linestatus WHEN 'F' THEN 'RECEIVED' ELSE 'PENDING' END AS po_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "supplier_deliveries": """
        SELECT delivery_id, scenario_id, supplier_id, po_number, sku, location, order_quantity,
            CASE WHEN po_status = 'RECEIVED' THEN delivered ELSE 0 END AS received_quantity, order_time,
            order_time + expected_lead_time_days * 24 AS expected_delivery_time,
            CASE WHEN po_status = 'RECEIVED' THEN order_time + days * 24 END AS actual_delivery_time, expected_lead_time_days,
            CASE WHEN po_status = 'RECEIVED' THEN days END AS actual_lead_time_days,
            CASE WHEN po_status = 'RECEIVED' THEN days <= expected_lead_time_days * 1.1::DOUBLE END AS on_time,
            CASE WHEN po_status = 'RECEIVED' THEN delivered < order_quantity END AS short_shipped, po_status FROM purchase_orders""",
    "unmet_demand": f"""
        SELECT {MOVES}, event_id, sku, location AS location_id, event_time AS queued_at, LEAST(-quantity_change, -quantity_after) AS quantity,
            -quantity_change AS requested, GREATEST(0, quantity_after - quantity_change) AS available
        FROM inventory_log WHERE event_type = 'SALE' AND quantity_after < 0""",
    "channel_customers": f"""
        SELECT customer_id, channel, CAST((31 - MAX(FLOOR(arrival_time / 1440)) FILTER (WHERE completed)) * 7 AS INTEGER) AS recency_days,
            COUNT(*) FILTER (WHERE completed) AS purchase_count, COALESCE({total('CASE WHEN completed THEN total_amount END')}, 0) AS total_spend,
            COUNT(*) FILTER (WHERE abandoned) % 6 AS unresponsive_count FROM customer_journeys GROUP BY 1, 2""",
    "carts": f"""
        SELECT {KEY} AS cart_id, l_orderkey AS order_id, l_suppkey AS customer_id, CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'closed' END AS status,
            l_partkey AS sku1, CAST(l_quantity AS INTEGER) AS qty1, FLOOR(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100 AS price1,
            l_partkey + CASE WHEN l_linenumber % 7 = 0 THEN 10000000000 ELSE 0 END AS sku2,
            CASE l_returnflag WHEN 'A' THEN 'paypal' ELSE 'credit_card' END AS payment_method FROM lineitem""",
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS name, CAST(3 + s_suppkey % 10 AS DOUBLE) AS mean_lead_time_days FROM supplier",
    "customer_reviews": """
        SELECT id, review_text, score AS sentiment_score, status, created_at, retry_count,
            CASE WHEN score <= -0.6 THEN 'very_negative' WHEN score < -0.1 THEN 'negative' WHEN score <= 0.1 THEN 'neutral'
                 WHEN score < 0.6 THEN 'positive' WHEN score IS NOT NULL THEN 'very_positive' END AS sentiment_category,
            CASE WHEN status = 'processed for response' THEN 'Thank you, review ' || id END AS chatbot_statement, CAST(NULL AS VARCHAR) AS error_message
        FROM (SELECT d.doc_id AS id, text AS review_text, CAST(d.doc_id % 5 AS INTEGER) AS retry_count, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
            CAST(CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 AND quality = 0 THEN -0.9 WHEN toxic = 1 THEN -0.4
                 WHEN quality = 0 THEN 0 WHEN d.doc_id % 2 = 0 THEN 0.8 ELSE 0.4 END AS DOUBLE) AS score,
            CASE WHEN toxic IS NULL THEN 'To be processed' WHEN toxic = 1 THEN 'Needing human review' ELSE 'processed for response' END AS status
            FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "support_tickets": """
        SELECT event_id AS ticket_id, user_id AS customer_id,
            CASE k % 4 WHEN 0 THEN 'shipping_delay' WHEN 1 THEN 'product_defect' WHEN 2 THEN 'billing_issue' ELSE 'return' END AS issue_type,
            CASE WHEN k % 3 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN k % 3 <> 0 THEN 1 + k % 5 END AS satisfaction_rating,
            ts AS created_at, CASE WHEN k % 3 <> 0 THEN ts + to_hours(k % 72) END AS resolved_at FROM ev WHERE event_type = 'error'""",
    "points_transactions": """
        SELECT o_orderkey * 2 AS transaction_id, o_custkey AS customer_id, CAST(FLOOR(o_totalprice / 100) AS INTEGER) AS points_change, 'purchase' AS reason,
            o_orderdate AS transaction_date FROM orders
        UNION ALL SELECT o_orderkey * 2 + 1, o_custkey, -100, 'redemption', o_orderdate FROM orders WHERE o_orderstatus = 'P'""",
    "loyalty_account": f"""
        SELECT *, {tier('lifetime_points', 5000, 2000, 500)} AS tier FROM (
            SELECT customer_id, CAST(SUM(GREATEST(0, points_change)) AS BIGINT) AS current_points, CAST(SUM(GREATEST(0, points_change)) AS BIGINT) AS lifetime_points
            FROM points_transactions JOIN customer ON c_custkey = customer_id AND c_acctbal >= 1000 GROUP BY customer_id)""",
    "order_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price,
            l_extendedprice AS subtotal FROM lineitem""",
    "products": "SELECT p_partkey AS product_id, p_partkey AS sku, p_name AS name, p_type AS category, p_retailprice AS price FROM part",
    "payments": """
        SELECT o_orderkey AS order_id, o_totalprice AS amount,
            CASE LEFT(o_orderpriority, 1) WHEN '2' THEN 'debit_card' WHEN '3' THEN 'paypal' WHEN '4' THEN 'bank_transfer' ELSE 'credit_card' END AS payment_method,
            CASE o_orderstatus WHEN 'F' THEN 'authorized' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders""",
    "customer_purchase_history": """
        SELECT o_custkey AS customer_id, o_orderkey AS order_id, l_partkey AS sku, CAST(l_quantity AS INTEGER) AS quantity,
            l_extendedprice * (1 - l_discount) AS line_total, o_orderdate AS purchase_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "rfm_stats": f"""
        SELECT customer_id, MAX(purchase_date) AS last_purchase_date, COUNT(DISTINCT order_id) AS purchase_count, {total('line_total')} AS total_spend,
            {mean('line_total')} AS avg_line_value FROM customer_purchase_history GROUP BY customer_id""",
    "customers": f"""
        SELECT c_custkey AS customer_id, c_name AS name, {scenario('engagement_loyalty', 'c_custkey % 27')} AS scenario_id,
            DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS join_date, CAST(c_custkey % 6 AS INTEGER) AS unresponsive_count FROM customer""",
    "customer_snapshots": f"""
        SELECT scenario_id || '_' || customer_id AS snapshot_id, scenario_id, customer_id, activity_state, value_tier,
            CASE WHEN COALESCE(d, 999) <= 90 AND purchase_count >= 2 AND total_spend >= 200 THEN 'Champions'
                 WHEN COALESCE(d, 999) <= 120 AND purchase_count >= 1 AND total_spend >= 100 THEN 'Loyal'
                 WHEN COALESCE(d, 999) <= 180 OR total_spend >= 50 THEN 'Potential'
                 WHEN COALESCE(d, 999) > 180 THEN 'At Risk' ELSE 'Needs Attention' END AS rfm_segment,
            total_spend, purchase_count, CASE WHEN purchase_count > 0 THEN total_spend / purchase_count ELSE 0 END AS avg_order_value,
            CAST(COALESCE(d, 999) AS DOUBLE) AS days_since_last_purchase, days_since_join, CAST(FLOOR(total_spend * 0.1::DOUBLE) AS INTEGER) AS loyalty_points, unresponsive_count,
            GREATEST(0, LEAST(10, CASE WHEN COALESCE(d, 365) > 180 THEN 4 WHEN COALESCE(d, 365) > 90 THEN 2 ELSE 0 END
                + CASE WHEN unresponsive_count > 3 THEN 3 ELSE 0 END - CASE value_tier WHEN 'VIP' THEN 2 WHEN 'High' THEN 1 ELSE 0 END)) / 10.0::DOUBLE AS churn_risk_score,
            activity_state = 'churned' AS churned, last_purchase_date
        FROM (SELECT *, CASE WHEN COALESCE(d, 999) < 30 THEN 'active' WHEN COALESCE(d, 999) < 180 THEN 'lapsed' ELSE 'churned' END AS activity_state,
                {tier('total_spend', 600, 300, 100)} AS value_tier
            FROM (SELECT c.*, last_purchase_date, COALESCE(total_spend, 0) AS total_spend, CAST(COALESCE(purchase_count, 0) AS INTEGER) AS purchase_count,
                    date_diff('day', CAST(last_purchase_date AS DATE), DATE '2001-08-02') AS d,
                    CAST(date_diff('day', join_date, DATE '2001-08-02') AS DOUBLE) AS days_since_join
                  FROM customers c LEFT JOIN rfm_stats r USING (customer_id)))""",
    "customer_preferences": """
        SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN [kinds[c_custkey % 6 + 1], kinds[(c_custkey + 2) % 6 + 1]] ELSE [kinds[c_custkey % 6 + 1]] END AS preferred_categories,
            c_custkey % 10 < 7 AS marketing_opt_in FROM (SELECT *, ['ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO'] AS kinds FROM customer)""",
    "campaign_events": f"""
        SELECT *, campaign_type || '-' || CAST(FLOOR(event_time / 168) AS INTEGER) AS campaign_id FROM (
            SELECT event_id, user_id AS customer_id, {three('k % 3', 'email', 'sms', 'push')} AS campaign_type, event_type,
                CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS DOUBLE) AS event_time
            FROM ev)""",
    "campaign_interactions": """
        SELECT event_id AS interaction_id, e.customer_id, campaign_id, campaign_type, event_time AS send_time, event_type IN ('view', 'click', 'purchase') AS opened,
            event_type IN ('click', 'purchase') AS clicked, event_type = 'purchase' AS converted, ROUND(event_time % 30, 4) AS days_since_last_engagement,
            scenario_id, value_tier, rfm_segment, unresponsive_count
        FROM campaign_events e LEFT JOIN customer_snapshots s ON s.customer_id = e.customer_id""",
    "engagement_log": f"""
        SELECT event_id, user_id AS customer_id, {scenario('engagement_loyalty', 'user_id % 27')} AS scenario_id, event_type,
            CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS DOUBLE) AS event_time FROM events""",
    "engagement_events": """
        SELECT e.*, CAST(event_time AS INTEGER) % 24 AS event_hour, CAST(FLOOR(event_time / 24) AS INTEGER) % 7 AS day_of_week, value_tier, activity_state,
            days_since_last_purchase, total_spend, purchase_count, loyalty_points, churn_risk_score
        FROM engagement_log e JOIN customer_snapshots s ON s.customer_id = e.customer_id""",
}


def grid_view(sweep: str, workflow: str, grid: dict[str, list[float]]) -> str:
    """Cartesian product of the parameter values, first parameter slowest."""
    names = list(grid)
    tables = ", ".join(f"(SELECT UNNEST([{', '.join(f'{v}::DOUBLE' for v in vs)}]) AS {n}, UNNEST(range({len(vs)})) AS i{k}) AS g{k}" for k, (n, vs) in enumerate(grid.items()))
    order = ", ".join(f"i{k}" for k in range(len(names)))
    params = ", ".join(f"'{n}', {n}" for n in names)
    return f"""SELECT '{sweep}_' || LPAD(CAST(idx AS VARCHAR), 4, '0') AS scenario_id, '{workflow}' AS workflow_type, CAST(idx AS INTEGER) AS scenario_index,
        CAST(idx + 42 AS INTEGER) AS random_seed, CAST(json_object('parameters', json_object({params})) AS VARCHAR) AS config_json
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) - 1 AS idx FROM {tables})"""


def _add_scenarios() -> None:
    from tallyhouse.plans.grids import GRIDS

    for sweep, workflow in (("conversion", "omnichannel"), ("inventory_policy", "inventory"), ("engagement_loyalty", "engagement")):
        VIEWS[f"grid_{sweep}"] = grid_view(sweep, workflow, GRIDS[sweep])
    unmet = "CASE WHEN event_type = 'SALE' AND quantity_after < 0 THEN LEAST(ABS(quantity_change), -quantity_after) ELSE 0 END"
    got = "CASE WHEN event_type = 'RECEIPT' THEN quantity_change ELSE 0 END"
    VIEWS["kpi_omni"] = f"""SELECT scenario_id, visits, total_revenue, conversion_rate, total_orders FROM (SELECT scenario_id, COUNT(*) AS visits, {total('CASE WHEN completed THEN total_amount END')} AS total_revenue,
        {pct('completed')} AS conversion_rate FROM customer_journeys GROUP BY 1) j
        FULL JOIN (SELECT scenario_id, COUNT(*) AS total_orders FROM order_metrics GROUP BY 1) o USING (scenario_id)"""
    VIEWS["kpi_stock"] = f"""SELECT scenario_id, stockout_count, fill_rate, avg_lead_time FROM (SELECT scenario_id, COUNT(*) FILTER (WHERE stockout_occurred) AS stockout_count,
        COALESCE(CAST(SUM({got}) AS BIGINT) * 1e2 / NULLIF(CAST(SUM({got}) + SUM({unmet}) AS BIGINT), 0), 100) AS fill_rate FROM inventory_events GROUP BY 1)
        FULL JOIN (SELECT scenario_id, {mean('actual_lead_time_days')} AS avg_lead_time FROM supplier_deliveries GROUP BY 1) USING (scenario_id)"""
    VIEWS["kpi_people"] = f"""SELECT scenario_id, people, churn_rate, campaign_response_rate, avg_clv FROM (SELECT scenario_id, COUNT(*) AS people, {pct('churned')} AS churn_rate,
        {total('total_spend')} / COUNT(*) AS avg_clv FROM customer_snapshots GROUP BY 1)
        FULL JOIN (SELECT scenario_id, {pct('clicked')} AS campaign_response_rate FROM campaign_interactions WHERE scenario_id IS NOT NULL GROUP BY 1) USING (scenario_id)"""
    VIEWS["scenario_kpis"] = """SELECT COALESCE(a.scenario_id, b.scenario_id, c.scenario_id) AS scenario_id, COALESCE(visits, people) AS total_customers, total_orders, total_revenue,
        conversion_rate, stockout_count, fill_rate, avg_lead_time, churn_rate, campaign_response_rate, avg_clv
        FROM kpi_omni a FULL JOIN kpi_stock b ON a.scenario_id = b.scenario_id FULL JOIN kpi_people c ON c.scenario_id = COALESCE(a.scenario_id, b.scenario_id)"""
    VIEWS["simulation_scenarios"] = """SELECT g.*, CASE scenario_index % 9 WHEN 7 THEN 'running' WHEN 8 THEN 'failed' ELSE 'completed' END AS status,
        TIMESTAMP '2024-01-01' + to_hours(scenario_index) AS run_timestamp, regexp_replace(g.scenario_id, '_[0-9]+$', '') AS sweep,
        total_customers, total_orders, total_revenue, conversion_rate, stockout_count, fill_rate, avg_lead_time, churn_rate, campaign_response_rate, avg_clv
        FROM (SELECT * FROM grid_conversion UNION ALL SELECT * FROM grid_inventory_policy UNION ALL SELECT * FROM grid_engagement_loyalty) g
        LEFT JOIN scenario_kpis k ON k.scenario_id = g.scenario_id"""


_add_scenarios()


def _reads(name: str, text: str) -> bool:
    return re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text) is not None


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it needs, each after those it reads."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in ordered and _reads(name, text):
                visit_view(name)

    def visit_view(name: str) -> None:
        body = views[name]
        for other in views:
            if other != name and other not in ordered and _reads(other, body):
                visit_view(other)
        if name not in ordered:
            ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in ordered) + "\n" + sql
