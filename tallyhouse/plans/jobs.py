"""Registered runs of the fact builders, customer, sweep and table-maintenance operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions import exprs
from tallyhouse.functions.exprs import count_rows, int_sum, mean, total
from tallyhouse.operators import customers as cust, facts, merge, sweeps, validate
from tallyhouse.plans import drilldowns
from tallyhouse.session import scratch_dir
from tallyhouse.sources import documents, storage
from tallyhouse.sources.buckets import BucketTable
from tallyhouse.sources.derive import AS_OF, ENGAGE_SWEEP, OMNI_SWEEP, POSITION, STOCK_SWEEP, inventory_events_keyed

TIES = (POSITION,)


def fifo_backorders(t) -> DataFrame:
    queue = t["unmet_demand"].drop("requested", "available")
    served = facts.fifo_backorders(queue, t["inventory"], TIES)
    return served.select("event_id", "sku", "location_id", "queued_at", "quantity", "needed", "available", "served")


FACTS = {
    "F-01_time_features": lambda t: facts.time_features(
        t["customer_journeys"].select("journey_id", "arrival_time"), "arrival_time", "minutes"),
    "F-01_time_features_hours": lambda t: facts.time_features(
        t["engagement_log"].select("event_id", "event_time"), "event_time", "hours"),
    "F-02_journeys": lambda t: facts.journeys(t["journey_steps"]),
    "F-03_order_metrics": lambda t: facts.order_metrics(t["order_events"]),
    "F-04_inventory_events": lambda t: inventory_events_keyed(t).drop(POSITION),
    "F-05_hourly_demand": lambda t: facts.hourly_demand(t["customer_journeys"]),
    "F-06_inventory_snapshots": lambda t: facts.inventory_snapshots(t["inventory_events_keyed"], TIES),
    "F-07_supplier_deliveries": lambda t: facts.supplier_deliveries(t["purchase_orders"]),
    "F-08_reorder_triggers": lambda t: facts.reorder_triggers(t["inventory"], t["replenishment_policy"]),
    "F-09_fifo_backorders": fifo_backorders,
    "F-10_workflow_rollup": lambda t: facts.workflow_rollup(
        t["customer_journeys"], t["order_metrics"], t["unmet_demand"]),
    "F-11_lost_sales": lambda t: facts.lost_sales(t["unmet_demand"]),
    "F-12_supplier_performance": lambda t: facts.supplier_performance(t["suppliers"], t["supplier_deliveries"]),
    "F-13_apply_stock_deltas": lambda t: facts.apply_stock_deltas(t["inventory"], t["stock_deltas"]),
    "F-14_counters": lambda t: facts.counters(t["events"].select(F.col("event_type").alias("metric"), "value")),
    "F-15_active_cart_items": lambda t: facts.active_cart_items(t["carts"], t["products"]),
    "F-16_products_with_policy": lambda t: facts.products_with_policy(t["products"], t["replenishment_policy"]),
    "F-17_engagement_events": lambda t: t["engagement_events"],
    "F-18_state_update": lambda t: facts.state_update(t["order_states"], t["order_updates"]),
}


def value_tiers(t) -> DataFrame:
    return t["channel_customers"].select(
        "customer_id", "channel",
        exprs.value_tier("total_spend").alias("static_tier"),
        exprs.value_tier("total_spend", "dynamic").alias("dynamic_tier"))


def churn_risks(t) -> DataFrame:
    rows = t["channel_customers"].withColumn("value_tier", exprs.value_tier("total_spend"))
    return rows.select(
        "customer_id", "channel", "value_tier",
        exprs.churn_risk("recency_days", "unresponsive_count", "value_tier").alias("churn_risk_score"))


CUSTOMERS = {
    "X-01_purchase_history_rfm": lambda t: cust.purchase_history(t["customer_purchase_history"]),
    "X-02_top_customers": lambda t: cust.top_customers(t["customer_snapshots"]),
    "X-03_value_tier": value_tiers,
    "X-04_activity_state": lambda t: t["channel_customers"].select(
        "customer_id", "channel", exprs.activity_state(F.coalesce("recency_days", F.lit(999))).alias("activity_state")),
    "X-05_recommendations": lambda t: cust.recommendations(t["customer_preferences"], t["products"]),
    "X-06_rfm_segment": lambda t: t["channel_customers"].select(
        "customer_id", "channel", exprs.rfm_segment("recency_days", "purchase_count", "total_spend").alias("rfm_segment")),
    "X-07_loyalty_ledger": lambda t: cust.loyalty_ledger(t["points_transactions"]),
    "X-07_purchase_points": lambda t: cust.purchase_points(t["customer_purchase_history"]),
    "X-08_churn_risk": churn_risks,
    "X-09_customer_snapshots": lambda t: cust.customer_snapshots(t["customers"], t["customer_purchase_history"], AS_OF),
    "X-10_loyalty_account": lambda t: cust.loyalty_account(t["points_transactions"]),
    "X-10_loyalty_account_net": lambda t: cust.loyalty_account(t["points_transactions"], subtract_redemptions=True),
    "X-11_engagement_summary": lambda t: cust.engagement_summary(
        t["customer_snapshots"], t["campaign_interactions"], t["support_tickets"]),
    "X-12_campaign_audience": lambda t: cust.campaign_audience(
        t["customer_snapshots"], t["customer_preferences"], "Champions"),
    "X-13_campaign_interactions": lambda t: cust.campaign_interactions(t["campaign_events"], t["customer_snapshots"]),
    "X-14_customer_stats": lambda t: cust.customer_stats(t["customer_snapshots"]),
    "X-14_customer_scores": lambda t: cust.customer_scores(t["customer_snapshots"]),
}


def _per_workflow(prefix: str, run) -> dict:
    chosen = {"omnichannel": OMNI_SWEEP, "inventory": STOCK_SWEEP, "engagement": ENGAGE_SWEEP}
    return {f"{prefix}_{workflow}": (lambda t, s=sweep: run(t, s)) for workflow, sweep in chosen.items()}


def _with_visits(t, grid: DataFrame) -> DataFrame:
    visits = t["customer_journeys"].groupBy("scenario_id").agg(count_rows().alias("visits"))
    return grid.join(visits, "scenario_id", "left").withColumn("visits", F.coalesce("visits", F.lit(0)))


def _scores(t) -> DataFrame:
    return sweeps.scenario_scores(t).drop("config_json")


SWEEPS = {
    "W-01_available_sweeps": lambda t: sweeps.available_sweeps(t["simulation_scenarios"]),
    **_per_workflow("W-02_volume_report", sweeps.volume_report),
    **_per_workflow("W-03_per_table_breakdown", sweeps.per_table_breakdown),
    **_per_workflow("W-04_variety_report", sweeps.variety_report),
    **_per_workflow("W-05_scenario_summary", lambda t, s: sweeps.scenario_summary(t["simulation_scenarios"], s)),
    "W-06_scenario_scores": _scores,
    "W-07_min_max_normalise": lambda t: sweeps.min_max_normalise(_scores(t)),
    "W-08_composite_rank": lambda t: t["ranked_scenarios"].drop("config_json"),
    "W-09_recommend_params": lambda t: sweeps.recommend_params(t["ranked_scenarios"]),
    "W-10_by_section": lambda t: sweeps.by_section(sweeps.recommend_params(t["ranked_scenarios"])).drop("values_seen"),
    "W-11_extract_overrides": lambda t: sweeps.extract_overrides(t["ranked_scenarios"]),
    "W-14_sweep_summary": lambda t: sweeps.sweep_summary(t["simulation_scenarios"]),
    "W-15_list_scenarios": lambda t: sweeps.list_scenarios(t["simulation_scenarios"], status="completed"),
    "W-15_get_scenario": lambda t: sweeps.get_scenario(t["simulation_scenarios"], f"{OMNI_SWEEP}_0003"),
    "W-16_scenario_grid": lambda t: _with_visits(t, sweeps.scenario_grid(t.spark, OMNI_SWEEP)),
    "W-17_scenario_sample": lambda t: _with_visits(t, sweeps.scenario_sample(t.spark, OMNI_SWEEP, 36)),
    "W-18_scenario_states": lambda t: sweeps.scenario_states(
        sweeps.scenario_grid(t.spark, OMNI_SWEEP).withColumn("status", F.lit("created")), t["scenario_updates"]),
    "W-19_scenario_kpis": sweeps.scenario_kpis,
    "W-20_recommendations_report": lambda t: sweeps.recommendations_report(t["ranked_scenarios"]),
}


def _customer_docs(t) -> DataFrame:
    rows = t["customer"].select(
        F.col("c_custkey").cast("string").alias("customerId"),
        F.col("c_name").alias("name"),
        F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("address"),
        F.array("c_mktsegment").alias("tags"),
        F.col("c_acctbal").alias("accountBalance"),
    )
    return documents.to_documents(rows, "customerId")


CUSTOMER_SCHEMA = "customerId string, name string, address struct<nation:int,segment:string>, tags array<string>, accountBalance double"


def _customer_columns(docs: DataFrame) -> DataFrame:
    d = documents.read_documents(docs, CUSTOMER_SCHEMA)
    return d.select("id", "name", F.col("address.nation").alias("nation"), F.col("address.segment").alias("segment"),
                    F.col("tags")[0].alias("first_tag"), F.col("accountBalance").alias("balance"))


def _export_import(t) -> DataFrame:
    path = scratch_dir(t.spark, "table")
    storage.export_table(t["inventory"], path)
    return storage.read_table(t.spark, path, t["inventory"].schema)


def _ndjson_round_trip(t) -> DataFrame:
    """Export all customers, then import them over a collection that lacks some and has old texts."""
    path = scratch_dir(t.spark, "documents")
    docs = _customer_docs(t)
    documents.export_documents(docs, path)
    old = docs.filter(F.get_json_object("data", "$.address.segment") != "MACHINERY").withColumn("data", F.lit("{}"))
    table = BucketTable(scratch_dir(t.spark, "collection"), old.schema, ("id",)).create(old)
    return _customer_columns(documents.import_into(table, t.spark, path).read(t.spark))


def _merge_inputs(t) -> tuple[DataFrame, DataFrame]:
    """Finished orders are loaded already; the source repeats each order header once per line."""
    heads = t["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_partkey")
    source = lines.join(heads, "o_orderkey")
    target = heads.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.lit(0).alias("first_line"), F.lit(None).cast("bigint").alias("first_part"))
    source = source.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("l_linenumber").alias("first_line"), F.col("l_partkey").alias("first_part"))
    return target, source


MERGE_ORDER = ["first_line", "first_part"]


def _merge(t) -> DataFrame:
    target, source = _merge_inputs(t)
    return merge.merge_insert_new(target, source, ["o_orderkey"], MERGE_ORDER)


def _merge_counts(t) -> DataFrame:
    target, source = _merge_inputs(t)
    return merge.merge_counts(target, source, ["o_orderkey"], MERGE_ORDER)


def _upsert(t) -> DataFrame:
    """Closing stock of the last recorded day over the master stock."""
    days = t["inventory_snapshots"].select(
        "sku", F.col("location").alias("location_id"), "snapshot_day", "quantity_on_hand", F.col("quantity_on_order").alias("on_order_qty"))
    latest = merge.last_per_key(days, ["sku", "location_id"], ["snapshot_day"])
    stock = t["inventory"]
    table = BucketTable(scratch_dir(t.spark, "stock"), stock.schema, ("sku", "location_id")).create(stock)
    return table.upsert(latest, ["quantity_on_hand", "on_order_qty"]).read(t.spark)


def _insert(t) -> DataFrame:
    """The merge of S-06 into a stored table: new orders are appended, stored files stay as they are."""
    target, source = _merge_inputs(t)
    table = BucketTable(scratch_dir(t.spark, "orders"), target.schema, ("o_orderkey",)).create(target)
    return table.insert_new(source, MERGE_ORDER).read(t.spark)


KEYS = {
    "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}


def _validate(t) -> DataFrame:
    parts = [validate.validate_table(t[name], name, key) for name, key in KEYS.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _compare_counts(t) -> DataFrame:
    left = {"journeys": t["events"], "orders": t["orders"], "reviews": t["documents"], "lines": t["lineitem"]}
    right = {"journeys": t["customer_journeys"], "orders": t["order_metrics"], "reviews": t["customer_reviews"],
             "deliveries": t["supplier_deliveries"]}
    return validate.compare_counts(left, right)


def _parity(t) -> DataFrame:
    """Order value per channel in fixed point against the plain mean."""
    done = t["customer_journeys"].filter("completed")
    a = done.groupBy("channel").agg(mean("total_amount").alias("v"))
    b = done.groupBy("channel").agg(F.avg("total_amount").alias("v"))
    return validate.result_parity(a, b, ["channel"], "v").select("channel", "left_value", "matches")


def _decimals(t) -> DataFrame:
    rows = t["orders"].select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("inner")).alias("nested"))
    plain = validate.decimal_to_double(rows)
    return plain.select("o_orderkey", "price", F.col("nested.inner").alias("inner_price"))


def _next_ids(t) -> DataFrame:
    new = t["customer"].select("c_custkey", "c_mktsegment")
    return merge.next_ids(t["orders"], "o_orderkey", new, "c_custkey")


def _complete_orders(t, table: str) -> DataFrame:
    batch = t["carts"].select(F.col("cart_id").alias("order_id"), "customer_id", "items", "payment_method")
    return merge.complete_orders(batch)[table]


def _report(t) -> DataFrame:
    path = scratch_dir(t.spark, "report")
    storage.write_report(drilldowns.channel_breakdown(t["customer_journeys"]), path)
    return t.spark.read.text(path).select(
        F.get_json_object("value", "$.channel").alias("channel"),
        F.get_json_object("value", "$.total_journeys").cast("bigint").alias("total_journeys"))


REPORT_BODY = (
    "struct<recommendations:array<struct<parameter:string,section:string,type:string,min:double,max:double,values_seen:array<double>>>,"
    "top_n_details:array<struct<rank:int,scenario_id:string,composite:double,volume:double,variety:double,kpi:double,params:map<string,double>>>>"
)


def _nested_report(t) -> DataFrame:
    """The recommendations of all sweeps as one nested document each, written and read back whole."""
    path = scratch_dir(t.spark, "report")
    found = sweeps.recommendations_report(t["ranked_scenarios"])
    storage.write_report(found.withColumn("report", F.from_json("report", REPORT_BODY)), path)
    schema = f"sweep string, workflow_type string, n_scenarios_scored bigint, top_scenario string, top_composite_score double, report {REPORT_BODY}"
    return t.spark.read.schema(schema).json(path).withColumn("report", F.to_json("report"))


STORES = {
    "S-01_export_table": _export_import,
    "S-02_read_documents": lambda t: _customer_columns(_customer_docs(t)),
    "S-03_export_documents": lambda t: documents.json_lines(
        documents.to_documents(t["inventory"].select("sku", "location_id", "quantity_on_hand"), "sku")),
    "S-04_import_ndjson": _ndjson_round_trip,
    "S-05_load_relational": lambda t: storage.replace_table(t["payments"], scratch_dir(t.spark, "payments")),
    "S-06_merge_insert_new": _merge,
    "S-06_merge_counts": _merge_counts,
    "S-06_merge_stored": _insert,
    "S-07_upsert": _upsert,
    "S-08_write_report": _report,
    "S-08_nested_report": _nested_report,
    "S-09_validate_table": _validate,
    "S-09_column_listing": lambda t: validate.column_listing({name: t[name] for name in KEYS}),
    "S-10_compare_counts": _compare_counts,
    "S-11_document_query": lambda t: documents.document_query(
        _customer_docs(t), {"address.segment": "MACHINERY", "deleted": ""}, ["customerId", "name", "address.nation", "phone"]),
    "S-12_partition_key": lambda t: _customer_docs(t).select("id", documents.partition_key().alias("partition_key")),
    "S-13_sample_rows": lambda t: validate.sample_rows(t["orders"], 10, ["o_orderkey"]),
    "S-14_result_parity": _parity,
    "S-15_decimal_to_double": _decimals,
    "S-16_next_ids": _next_ids,
    "S-17_write_complete_order": lambda t: _complete_orders(t, "orders"),
    "S-17_order_items": lambda t: _complete_orders(t, "order_items"),
    "S-17_payments": lambda t: _complete_orders(t, "payments"),
}

JOBS = {**FACTS, **CUSTOMERS, **SWEEPS, **STORES}
