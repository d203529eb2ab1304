"""Experiment runs: comparison, scoring, ranking and parameter recommendation across sweeps.

A sweep is the scenario id without its running number. Everything is computed for all scenarios of
all sweeps in one grouped pass per detail table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.functions import ordered
from tallyhouse.functions.exprs import count_rows, int_sum, mean, pct, ratio, total
from tallyhouse.plans.grids import GRIDS, PARAMETER_SECTIONS, workflow_of

# The tables a workflow fills, and the column it is judged by.
DETAIL_TABLES = {
    "omnichannel": ("customer_journeys", "hourly_demand", "order_metrics"),
    "inventory": ("inventory_events", "supplier_deliveries", "inventory_snapshots"),
    "engagement": ("engagement_events", "customer_snapshots", "campaign_interactions"),
}
PRIMARY_KPI = {"omnichannel": "total_revenue", "inventory": "fill_rate", "engagement": "avg_clv"}
SUMMARY_COLUMNS = {
    "omnichannel": ("total_customers", "total_orders", "total_revenue", "conversion_rate"),
    "inventory": ("stockout_count", "fill_rate", "avg_lead_time"),
    "engagement": ("total_customers", "churn_rate", "campaign_response_rate", "avg_clv"),
}
WEIGHTS = (0.3, 0.3, 0.4)
BASE_SEED = 42


def sweep_of(scenario_id: str = "scenario_id") -> Column:
    return F.regexp_replace(scenario_id, r"_\d+$", "")


def parameters_of(config_json: str = "config_json") -> Column:
    """Swept parameters: the ``parameters`` object, or the whole object when there is none."""
    nested = F.from_json(config_json, "parameters map<string,double>")["parameters"]
    return F.coalesce(nested, F.from_json(config_json, "map<string,double>"))


def scenario_grid(spark: SparkSession, sweep: str, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Every combination of the parameter values. A row's number gives its values by division, so the
    product needs no join."""
    grid = GRIDS[sweep] if grid is None else grid
    size = reduce(lambda n, values: n * len(values), grid.values(), 1) if grid else 0
    index, stride, chosen = F.col("id"), size, []
    for values in grid.values():
        stride //= len(values)
        at = (F.floor(index / stride) % len(values) + 1).cast("int")
        chosen.append(F.element_at(F.array(*[F.lit(v) for v in values]), at))
    return _scenarios(spark.range(size), sweep, list(grid), chosen)


DRAW_MODULUS = 2_147_483_647  # a prime below 2^31: squares stay within 63 bits


def draw(seed: int, position: int, index: Column) -> Column:
    """Number in [0, DRAW_MODULUS) for a counter: squared and shifted four times, so neighbours share no pattern."""
    x = F.pmod(index.cast("bigint") * 48_271 + F.lit(seed * 69_621 + position * 16_807 + 40_692), F.lit(DRAW_MODULUS))
    for _ in range(4):
        x = F.pmod(x * x + index + F.lit(position + 1), F.lit(DRAW_MODULUS))
    return x


def scenario_sample(spark: SparkSession, sweep: str, n: int, seed: int = BASE_SEED) -> DataFrame:
    """``n`` scenarios with a seeded choice for each parameter: any engine with 64-bit integers draws the same."""
    grid = GRIDS[sweep]
    chosen = [
        F.element_at(F.array(*[F.lit(v) for v in values]), (draw(seed, position, F.col("id")) % len(values) + 1).cast("int"))
        for position, values in enumerate(grid.values())
    ]
    return _scenarios(spark.range(n), sweep, list(grid), chosen)


def _scenarios(ids: DataFrame, sweep: str, names: list[str], values: list[Column]) -> DataFrame:
    pairs = [x for name, value in zip(names, values) for x in (F.lit(name), value)]
    config = F.to_json(F.struct(F.create_map(*pairs).alias("parameters"))) if pairs else F.lit("{}")
    return ids.select(
        F.format_string(f"{sweep}_%04d", F.col("id")).alias("scenario_id"),
        F.lit(workflow_of(sweep)).alias("workflow_type"),
        F.col("id").cast("int").alias("scenario_index"),
        (F.col("id") + BASE_SEED).cast("int").alias("random_seed"),
        config.alias("config_json"),
    )


def scenario_kpis(t) -> DataFrame:
    """KPIs of every scenario from its detail tables, one grouped pass per table."""
    key = "scenario_id"
    journeys = t["customer_journeys"].groupBy(key).agg(
        count_rows().alias("__visits"),
        total(F.when(F.col("completed"), F.col("total_amount"))).alias("total_revenue"),
        pct("completed").alias("conversion_rate"),
    )
    orders = t["order_metrics"].groupBy(key).agg(count_rows().alias("total_orders"))
    sale, after = F.col("event_type") == "SALE", F.col("quantity_after")
    unmet = F.when(sale & (after < 0), F.least(F.abs("quantity_change"), -after)).otherwise(0)
    received = F.when(F.col("event_type") == "RECEIPT", F.col("quantity_change")).otherwise(0)
    stock = t["inventory_events"].groupBy(key).agg(
        F.count_if("stockout_occurred").alias("stockout_count"),
        F.coalesce(F.try_divide(int_sum(received) * F.lit(100.0), int_sum(received) + int_sum(unmet)), F.lit(100.0)).alias(
            "fill_rate"
        ),
    )
    deliveries = t["supplier_deliveries"].groupBy(key).agg(mean("actual_lead_time_days").alias("avg_lead_time"))
    people = t["customer_snapshots"].groupBy(key).agg(
        count_rows().alias("__people"),
        pct("churned").alias("churn_rate"),
        F.try_divide(total("total_spend"), count_rows()).alias("avg_clv"),
    )
    campaigns = t["campaign_interactions"].groupBy(key).agg(pct("clicked").alias("campaign_response_rate"))
    parts = [journeys, orders, stock, deliveries, people, campaigns]
    joined = reduce(lambda a, b: a.join(b, key, "full"), parts).filter(F.col(key).isNotNull())
    return joined.select(
        key,
        F.coalesce("__visits", "__people").alias("total_customers"),
        "total_orders",
        "total_revenue",
        "conversion_rate",
        "stockout_count",
        "fill_rate",
        "avg_lead_time",
        "churn_rate",
        "campaign_response_rate",
        "avg_clv",
    )


def available_sweeps(scenarios: DataFrame) -> DataFrame:
    return (
        scenarios.groupBy(sweep_of().alias("sweep"), "workflow_type")
        .agg(
            count_rows().alias("n_scenarios"),
            F.count_if(F.col("status") == "completed").alias("n_completed"),
            F.min("run_timestamp").alias("first_run"),
            F.max("run_timestamp").alias("last_run"),
        )
        .orderBy(F.desc_nulls_last("last_run"), "sweep")
    )


def detail_counts(t, workflow: str) -> DataFrame:
    """Rows per detail table and scenario. Each branch reads only the scenario id; a table that does
    not exist is left out."""
    parts = [
        t[name].groupBy("scenario_id").agg(count_rows().alias("row_count")).withColumn("tbl", F.lit(name))
        for name in DETAIL_TABLES[workflow]
        if name in t
    ]
    return reduce(DataFrame.unionByName, parts)


def _of_sweep(df: DataFrame, sweep: str) -> DataFrame:
    return df.filter(sweep_of() == sweep)


def volume_report(t, sweep: str, top: int = 10) -> DataFrame:
    counts = _of_sweep(detail_counts(t, workflow_of(sweep)), sweep)
    volume = counts.groupBy("scenario_id").agg(
        F.sum("row_count").alias("total_rows"), count_rows().alias("tables_populated")
    )
    configs = t["simulation_scenarios"].select("scenario_id", "config_json")
    return volume.join(configs, "scenario_id").orderBy(F.desc("total_rows"), "scenario_id").limit(top)


def per_table_breakdown(t, sweep: str) -> DataFrame:
    counts = _of_sweep(detail_counts(t, workflow_of(sweep)), sweep)
    return counts.groupBy("tbl").agg(F.sum("row_count").alias("row_count"))


def _outcome() -> Column:
    return (
        F.when(F.col("completed"), "completed")
        .when(F.col("abandoned") & F.col("payment_failed"), "payment_failed")
        .when(F.col("abandoned"), "abandoned")
        .otherwise("in_progress")
    )


# Distinct counts per workflow: name -> (table, column).
VARIETY = {
    "omnichannel": {
        "channels": ("customer_journeys", lambda: F.col("channel")),
        "abandonment_reasons": ("customer_journeys", lambda: F.col("abandonment_reason")),
        "hours_active": ("hourly_demand", lambda: F.col("hour_of_day")),
        "outcome_types": ("customer_journeys", _outcome),
    },
    "inventory": {
        "event_types": ("inventory_events", lambda: F.col("event_type")),
        "sku_count": ("inventory_events", lambda: F.col("sku")),
        "locations": ("inventory_events", lambda: F.col("location")),
        "suppliers": ("supplier_deliveries", lambda: F.col("supplier_id")),
    },
    "engagement": {
        "event_types": ("engagement_events", lambda: F.col("event_type")),
        "segments": ("customer_snapshots", lambda: F.col("rfm_segment")),
        "value_tiers": ("engagement_events", lambda: F.col("value_tier")),
        "campaign_types": ("campaign_interactions", lambda: F.col("campaign_type")),
    },
}


def scenario_profile(t, workflow: str) -> DataFrame:
    """Rows and distinct counts of every scenario of a workflow, one pass per detail table.

    The distinct counts run on the combinations of their columns, not on the rows: a first grouping,
    combined on the map side, leaves one row per combination.
    """
    dims = {n: d for n, d in VARIETY[workflow].items() if d[0] in t}
    parts = []
    for table in (n for n in DETAIL_TABLES[workflow] if n in t):
        here = {n: column() for n, (name, column) in dims.items() if name == table}
        combos = t[table].groupBy("scenario_id", *[c.alias(n) for n, c in here.items()]).agg(count_rows().alias("__n"))
        parts.append(
            combos.groupBy("scenario_id").agg(
                F.sum("__n").alias(f"__rows_{table}"), *[F.count_distinct(n).alias(n) for n in here]
            )
        )
    joined = reduce(lambda a, b: a.join(b, "scenario_id", "full"), parts)
    row_columns = [c for c in joined.columns if c.startswith("__rows_")]
    volume = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in row_columns])
    filled = [(F.coalesce(n, F.lit(0)) if n in dims else F.lit(0).cast("bigint")).alias(n) for n in VARIETY[workflow]]
    counts = joined.select("scenario_id", volume.alias("volume"), *filled)
    return counts.withColumn("variety", reduce(lambda a, b: a + b, [F.col(n) for n in VARIETY[workflow]]))


def variety_report(t, sweep: str, top: int = 10) -> DataFrame:
    """Completed scenarios of a sweep by diversity; a scenario without detail rows counts 0."""
    workflow = workflow_of(sweep)
    names = [*VARIETY[workflow], "variety"]
    done = _of_sweep(t["simulation_scenarios"], sweep).filter("status = 'completed'").select("scenario_id")
    rows = done.join(scenario_profile(t, workflow), "scenario_id", "left")
    rows = rows.select("scenario_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return rows.orderBy(F.desc("variety"), "scenario_id").limit(top)


def scenario_summary(scenarios: DataFrame, sweep: str, top: int = 10) -> DataFrame:
    workflow = workflow_of(sweep)
    rows = _of_sweep(scenarios, sweep).filter("status = 'completed'")
    rows = rows.select("scenario_id", *SUMMARY_COLUMNS[workflow], "config_json")
    return rows.orderBy(F.desc_nulls_last(PRIMARY_KPI[workflow]), "scenario_id").limit(top)


def scenario_scores(t) -> DataFrame:
    """Volume, variety and KPI of every completed scenario of every sweep."""
    profiles = [scenario_profile(t, w).select("scenario_id", "volume", "variety") for w in DETAIL_TABLES]
    profile = reduce(DataFrame.unionByName, profiles)
    kpi = reduce(
        lambda chosen, item: chosen.when(F.col("workflow_type") == item[0], F.col(item[1])),
        list(PRIMARY_KPI.items())[1:],
        F.when(F.col("workflow_type") == "omnichannel", F.col(PRIMARY_KPI["omnichannel"])),
    )
    done = t["simulation_scenarios"].filter("status = 'completed'")
    rows = done.join(profile, "scenario_id", "left")
    return rows.select(
        "scenario_id",
        sweep_of().alias("sweep"),
        "workflow_type",
        F.coalesce("volume", F.lit(0)).cast("double").alias("volume"),
        F.coalesce("variety", F.lit(0)).cast("double").alias("variety"),
        F.coalesce(kpi, F.lit(0.0)).alias("kpi"),
        "config_json",
    )


MEASURES = ("volume", "variety", "kpi")


def min_max_normalise(scores: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Scale each measure to 0..1 within its sweep, 1 when all are equal. The extremes come from a
    grouped pass and are joined back, so no sweep has to fit into one task."""
    extremes = scores.groupBy("sweep").agg(
        *[f(m).alias(f"__{f.__name__}_{m}") for m in measures for f in (F.min, F.max)]
    )
    rows = scores.join(extremes, "sweep")
    for m in measures:
        low, high = F.col(f"__min_{m}"), F.col(f"__max_{m}")
        rows = rows.withColumn(
            f"{m}_norm", F.when(high == low, 1.0).otherwise(F.try_divide(F.col(m) - low, high - low))
        )
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def composite_rank(scores: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of the scaled measures, ranked within each sweep."""
    scored = min_max_normalise(scores)
    composite = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{m}_norm") for w, m in zip(weights, MEASURES)])
    scored = scored.withColumn("composite", F.round(composite, 8))
    order = [F.desc("composite"), F.asc("scenario_id")]
    return ordered.row_numbers(scored, ["sweep"], order, "rank")


def recommend_params(ranked: DataFrame, top_n: int = 5) -> DataFrame:
    """What the best scenarios of a sweep agree on: one value (fixed) or a range per parameter."""
    top = ranked.filter(F.col("rank") <= top_n)
    values = top.select("sweep", "workflow_type", F.explode(parameters_of()).alias("parameter", "value"))
    values = values.filter(~F.col("parameter").startswith("_"))
    grouped = values.groupBy("sweep", "workflow_type", "parameter").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sort_array(F.collect_set("value")).alias("values_seen"),  # at most top_n values
    )
    return grouped.withColumn("type", F.when(F.col("min") == F.col("max"), "fixed").otherwise("range"))


def by_section(recommended: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in PARAMETER_SECTIONS.items() for x in pair])
    return recommended.withColumn(
        "section", F.coalesce(F.try_element_at(names, F.col("parameter")), F.lit("unknown"))
    )


def extract_overrides(ranked: DataFrame, top_n: int = 5, workflow: str | None = None, use_ranges: bool = True) -> DataFrame:
    """Value to configure per parameter: the agreed one, else the best scenario's, else the midpoint."""
    chosen = by_section(recommend_params(ranked, top_n)).filter("section <> 'unknown'")
    if workflow:
        chosen = chosen.filter(F.col("workflow_type") == workflow)
    if not use_ranges:
        chosen = chosen.filter("type = 'fixed'")
    best = ranked.filter("rank = 1").select("sweep", F.explode(parameters_of()).alias("parameter", "best"))
    value = F.when(F.col("type") == "fixed", F.col("min")).otherwise(
        F.coalesce("best", (F.col("min") + F.col("max")) / 2)
    )
    return chosen.join(best, ["sweep", "parameter"], "left").select(
        "sweep", "workflow_type", "section", "parameter", value.alias("value")
    )


def sweep_summary(scenarios: DataFrame) -> DataFrame:
    """Counts by status and KPI means of every sweep."""
    status = F.col("status")
    return scenarios.groupBy(sweep_of().alias("sweep")).agg(
        count_rows().alias("total_scenarios"),
        *[F.count_if(status == s).alias(s) for s in ("completed", "failed", "running")],
        mean("total_customers").alias("avg_customers"),
        mean("total_orders").alias("avg_orders"),
        mean("total_revenue").alias("avg_revenue"),
        mean("conversion_rate").alias("avg_conversion"),
        F.min("conversion_rate").alias("min_conversion"),
        F.max("conversion_rate").alias("max_conversion"),
        mean("fill_rate").alias("avg_fill_rate"),
        mean("churn_rate").alias("avg_churn_rate"),
    )


def list_scenarios(scenarios: DataFrame, sweep: str | None = None, status: str | None = None) -> DataFrame:
    rows = _of_sweep(scenarios, sweep) if sweep else scenarios
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc_nulls_last("run_timestamp"), "scenario_id")


def get_scenario(scenarios: DataFrame, scenario_id: str) -> DataFrame:
    return scenarios.filter(F.col("scenario_id") == scenario_id)


def scenario_states(scenarios: DataFrame, updates: DataFrame) -> DataFrame:
    """Last reported status per scenario; the error of a failed one is merged into its configuration."""
    last = updates.groupBy("scenario_id").agg(
        F.max_by(F.struct(F.col("status").alias("s"), F.col("error").alias("e")), F.struct("at", "update_id")).alias("__u")
    )
    rows = scenarios.select("scenario_id", "config_json", "status").join(last, "scenario_id", "left")
    failed = F.when(F.col("__u.s") == "failed", F.col("__u.e"))
    merged = F.to_json(F.struct(parameters_of().alias("parameters"), failed.alias("error")))
    return rows.select(
        "scenario_id",
        F.coalesce("__u.s", "status").alias("status"),
        F.when(failed.isNotNull(), merged).otherwise(F.col("config_json")).alias("config_json"),
    )


def recommendations_report(ranked: DataFrame, top_n: int = 5) -> DataFrame:
    """One JSON document per sweep: the best scenarios and the recommended parameters."""
    recommended = by_section(recommend_params(ranked, top_n))
    recs = recommended.groupBy("sweep").agg(
        F.sort_array(F.collect_list(F.struct("parameter", "section", "type", "min", "max", "values_seen"))).alias(
            "recommendations"
        )
    )
    top = ranked.filter(F.col("rank") <= top_n)
    details = F.struct(
        "rank",
        "scenario_id",
        F.round("composite", 4).alias("composite"),
        "volume",
        "variety",
        F.round("kpi", 2).alias("kpi"),
        parameters_of().alias("params"),
    )
    scored = ranked.groupBy("sweep", "workflow_type").agg(count_rows().alias("n_scenarios_scored"))
    best = top.groupBy("sweep").agg(
        F.min_by("scenario_id", "rank").alias("top_scenario"),
        F.round(F.max("composite"), 4).alias("top_composite_score"),
        # Maps have no order, so the list is sorted by the rank alone.
        F.array_sort(F.collect_list(details), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("top_n_details"),
    )
    return scored.join(best, "sweep").join(recs, "sweep", "left").select(
        "sweep",
        "workflow_type",
        "n_scenarios_scored",
        "top_scenario",
        "top_composite_score",
        F.to_json(F.struct("recommendations", "top_n_details")).alias("report"),
    )
