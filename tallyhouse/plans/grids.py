"""Parameter grids of the sweeps."""

# The parameters of each sweep with the values they take.
GRIDS: dict[str, dict[str, list[float]]] = {
    "conversion": {
        "abandonment_rate_online": [0.15, 0.25, 0.35, 0.45],
        "abandonment_rate_in_store": [0.03, 0.05, 0.08],
        "payment_failure_rate": [0.01, 0.02, 0.05],
    },
    "demand": {
        "arrival_rate_online": [15.0, 20.0, 30.0, 50.0],
        "arrival_rate_in_store": [10.0, 15.0, 25.0],
        "basket_size_mean": [2.0, 3.0, 5.0],
    },
    "fulfillment": {
        "fulfillment_delay_max": [2.0, 3.0, 5.0],
        "service_time_packing_mode": [5.0, 10.0, 15.0],
        "bopis_prep_time_mode": [10.0, 20.0, 30.0],
    },
    "inventory_supply": {
        "supplier_reliability": [0.85, 0.95, 0.99],
        "mean_lead_time_days": [3.0, 7.0, 14.0],
        "lead_time_variability": [0.1, 0.2, 0.3],
    },
    "inventory_policy": {
        "reorder_point_multiplier": [1.0, 1.5, 2.0],
        "safety_stock_days": [3.0, 7.0, 14.0],
        "order_quantity_multiplier": [1.0, 1.5, 2.0],
    },
    "inventory_demand": {
        "mean_daily_demand_multiplier": [0.5, 1.0, 2.0],
        "daily_shrinkage_rate": [0.001, 0.005, 0.01],
        "demand_variability": [0.2, 0.4, 0.6],
    },
    "engagement_campaign": {
        "base_email_response_rate": [0.03, 0.08, 0.15],
        "vip_response_boost": [0.05, 0.1, 0.15],
        "click_to_conversion_rate": [0.15, 0.25, 0.4],
    },
    "engagement_retention": {
        "retention_response_rate": [0.15, 0.25, 0.4],
        "churned_threshold_days": [90.0, 180.0, 365.0],
        "lapsed_threshold_days": [30.0, 60.0, 90.0],
    },
    "engagement_loyalty": {
        "points_per_dollar": [0.5, 1.0, 2.0],
        "redemption_threshold": [50.0, 100.0, 200.0],
        "points_to_dollar_ratio": [0.05, 0.1, 0.15],
    },
}

# Section of the configuration that a parameter belongs to.
PARAMETER_SECTIONS: dict[str, str] = {
    "abandonment_rate_online": "distributions",
    "abandonment_rate_in_store": "distributions",
    "payment_failure_rate": "distributions",
    "arrival_rate_online": "distributions",
    "arrival_rate_in_store": "distributions",
    "basket_size_mean": "distributions",
    "fulfillment_delay_max": "distributions",
    "service_time_packing_mode": "distributions",
    "bopis_prep_time_mode": "distributions",
    "daily_shrinkage_rate": "inventory",
    "base_email_response_rate": "engagement",
    "vip_response_boost": "engagement",
    "click_to_conversion_rate": "engagement",
    "retention_response_rate": "engagement",
    "churned_threshold_days": "engagement",
    "lapsed_threshold_days": "engagement",
    "points_per_dollar": "engagement",
    "redemption_threshold": "engagement",
    "points_to_dollar_ratio": "engagement",
}

WORKFLOWS = ("omnichannel", "inventory", "engagement")


def workflow_of(sweep: str) -> str:
    """Sweeps are named after the workflow they vary; the unprefixed ones vary the sales channels."""
    prefix = sweep.split("_")[0]
    return prefix if prefix in WORKFLOWS else "omnichannel"
