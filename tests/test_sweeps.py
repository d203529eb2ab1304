import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse.operators import sweeps
from tallyhouse.plans.grids import GRIDS


def _scored(spark, items):
    rows_ = [(f"x_{i:04d}", "x", "omnichannel", float(v), float(y), float(k), c) for i, (v, y, k, c) in enumerate(items)]
    return spark.createDataFrame(rows_, "scenario_id string, sweep string, workflow_type string, volume double, variety double, kpi double, config_json string")


def _config(**params):
    import json

    return json.dumps({"parameters": params})


def test_prefixes_do_not_overlap(spark):
    df = spark.createDataFrame([("demand_0001",), ("demand_extra_0001",), ("plain",)], "scenario_id string")
    assert [r[0] for r in df.select(sweeps.sweep_of()).collect()] == ["demand", "demand_extra", "plain"]


def test_grid_is_the_cartesian_product_in_order(spark):
    import itertools
    import json

    got = [json.loads(r["config_json"])["parameters"] for r in sweeps.scenario_grid(spark, "conversion").orderBy("scenario_index").collect()]
    names = list(GRIDS["conversion"])
    assert [tuple(g[n] for n in names) for g in got] == list(itertools.product(*GRIDS["conversion"].values()))
    first = sweeps.scenario_grid(spark, "conversion").orderBy("scenario_index").first()
    assert (first["scenario_id"], first["random_seed"]) == ("conversion_0000", 42)
    assert sweeps.scenario_grid(spark, "none", {}).count() == 0
    assert sum(sweeps.scenario_grid(spark, s).count() for s in GRIDS) == 36 + 36 + 27 * 7


def test_sample_is_seeded(spark):
    a, b, c = (rows(sweeps.scenario_sample(spark, "demand", 50, seed)) for seed in (1, 1, 2))
    assert a == b and a != c and len(a) == 50


def test_equal_values_normalise_to_one(spark):
    got = sweeps.min_max_normalise(_scored(spark, [(5, 1, 10, "{}"), (5, 3, 20, "{}")])).orderBy("scenario_id")
    assert [(r["volume_norm"], r["variety_norm"], r["kpi_norm"]) for r in got.collect()] == [(1.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_rank_breaks_ties_by_id_and_recommends(spark):
    items = [(1, 1, k, _config(a=1.0, b=float(k), _seed=3.0)) for k in (10, 30, 30, 20)]
    ranked = sweeps.composite_rank(_scored(spark, items))
    assert [r["scenario_id"] for r in ranked.orderBy("rank").collect()] == ["x_0001", "x_0002", "x_0003", "x_0000"]
    got = {r["parameter"]: r for r in sweeps.recommend_params(ranked, 3).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["type"], got["b"]["type"], got["b"]["values_seen"]) == ("fixed", "range", [20.0, 30.0])


def test_ranking_is_the_same_when_the_sweep_is_hot(spark):
    """All scenarios in one sweep: its parts are numbered apart and the ranks are those of one sorted list."""
    items = [(i, i % 7, i * 3 % 11, "{}") for i in range(60)]
    ranked = sweeps.composite_rank(_scored(spark, items)).collect()
    listed = sorted(ranked, key=lambda r: (-r["composite"], r["scenario_id"]))
    assert [r["rank"] for r in listed] == list(range(1, 61))


def test_overrides_prefer_agreement_then_the_best_scenario(spark):
    items = [(1, 1, 30, _config(payment_failure_rate=0.05, arrival_rate_online=20.0, other=1.0)), (1, 1, 20, _config(payment_failure_rate=0.01, arrival_rate_online=20.0))]
    ranked = sweeps.composite_rank(_scored(spark, items))
    got = {r["parameter"]: r["value"] for r in sweeps.extract_overrides(ranked).collect()}
    assert got == {"payment_failure_rate": 0.05, "arrival_rate_online": 20.0}
    assert {r["parameter"] for r in sweeps.extract_overrides(ranked, use_ranges=False).collect()} == {"arrival_rate_online"}
    assert sweeps.extract_overrides(ranked, workflow="inventory").count() == 0


def test_a_missing_detail_table_counts_zero(small):
    class Partial:
        spark = small.spark

        def __contains__(self, name):
            return name != "hourly_demand"

        def __getitem__(self, name):
            assert name != "hourly_demand"
            return small[name]

    got = sweeps.scenario_profile(Partial(), "omnichannel").first()
    assert got["hours_active"] == 0 and got["volume"] > 0


def test_error_is_merged_into_the_configuration(spark):
    scenarios = spark.createDataFrame([("a_1", _config(p=1.0), "running"), ("a_2", _config(p=2.0), "running")], "scenario_id string, config_json string, status string")
    updates = spark.createDataFrame([("a_1", 1, 5, "completed", None), ("a_1", 2, 9, "failed", "boom")], "scenario_id string, update_id int, at int, status string, error string")
    assert rows(sweeps.scenario_states(scenarios, updates)) == [
        ("a_1", "failed", '{"parameters":{"p":1.0},"error":"boom"}'), ("a_2", "running", '{"parameters": {"p": 2.0}}')]
