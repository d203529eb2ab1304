from fractions import Fraction

import duckdb
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse import registry
from tallyhouse.functions.exprs import corr_or_null, mean, mean_sql, pct, total, total_sql
from tallyhouse.plans import drilldowns, metrics
from tallyhouse.twins import views


def test_single_pass_equals_one_query_per_metric(small):
    keys = [m.key for m in metrics.DASHBOARD]
    together = {r["key"]: r["value"] for r in metrics.together(small, list(metrics.DASHBOARD)).collect()}
    assert set(together) == set(keys)
    for key in ("M-01_revenue", "M-05_clv", "M-14_omni_payment_success", "M-19_ce_enrollment_rate", "M-34_cr_avg_score"):
        assert metrics.scalar(small, key).first()["value"] == together[key]


def test_empty_tables_give_null_or_zero_not_errors(small, tables):
    names = {m.table for m in metrics.METRICS.values() if m.table != "snapshot_enrollment"} | {"hourly_demand", "loyalty_account"}
    empty = tables(**{n: small[n].limit(0) for n in names})
    values = {key: metrics.scalar(empty, key).first()["value"] for key in metrics.METRICS}
    for key in ("M-03_conversion", "M-07_omni_arrival_rate", "M-26_ir_fill_rate", "M-29_ir_turnover", "M-37_arrival_rate_by_sim_hours"):
        assert values[key] is None
    assert values["M-11_omni_total_orders"] == 0
    assert values["M-41_turnover_total"] == 0


def test_null_flag_counts_in_the_denominator(spark, tables):
    orders = spark.createDataFrame([(1, True), (2, None), (3, False), (4, None)], "order_id int, on_time boolean")
    assert metrics.scalar(tables(order_metrics=orders), "M-12_omni_ontime").first()["value"] == 25.0


def test_fixed_point_sums_do_not_depend_on_the_order(spark):
    values = [(i, 0.1 * (i % 7) + 1e7 * (i % 2)) for i in range(2000)]
    df = spark.createDataFrame(values, "i int, x double")
    totals = {df.repartition(n, F.hash("i")).agg(total("x")).first()[0] for n in (1, 3, 16)}
    assert len(totals) == 1
    assert df.limit(0).agg(mean("x"), pct(F.col("x") > 0)).first()[0] is None


def test_sums_are_exact_and_agree_with_sql_text_and_with_plain_sums(spark):
    """Totals above 1e12, cancelling and negative values, and values of many decimals, against exact fractions."""
    large = [9.1e12 + 0.37 * i for i in range(500)] + [-9.1e12 - 0.11 * i for i in range(500)] + [123456789012.35, -0.1, None]
    small = [0.1 * i / 3 - 7 for i in range(999)] + [0.1, 2.675, None, -1e-9]
    for values in (large, small, [-0.1], [512.0000000001]):
        df = spark.createDataFrame([(x,) for x in values], "x double").repartition(5)
        got = df.agg(total("x"), mean("x"), F.expr(total_sql("x")), F.expr(mean_sql("x")), F.sum("x")).first()
        known = [Fraction(x) for x in values if x is not None]
        exact = sum(known)
        assert got[0] == got[2] and got[1] == got[3]
        assert abs(Fraction(got[0]) - exact) <= Fraction(len(known), 2**45) + abs(exact) / 2**53
        assert got[4] == pytest.approx(got[0], rel=1e-6, abs=1e-2)
        twin = duckdb.sql(f"SELECT {views.total('x')}, {views.mean('x')} FROM (SELECT unnest({[x for x in values if x is not None]}::DOUBLE[]) AS x)").fetchall()[0]
        assert twin == (got[0], got[1])
    with pytest.raises(ArithmeticException):
        spark.createDataFrame([(5e18,), (5e18,)], "x double").agg(total("x")).collect()


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "a int, b double")
    assert df.agg(corr_or_null("a", "b")).first()[0] is None


def test_trend(spark):
    history = [("m", 1, 10.0), ("m", 2, 15.0), ("m", 3, 15.0), ("m", 4, 0.0), ("m", 5, 3.0)]
    got = metrics.trend(spark.createDataFrame(history, "metric_id string, run int, value double")).orderBy("run")
    assert [(r["change_percent"], r["trend"]) for r in got.collect()] == [
        (0.0, "neutral"), (50.0, "up"), (0.0, "neutral"), (100.0, "down"), (0.0, "up")]


def test_drivers_are_labelled_and_known(small):
    found = dict(drilldowns.drivers(small, "revenue"))
    assert list(found) == ["Order Volume", "Average Order Value", "Basket Size", "Average Unit Price", "Channel Mix"]
    assert found["Channel Mix"].count() == 3
    known = set(registry.QUERIES)
    assert all(key in known for items in drilldowns.DRIVERS.values() for _, key in items)
    with pytest.raises(KeyError):
        drilldowns.drivers(small, "nonsense")


def test_hourly_trend_is_capped_at_a_thousand(small):
    assert drilldowns.hourly_trend(small["hourly_demand"], 10**9).count() <= 1000


def test_filters_and_columns_reach_the_scan(small):
    plan = registry.QUERIES["D-66_shrinkage_events"](small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,SHRINKAGE)" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_tab_summary_has_every_metric_of_the_tab(small):
    got = rows(metrics.tab_summary(small, "omnichannel").select("metric_id", "format"))
    assert len(got) == 8 and ("M-11_omni_total_orders", "number") in got
