import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.functions import exprs
from tallyhouse.operators import customers as cust


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_value_tiers(spark):
    df = spark.createDataFrame([(v,) for v in (99.9, 100.0, 300.0, 600.0, 2000.0, 5000.0)], "s double")
    assert [r[0] for r in df.select(exprs.value_tier("s")).collect()] == ["Low", "Medium", "High", "VIP", "VIP", "VIP"]
    assert [r[0] for r in df.select(exprs.value_tier("s", "dynamic")).collect()] == ["Low", "Low", "Low", "Medium", "High", "VIP"]


def test_activity_state(spark):
    df = spark.createDataFrame([(d,) for d in (0, 29, 30, 89, 90, 179, 180)], "d int")
    got = [r[0] for r in df.select(exprs.activity_state("d")).collect()]
    assert got == ["active", "active", "lapsed", "lapsed", "lapsed", "lapsed", "churned"]


def test_rfm_segments(spark):
    cases = [(90, 2, 200.0), (120, 1, 100.0), (180, 1, 10.0), (400, 1, 50.0), (181, 1, 10.0), (None, 0, 0.0)]
    df = spark.createDataFrame(cases, "r int, f int, m double")
    got = [r[0] for r in df.select(exprs.rfm_segment("r", "f", "m")).collect()]
    assert got == ["Champions", "Loyal", "Potential", "Potential", "At Risk", "At Risk"]


def test_churn_risk_is_clamped(spark):
    cases = [(181, 4, "Low"), (91, 0, "Low"), (10, 0, "VIP"), (None, 4, "High"), (181, 4, "VIP")]
    df = spark.createDataFrame(cases, "d int, u int, t string")
    assert [r[0] for r in df.select(exprs.churn_risk("d", "u", "t")).collect()] == [0.7, 0.2, 0.0, 0.6, 0.5]


def test_snapshot_of_a_customer_without_purchases(spark):
    people = spark.createDataFrame([(1, "A", "s_0", dt.date(2020, 1, 1), 0)], "customer_id int, name string, scenario_id string, join_date date, unresponsive_count int")
    history = spark.createDataFrame([], "customer_id int, order_id int, line_total double, purchase_date date")
    row = cust.customer_snapshots(people, history, "2020-01-11").first()
    assert (row["total_spend"], row["purchase_count"], row["avg_order_value"]) == (0.0, 0, 0.0)
    assert (row["days_since_last_purchase"], row["rfm_segment"], row["churned"], row["days_since_join"]) == (999.0, "At Risk", True, 10.0)


def test_recommendations_fill_up_from_the_catalogue(spark):
    products = spark.createDataFrame([(i, "big" if i > 1 else "tiny") for i in range(1, 30)], "sku bigint, category string")
    people = spark.createDataFrame([(1, ["tiny"]), (2, ["big"]), (3, ["unknown"]), (4, ["tiny", "big"])], "customer_id bigint, preferred_categories array<string>")
    got = {r["customer_id"]: r for r in cust.recommendations(people, products).collect()}
    assert set(got) == {1, 2, 3, 4}
    for r in got.values():
        assert len({r["sku_rank_1"], r["sku_rank_2"], r["sku_rank_3"]} - {None}) == 3
    assert got[1]["sku_rank_1"] == 1
    assert 1 not in {got[2][f"sku_rank_{i}"] for i in (1, 2, 3)}


def test_recommendations_from_a_catalogue_smaller_than_k(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b")], "sku bigint, category string")
    people = spark.createDataFrame([(5, ["a"])], "customer_id bigint, preferred_categories array<string>")
    row = cust.recommendations(people, products).first()
    assert (row["sku_rank_1"], row["sku_rank_2"], row["sku_rank_3"]) == (1, 2, None)


def test_redemptions_lower_the_balance_only_when_asked(spark):
    tx = spark.createDataFrame([(1, 500), (1, -100)], "customer_id int, points_change int")
    assert cust.loyalty_account(tx).first()["current_points"] == 500
    net = cust.loyalty_account(tx, subtract_redemptions=True).first()
    assert (net["current_points"], net["lifetime_points"]) == (400, 500)


def test_ledger_balance(spark):
    day = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([(1, 9, 50, day), (2, 9, -20, day), (3, 9, 5, day + dt.timedelta(1))], "transaction_id int, customer_id int, points_change int, transaction_date timestamp_ntz")
    assert [r["balance"] for r in cust.loyalty_ledger(tx).orderBy("transaction_id").collect()] == [50, 30, 35]


def test_engagement_summary_of_nothing(small):
    got = cust.engagement_summary(small["customer_snapshots"].limit(0), small["campaign_interactions"].limit(0), small["support_tickets"].limit(0))
    assert all(r["value"] == 0.0 for r in got.collect())
