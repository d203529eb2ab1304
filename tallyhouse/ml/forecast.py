"""Demand forecast: straight trend plus daily and weekly seasons, with an interval.

The series is the demand of each hour of the week, at most 168 rows per channel whatever the size of
the input. Trend and seasons are grouped aggregates, so the forecasts of all channels (and all cut-offs
of the cross-validation) come from one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.exprs import count_rows

MIN_ROWS = 24
ALL = "__all"
INTERVAL_WIDTH = 1.2816  # 80 % of a normal distribution


def hourly_series(demand: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """(keys, t, hour, day, y) with t the hour of the week; a key with too few hours drops out."""
    t = (F.col("day_of_week") * 24 + F.col("hour_of_day")).cast("int")
    series = demand.groupBy(*keys, t.alias("t")).agg(F.sum("y").cast("double").alias("y"))
    enough = series.groupBy(*keys).agg(count_rows().alias("__n")).filter(F.col("__n") >= MIN_ROWS).select(*keys)
    series = series.join(enough, list(keys), "left_semi")
    return _calendar(series)


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.col("t") % 24).withColumn("day", (F.floor(F.col("t") / 24) % 7).cast("int"))


def _together(demand: DataFrame) -> DataFrame:
    """One key for all rows, taken from a column: joins on a literal would lose their condition."""
    return demand.withColumn(ALL, F.col("hour_of_day") - F.col("hour_of_day"))


def fit(series: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trend per key, then the mean remainder per hour, then per day. The trend also carries the
    spread of what is left."""
    keys = list(keys)
    line = series.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("y", "t"), F.avg("y")).alias("intercept"),
        F.max("t").alias("last_t"),
    )
    rest = series.join(line, keys).withColumn("rest", F.col("y") - F.col("intercept") - F.col("slope") * F.col("t"))
    daily = rest.groupBy(*keys, "hour").agg(F.avg("rest").alias("daily"))
    rest = rest.join(daily, [*keys, "hour"]).withColumn("rest", F.col("rest") - F.col("daily"))
    weekly = rest.groupBy(*keys, "day").agg(F.avg("rest").alias("weekly"))
    left = rest.join(weekly, [*keys, "day"]).withColumn("rest", F.col("rest") - F.col("weekly"))
    spread = left.groupBy(*keys).agg(F.sqrt(F.avg(F.col("rest") * F.col("rest"))).alias("sigma"))
    return line.join(spread, keys), daily, weekly


def components(points: DataFrame, fitted: tuple[DataFrame, DataFrame, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Trend, season parts and forecast of (keys, t) points; an unseen hour or day adds nothing."""
    line, daily, weekly = fitted
    keys = list(keys)
    rows = _calendar(points).join(line.drop("last_t"), keys)
    rows = rows.join(daily, [*keys, "hour"], "left").join(weekly, [*keys, "day"], "left")
    return (
        rows.withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))
        .withColumn("daily", F.coalesce("daily", F.lit(0.0)))
        .withColumn("weekly", F.coalesce("weekly", F.lit(0.0)))
        .withColumn("yhat", F.col("trend") + F.col("daily") + F.col("weekly"))
    )


def forecast(demand: DataFrame, periods: int = 24, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """The next ``periods`` hours of each channel, or of all together without keys."""
    if not keys:
        return forecast(_together(demand), periods, (ALL,)).drop(ALL)
    series = hourly_series(demand, keys)
    fitted = fit(series, keys)
    ahead = fitted[0].select(*keys, F.explode(F.sequence(F.col("last_t") + 1, F.col("last_t") + periods)).alias("t"))
    rows = components(ahead, fitted, keys)
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    margin = F.col("sigma") * F.lit(INTERVAL_WIDTH)
    return rows.select(
        *keys,
        (start + F.make_dt_interval(hours=F.col("t"))).alias("ds"),
        *[F.round(c, 6).alias(c) for c in ("trend", "daily", "weekly", "yhat")],
        F.round(F.col("yhat") - margin, 6).alias("yhat_lower"),
        F.round(F.col("yhat") + margin, 6).alias("yhat_upper"),
    )


def cross_validation(
    demand: DataFrame, initial: int = 24, period: int = 12, horizon: int = 12, keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """Errors of forecasts made at rolling cut-offs: fit on the hours before, score the next ones.

    A week has at most 12 cut-offs, so the copies of the series stay small.
    """
    if not keys:
        return cross_validation(_together(demand), initial, period, horizon, (ALL,)).drop(ALL)
    series = hourly_series(demand, keys)
    span = series.groupBy(*keys).agg(F.max("t").alias("__last"))
    cuts = span.filter(F.col("__last") >= initial + horizon - 1).select(
        *keys, F.explode(F.sequence(F.lit(initial), F.col("__last") + 1 - horizon, F.lit(period))).alias("cutoff"))
    copies = series.join(cuts, list(keys))
    both = [*keys, "cutoff"]
    fitted = fit(copies.filter(F.col("t") < F.col("cutoff")), both)
    tested = copies.filter((F.col("t") >= F.col("cutoff")) & (F.col("t") < F.col("cutoff") + horizon))
    scored = components(tested.drop("hour", "day"), fitted, both)
    error = F.col("yhat") - F.col("y")
    return scored.groupBy(*keys).agg(
        F.round(F.avg(F.abs(error)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(F.avg(F.abs(F.try_divide(error, F.col("y")))) * 100, 6).alias("mape"),
        count_rows().alias("points"),
    )
