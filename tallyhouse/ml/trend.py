"""Forecast with a trend that may bend: piecewise linear trend, Fourier seasons, ridge least squares.

The normal equations of all keys are summed in one aggregation (24 basis columns: 300 products of two, whatever the length of the
series), so only one small matrix per key is solved, in numpy within tasks. Fitted values, intervals and forecasts are JVM
expressions on the coefficients.

Between 0 and 80 % of the observed span lie evenly spaced points where the slope may change; a penalty keeps it straight where the
data ask for no bend. The daily season needs two days of data, the weekly one two weeks. NULL times and values do not count, a key
with fewer than 24 values drops out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyhouse.functions.exprs import count_rows
from tallyhouse.ml.forecast import INTERVAL_WIDTH, MIN_ROWS

DAY, WEEK = 24, 168


@dataclass(frozen=True)
class Shape:
    """Numbers of changepoints and of sine-cosine pairs per season; penalties of bends and of season parts."""

    changepoints: int = 8
    daily: int = 4
    weekly: int = 3
    bend_penalty: float = 0.01
    season_penalty: float = 0.01

    @property
    def trend_size(self) -> int:
        return 2 + self.changepoints

    @property
    def penalties(self) -> list[float]:
        return [1e-9] * 2 + [self.bend_penalty] * self.changepoints + [self.season_penalty] * (2 * (self.daily + self.weekly))

    def basis(self, t: Column, low: Column, high: Column) -> list[Column]:
        """Values of the basis at time ``t`` in hours, for a series observed from ``low`` to ``high``."""
        span = F.greatest(high - low, F.lit(1)).cast("double")
        at = (t - low) / span
        bends = [F.greatest(at - F.lit(0.8 * j / (self.changepoints + 1)), F.lit(0.0)) for j in range(1, self.changepoints + 1)]
        waves = []
        for order, period in ((self.daily, DAY), (self.weekly, WEEK)):
            seen = (high - low + 1) >= 2 * period
            for k in range(1, order + 1):
                angle = t * F.lit(2 * math.pi * k / period)
                waves += [F.when(seen, F.sin(angle)).otherwise(0.0), F.when(seen, F.cos(angle)).otherwise(0.0)]
        return [F.lit(1.0), at, *bends, *waves]


def _with_basis(df: DataFrame, shape: Shape) -> DataFrame:
    return df.withColumn("x", F.array(*shape.basis(F.col("t"), F.col("low"), F.col("high"))))


def fit(series: DataFrame, keys: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """One row per key of a series (keys, t, y): observed span, coefficients ``beta`` and spread ``sigma`` of what is left."""
    keys, size = list(keys), len(shape.penalties)
    known = series.filter("t IS NOT NULL AND y IS NOT NULL").select(*keys, F.col("t").cast("bigint").alias("t"), F.col("y").cast("double").alias("y"))
    spans = known.groupBy(*keys).agg(
        F.min("t").alias("low"), F.max("t").alias("high"), count_rows().alias("n"),
        F.greatest(F.max(F.abs("y")), F.lit(1e-300)).alias("scale")).filter(F.col("n") >= MIN_ROWS)
    columns = [f"x{i}" for i in range(size)]
    rows = known.join(spans, keys)
    rows = rows.select(*keys, "low", "high", "n", "scale", (F.col("y") / F.col("scale")).alias("v"),
                       *[c.alias(x) for c, x in zip(shape.basis(F.col("t"), F.col("low"), F.col("high")), columns)])
    products = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy(*keys, "low", "high", "n", "scale").agg(
        F.array(*products).alias("xx"), F.array(*[F.sum(F.col(x) * F.col("v")) for x in columns]).alias("xy"),
        F.sum(F.col("v") * F.col("v")).alias("yy"))
    plain = [f for f in sums.schema.fields if f.name not in ("xx", "xy", "yy")]
    schema = T.StructType([*plain, T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType())])
    upper, ridge = np.triu_indices(size), np.diag(shape.penalties)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas, sigmas = [], []
            for xx, xy, yy, n, scale in zip(batch.xx, batch.xy, batch.yy, batch.n, batch["scale"]):
                a = np.zeros((size, size))
                a[upper] = xx
                a = a + np.triu(a, 1).T
                b = np.linalg.solve(a + ridge, np.asarray(xy))
                left = max(yy - 2 * b @ np.asarray(xy) + b @ a @ b, 0.0)
                betas.append(b * scale)
                sigmas.append(math.sqrt(left / n) * scale)
            yield batch.drop(columns=["xx", "xy", "yy"]).assign(beta=betas, sigma=sigmas)

    return sums.mapInPandas(solve, schema)


def _dot(first: int, count: int) -> Column:
    pairs = F.zip_with(F.slice("x", first + 1, count), F.slice("beta", first + 1, count), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def components(points: DataFrame, fitted: DataFrame, keys: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """Trend, season parts, forecast and 80 % interval of (keys, t) points."""
    daily, weekly = 2 * shape.daily, 2 * shape.weekly
    rows = _with_basis(points.join(fitted, list(keys)), shape)
    rows = rows.withColumns({
        "trend": _dot(0, shape.trend_size),
        "daily": _dot(shape.trend_size, daily) if daily else F.lit(0.0),
        "weekly": _dot(shape.trend_size + daily, weekly) if weekly else F.lit(0.0),
    }).withColumn("yhat", F.col("trend") + F.col("daily") + F.col("weekly"))
    margin = F.col("sigma") * F.lit(INTERVAL_WIDTH)
    return rows.withColumns({"yhat_lower": F.col("yhat") - margin, "yhat_upper": F.col("yhat") + margin})


def forecast(series: DataFrame, keys: Sequence[str], periods: int = 24, shape: Shape = Shape()) -> DataFrame:
    """The ``periods`` hours after the last one of each key."""
    fitted = fit(series, keys, shape)
    ahead = fitted.select(*keys, F.explode(F.sequence(F.col("high") + 1, F.col("high") + periods)).alias("t"))
    found = components(ahead, fitted, keys, shape)
    return found.select(*keys, "t", "trend", "daily", "weekly", "yhat", "yhat_lower", "yhat_upper")


def optimality(series: DataFrame, keys: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """Per key the largest slope of the penalised error at the fit, relative to the data: zero up to rounding at the optimum."""
    fitted = fit(series, keys, shape)
    size = len(shape.penalties)
    rest = F.col("y") - F.col("yhat")
    sums = components(series.select(*keys, "t", "y").filter("t IS NOT NULL AND y IS NOT NULL"), fitted, keys, shape).groupBy(*keys).agg(
        F.array(*[F.sum(F.col("x")[i] * rest) for i in range(size)]).alias("xr"), F.sum(F.abs("y")).alias("weight"), F.first("beta").alias("beta"))
    slopes = F.zip_with("xr", F.zip_with("beta", F.array(*[F.lit(p) for p in shape.penalties]), lambda b, p: b * p), lambda r, p: F.abs(r - p))
    return sums.select(*keys, (F.array_max(slopes) / F.greatest("weight", F.lit(1e-300))).alias("slope"))
