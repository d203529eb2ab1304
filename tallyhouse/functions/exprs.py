"""Column expressions shared by the operators.

Sums and means of DOUBLE measures are exact: a value becomes a whole number of units of 2^-44, which
changes no DOUBLE of 512 or more and no smaller one by more than 3e-14, and whole numbers are summed.
The result is rounded once, at the end, and depends neither on partitions nor on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PLACES = 1e4

#: A sum is carried as three BIGINT sums: wholes, 2^-22 parts, 2^-44 parts. They hold 2e12 rows and totals of 9e18;
#: beyond, ANSI arithmetic fails instead of returning a wrong number.
PART = 1 << 22
UNITS = PART * PART


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_places(c) -> Column:
    """Rounded to four decimals in DOUBLE arithmetic (``round`` goes through BigDecimal per row)."""
    return F.floor(col(c) * F.lit(PLACES) + F.lit(0.5)).cast("double") / F.lit(PLACES)


def exact_parts(c) -> list[Column]:
    """A measure as (wholes, parts, parts of parts): BIGINT, the last two never negative. Every step is exact but the first rounding."""
    units = F.rint(col(c).cast("double") * F.lit(float(UNITS)))
    whole = F.floor(units / F.lit(float(UNITS)))
    rest = units - whole.cast("double") * F.lit(float(UNITS))
    part = F.floor(rest / F.lit(float(PART)))
    return [whole, part, F.floor(rest - part.cast("double") * F.lit(float(PART)))]


def joined_parts(sums: list[Column]) -> Column:
    """The total that three sums of exact_parts stand for, rounded once to DOUBLE."""
    whole, part, rest = (s.cast("decimal(20,0)") for s in sums)
    units = whole * F.lit(UNITS).cast("decimal(14,0)") + part * F.lit(PART).cast("decimal(7,0)") + rest
    return units.cast("double") / F.lit(float(UNITS))


def total(c) -> Column:
    return joined_parts([F.sum(p) for p in exact_parts(c)])


def mean(c) -> Column:
    return F.try_divide(total(c), F.count(col(c)).cast("double"))


def total_sql(x: str) -> str:
    """``total`` of a SQL expression, as SQL."""
    units = f"rint(({x}) * {UNITS}D)"
    whole = f"floor({units} / {UNITS}D)"
    rest = f"({units} - {whole} * {UNITS}D)"
    part = f"floor({rest} / {PART}D)"
    sums = f"sum({whole})", f"sum({part})", f"sum(floor({rest} - {part} * {PART}D))"
    whole, part, rest = (f"CAST({s} AS DECIMAL(20,0))" for s in sums)
    return f"(CAST({whole} * CAST({UNITS} AS DECIMAL(14,0)) + {part} * CAST({PART} AS DECIMAL(7,0)) + {rest} AS DOUBLE) / {UNITS}D)"


def mean_sql(x: str) -> str:
    return f"try_divide({total_sql(x)}, CAST(count({x}) AS DOUBLE))"


def count_rows() -> Column:
    return F.count(F.lit(1))


def pct(cond) -> Column:
    """Share of rows where the condition is true, in percent; NULL counts as not true."""
    return F.try_divide(F.count_if(col(cond)) * F.lit(100.0), count_rows())


def ratio(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def int_sum(c) -> Column:
    return F.sum(col(c).cast("bigint"))


def corr_or_null(x: str, y: str) -> Column:
    """Pearson correlation over pairs without NULL; NULL instead of an error for a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def only_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct, evaluated once as a scalar subquery (no join)."""
    return df.select(F.struct(*df.columns)).scalar()


def only_value(df: DataFrame) -> Column:
    """The single value of a one-column aggregate as a scalar subquery."""
    return df.scalar()


# --- time ---------------------------------------------------------------------------------------

UNITS_PER_HOUR = {"minutes": 60, "hours": 1}


def hour_of_day(t, unit: str) -> Column:
    return (F.floor(col(t) / UNITS_PER_HOUR[unit]) % 24).cast("int")


def day_of_week(t, unit: str) -> Column:
    return (F.floor(col(t) / (UNITS_PER_HOUR[unit] * 24)) % 7).cast("int")


# --- customer segments --------------------------------------------------------------------------

# Spending limits of the value tiers, highest first.
STATIC_TIERS = {"VIP": 600.0, "High": 300.0, "Medium": 100.0}
DYNAMIC_TIERS = {"VIP": 5000.0, "High": 2000.0, "Medium": 500.0}

# Days since the last purchase.
ACTIVE_DAYS, LAPSED_DAYS, CHURNED_DAYS = 30, 90, 180
NO_PURCHASE_DAYS = 999

# Fixed values: (segment, days at most, purchases at least, spend at least).
RFM_RULES = (("Champions", 90, 2, 200.0), ("Loyal", 120, 1, 100.0))
RFM_POTENTIAL = (180, 50.0)
RFM_AT_RISK_DAYS = 180

# Churn risk steps.
RISK_LONG_IDLE, RISK_IDLE, RISK_UNRESPONSIVE = 0.4, 0.2, 0.3
RISK_LESS_VIP, RISK_LESS_HIGH = 0.2, 0.1
UNRESPONSIVE_LIMIT = 3


def value_tier(spend, mode: str = "static") -> Column:
    limits = {"static": STATIC_TIERS, "dynamic": DYNAMIC_TIERS}[mode]
    tier = F.lit("Low")
    for name, limit in reversed(limits.items()):
        tier = F.when(col(spend) >= limit, name).otherwise(tier)
    return tier


def activity_state(days, active=ACTIVE_DAYS, lapsed=LAPSED_DAYS, churned=CHURNED_DAYS) -> Column:
    """A batch job has no earlier state, so the at-risk band stays lapsed."""
    return (
        F.when(col(days) < active, "active")
        .when(col(days) < F.lit(max(lapsed, churned)), "lapsed")
        .otherwise("churned")
    )


def rfm_segment(recency, frequency, monetary) -> Column:
    days = F.coalesce(col(recency), F.lit(NO_PURCHASE_DAYS))
    segment = None
    for name, max_days, min_purchases, min_spend in RFM_RULES:
        rule = (days <= max_days) & (col(frequency) >= min_purchases) & (col(monetary) >= min_spend)
        segment = F.when(rule, name) if segment is None else segment.when(rule, name)
    max_days, min_spend = RFM_POTENTIAL
    return (
        segment.when((days <= max_days) | (col(monetary) >= min_spend), "Potential")
        .when(days > RFM_AT_RISK_DAYS, "At Risk")
        .otherwise("Needs Attention")
    )


def churn_risk(days, unresponsive, tier) -> Column:
    """Summed in tenths so that 0.4 + 0.3 - 0.2 is exactly 0.5."""
    idle = F.coalesce(col(days), F.lit(365))
    tenths = (
        F.when(idle > CHURNED_DAYS, int(RISK_LONG_IDLE * 10))
        .when(idle > LAPSED_DAYS, int(RISK_IDLE * 10))
        .otherwise(0)
        + F.when(col(unresponsive) > UNRESPONSIVE_LIMIT, int(RISK_UNRESPONSIVE * 10)).otherwise(0)
        - F.when(col(tier) == "VIP", int(RISK_LESS_VIP * 10))
        .when(col(tier) == "High", int(RISK_LESS_HIGH * 10))
        .otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(10), tenths)).cast("double") / F.lit(10.0)


# Lifetime value below which a customer falls into a segment; above all, premium.
CLV_SEGMENTS = {"low": 100, "medium": 500, "high": 2000}


def clv_segment(clv) -> Column:
    segment = F.lit("premium")
    for name, limit in reversed(CLV_SEGMENTS.items()):
        segment = F.when(col(clv) < limit, name).otherwise(segment)
    return segment
