"""Exact order statistics without a sort and without a buffer that grows with the data.

A DOUBLE's 64 bits, read so that they order like the number, are counted by their leading 16 bits; the interval that holds the
wanted rank is counted again by the next 16 bits, four times in all. A step sends at most 65 536 counts per task, and only those go
through one task. Values are never collected, and the answer is exact for any distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyhouse.functions.exprs import count_rows, only_value

STEP, STEPS = 16, 4
_FLIP = 0x7FFFFFFFFFFFFFFF


def ordered_bits(value: Column) -> Column:
    """BIGINT that orders like the DOUBLE: -Infinity first, NaN last, both zeros alike."""
    return F.when(value.isNotNull(), _flipped(_bits("doubleToLongBits", F.coalesce(value.cast("double") + F.lit(0.0), F.lit(0.0))).cast("bigint")))


def _bits(method: str, value: Column) -> Column:
    return F.java_method(F.lit("java.lang.Double"), F.lit(method), value)


def _flipped(bits: Column) -> Column:
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_FLIP)))


def from_ordered_bits(bits: Column) -> Column:
    return F.when(bits.isNotNull(), _bits("longBitsToDouble", F.coalesce(_flipped(bits), F.lit(0).cast("bigint"))).cast("double"))


def _nth(bits: DataFrame, rank: Column) -> DataFrame:
    """One row: the ordered bits of the ``rank``-th smallest value (from 1) of column ``b``."""
    state = bits.agg(count_rows().alias("__n")).select(F.lit(0).cast("bigint").alias("prefix"), rank.alias("rest"))
    for step in range(1, STEPS + 1):
        shift = 64 - STEP * step
        known = F.shiftright("b", shift + STEP) if step > 1 else F.lit(0).cast("bigint")
        at = bits.withColumn("at", only_value(state.select(F.struct("prefix", "rest"))))
        counts = at.filter(known == F.col("at.prefix")).groupBy(F.shiftright("b", shift).alias("part")).agg(
            count_rows().alias("n"), F.max("at.rest").alias("rest"))
        upto = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto)
        hit = (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))
        state = reached.filter(hit).select(F.col("part").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    return state.select(F.col("prefix").alias("b"))


def median(df: DataFrame, value: Column) -> DataFrame:
    """One row with column ``median``: the middle value, or the mean of the two middle ones; NULLs do not count. No value: NULL."""
    bits = df.select(ordered_bits(value).alias("b")).filter("b IS NOT NULL")
    middle = F.floor((F.col("__n") + 1) / 2).cast("bigint")
    low = only_value(_nth(bits, middle))
    found = bits.withColumn("low", low).agg(
        count_rows().alias("n"), F.count_if(F.col("b") <= F.col("low")).alias("upto"), F.max("low").alias("low"),
        F.min(F.when(F.col("b") > F.col("low"), F.col("b"))).alias("next"))
    high = F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("low")).otherwise(F.col("next"))
    a, b = from_ordered_bits(F.col("low")), from_ordered_bits(high)
    return found.select(F.when(F.col("n") > 0, F.when(high == F.col("low"), a).otherwise((a + b) / 2)).alias("median"))
